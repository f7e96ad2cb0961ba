import pytest
from pyspark.sql import functions as F
from vault import notes

from lodestone.functions.text import content_hash, normal_list, rotation, search_text, slug, slug_of, tokens
from lodestone.functions.vectors import cosine_distance, shortened
from lodestone.operators import extract


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(("given", "want"), [("Hello WORLD", "hello-world"), ("Hello, World!", "hello-world"), ("a   b", "a-b"), ("  hello  ", "hello"), ("", ""), ("hello 🎉 world", "hello-world"), ("version 2", "version-2"), ("Version 2.0", "version-20"), ("a_b\tc", "abc")])
def test_slug(spark, given, want):
    assert one(spark, slug(F.col("s")), s=given) == want == slug_of(given)


def chunked(spark, body, title="T", desc="D", **options):
    rows = extract.chunks(notes(spark, {"id": "sample", "title": title, "desc": desc, "body": body}), **options).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    return rows


def test_chunks_by_heading(spark):
    (only,) = chunked(spark, "prose here")
    assert (only.id, only.heading_path, only.text) == ("sample", "", "T\nD\n\nprose here")
    assert chunked(spark, "## First section\n\nBody text.", "Runtime contract", "Runtime facts.")[0].text == "Runtime contract\nRuntime facts."
    assert [r.id for r in chunked(spark, "intro\n\n## First section\n\nx\n\n## Second section\n\ny")] == ["sample", "sample#first-section", "sample#second-section"]
    assert [r.heading_path for r in chunked(spark, "## Parent\n\na\n\n### Child\n\nb\n\n## Sibling\n\nc")] == ["", "Parent", "Parent > Child", "Sibling"]
    log = "## Version 2.0\n\n### Fixed\n\na\n\n## Version 1.0\n\n### Fixed\n\nb"
    assert [r.id for r in chunked(spark, log)][2::2] == ["sample#version-20/fixed", "sample#version-10/fixed"]
    assert [r.heading_path for r in chunked(spark, "### Deep\n\n# Top\n\n### Skip\n\n## Mid")] == ["", "Deep", "Top", "Top > Skip", "Top > Mid"]
    assert [r.id for r in chunked(spark, "# !!!\n\nx\n\n# !!!\n\ny")] == ["sample", "sample~2", "sample~3"]


def test_chunks_split_on_the_budget(spark):
    a, b = "a" * 100, "b" * 100
    parts = chunked(spark, f"## Part\n\n{a}\n\n{b}", most=105)[1:]
    assert [(r.id, r.text) for r in parts] == [("sample#part#part-1", f"Part\n\n{a}"), ("sample#part#part-2", b)]
    sliced = chunked(spark, "x" * 50, most=10)
    assert [r.id for r in sliced] == [f"sample#part-{i}" for i in range(1, 6)] and sliced[1].text == "x" * 10
    (whole,) = chunked(spark, "# A\n\nb", strategy="whole-note")
    assert whole.text == "T\nD\n\n# A\n\nb"
    packed = chunked(spark, "ab\n\n" + "c" * 25, "", "", most=10)
    assert [r.text for r in packed] == ["ab", "c" * 10, "c" * 10, "c" * 5]
    with pytest.raises(ValueError):
        chunked(spark, "x", strategy="page")


def test_headings(spark):
    body = "# One\ntext\n##\n\nNext line\n####### no\n#tag\n## Two  \n"
    got = extract.headings(notes(spark, {"id": "n", "body": body})).orderBy("id").collect()
    assert [(r.id, r.level, r.text) for r in got] == [("n#next-line-1", 2, "Next line"), ("n#one-0", 1, "One"), ("n#two-2", 2, "Two")]
    rows = extract.sections(notes(spark, {"id": "n", "body": body})).orderBy("pos").collect()
    assert [r.body for r in rows] == ["", "text", "Next line\n####### no\n#tag", ""]


def test_wikilinks(spark):
    body = "[[plain]] [[Label|aliased]] [[id#Some Heading]] [[ spaced ]] `[[code]]`\n```\n[[fenced]]\n```\n[[#only]] [[a|b#C|d]] [[id#]]"
    got = [(r.target, r.anchor) for r in extract.wikilinks(notes(spark, {"id": "n", "body": body})).orderBy("pos").collect()]
    assert got == [("plain", None), ("aliased", None), ("id", "some-heading"), ("spaced", None), ("b", "c"), ("id", None)]
    assert "" in {r.target for r in extract.wikilinks(notes(spark, {"id": "n", "body": body}), empty=True).collect()}


def test_edges(spark):
    rows = notes(spark, {"id": "a"}, {"id": "a.b.c", "tags": ["x", "x", None]}, {"id": "a.b.d"})
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(extract.hierarchy(rows.select("id"))) == [("a", "a.b"), ("a.b", "a.b.c"), ("a.b", "a.b.d")]
    assert pairs(extract.existing(extract.hierarchy(rows.select("id")), rows, "parent", "child")) == []
    assert pairs(extract.exploded(rows, "tags", "tag")) == [("a.b.c", "x"), ("a.b.c", "x")]
    schemas = spark.createDataFrame([("root", [("root", "R", ["a", "zz"], False), ("a.b", "B", ["c"], False)])], "top string, schemas array<struct<id:string,title:string,children:array<string>,namespace:boolean>>")
    assert pairs(extract.schema_children(schemas, rows)) == [("a.b", "a.b.c"), ("root", "a")]


def test_functions(spark):
    assert one(spark, search_text(F.col("s")), s="Zebra\n\n unique-term ") == "Zebra unique-term "
    assert one(spark, tokens(F.col("s")), s="Été, b-2!") == ["été", "b", "2"]
    assert one(spark, F.array_join(rotation(F.split("s", " ")), " "), s="c a b a") == "a b a c"
    assert one(spark, normal_list(F.split("s", ",")), s=" a , ,b") == ["a", "b"]
    assert one(spark, content_hash(F.col("a"), F.col("b")), a="x", b="y") == __import__("hashlib").sha256(b"x\0y").hexdigest()
    vectors = spark.createDataFrame([([1.0, 0.0], [0.5, 0.75**0.5]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] and round(r[0], 9) for r in vectors.select(cosine_distance(F.col("a"), F.col("b"))).collect()] == [0.5, None]
    cut = spark.createDataFrame([([3.0, 4.0, 9.0],), ([0.0, 0.0, 1.0],), ([1.0],)], "v array<float>").select(shortened(F.col("v"), 2)).collect()
    assert [[round(x, 6) for x in r[0]] for r in cut] == [[0.6, 0.8], [0.0, 0.0], [1.0]]
