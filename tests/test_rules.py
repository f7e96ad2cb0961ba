import datetime

from vault import GRAPH, notes, text, write

from lodestone.operators import rules, symbols
from lodestone.plans import verbs
from lodestone.sources import config, declarations

DAY = datetime.date(2026, 6, 1)


def messages(df):
    return sorted(r.message for r in df.collect())


def test_front_matter(spark):
    rows = notes(spark, {"id": "ok"}, {"id": "a", "title": None, "status": "new", "ttl_days": -1}, {"id": "b", "fm_errors": ["frontmatter.tags must be a list of strings"]}, {"id": "c", "code_refs": [("f.ts", "", None, None)]}, {"id": "d", "fm_id": "x"})
    got = messages(rules.front_matter(rows))
    assert got == ["[a] frontmatter.status must be draft, active or deprecated", "[a] frontmatter.title must not be empty", "[a] frontmatter.ttl_days must be a whole number of 0 or more", "[b] frontmatter.tags must be a list of strings", "[c] frontmatter.code_refs needs a file and a symbol each"]
    assert messages(rules.id_matches(rows)) == ['[d] frontmatter.id "x" does not match filename id "d"']
    extra = notes(spark, {"id": "a", "extra": {"layer": None}}, {"id": "b", "extra": {"layer": ""}}, {"id": "c"}, {"id": "d", "extra": {"layer": "x"}})
    assert messages(rules.extra_fields(extra, ["layer"])) == ["[b] frontmatter missing configured field: layer", "[c] frontmatter missing configured field: layer"]


def test_hierarchy_and_schemas(spark):
    rows = notes(spark, {"id": "root"}, {"id": "a"}, {"id": "a.x"}, {"id": "b.c.d"})
    assert messages(rules.missing_ancestors(rows)) == ['[b.c.d] missing ancestor "b.c.md" in the hierarchy', '[b.c.d] missing ancestor "b.md" in the hierarchy']
    assert messages(rules.missing_root(rows)) == [] and len(messages(rules.missing_root(rows.where("id <> 'root'")))) == 1
    doc = "top string, schemas array<struct<id:string,title:string,children:array<string>,namespace:boolean>>"
    schemas = spark.createDataFrame([("root", [("root", "R", ["z"], False)]), ("a", [("a", "A", [], True)]), ("e", None), ("f", [("g", "G", [], False)])], doc)
    assert messages(rules.schema_rules(rows, schemas)) == ["[a] not in root.schema.yml children", "e.schema.yml is empty or malformed", 'f.schema.yml does not declare a schema with id "f"', 'root.schema.yml lists child "z" but note z.md does not exist']


def test_links_freshness_invariants(spark):
    rows = notes(spark, {"id": "a", "body": "# Top\n[[b#Here]] [[b#Gone]] [[no]] [[#h]] [[b]]"}, {"id": "b", "body": "## Here\n"})
    got = messages(rules.broken_links(rows))
    assert got == ['[a] wikilink "[[#h]]" points at unknown note ""', '[a] wikilink "[[b#Gone]]" points at a missing heading in b.md', '[a] wikilink "[[no]]" points at unknown note "no"']
    old = notes(spark, {"id": "a", "last_verified": "2026-05-01", "ttl_days": 31}, {"id": "b", "last_verified": "2026-05-01", "ttl_days": 30}, {"id": "c", "last_verified": "2020-01-01", "status": "deprecated"}, {"id": "d", "last_verified": "soon"}, {"id": "e", "last_verified": "2020-01-01", "title": ""})
    assert messages(rules.freshness(old, DAY)) == ["[b] freshness expired 1 day(s) ago", "[d] invalid last_verified: soon"]
    given = spark.createDataFrame([("runtime", "Node 24", ["a", "b", "zz"])], "id string, value string, used_in array<string>")
    body = notes(spark, {"id": "a", "body": "{{runtime}} Node 24"}, {"id": "b", "body": "Node 2"})
    assert messages(rules.invariants(body, given)) == ["[b] invariant runtime value \"Node 24\" is not present", "[b] missing invariant token {{runtime}}", 'externalInvariant.runtime references missing note "zz"']


def test_symbols(spark, tmp_path):
    (tmp_path / "a.ts").write_text("export function f(x: string): void;\nexport function f(x: any) {}\nexport class K {\n  m() {}\n  readonly p = 1;\n}\nexport const Shared = 1;\nexport type Shared = string;\nenum E { A }\nnamespace N {}\ninterface I { q: string }\nimport { z as y } from './b';\nlet l = 1\n")
    asked = [("a.ts", "f", None, None), ("a.ts", "Shared", None, None), ("a.ts", "Shared", "type", None), ("a.ts", "Shared", None, "value"), ("a.ts", "m", "method", None), ("a.ts", "nope", None, None), ("b.ts", "x", None, None), ("../a.ts", "x", None, None), ("a.py", "x", None, None), ("a.ts", "y", None, None), ("a.ts", "K", "class", None)]
    rows = notes(spark, {"id": "n", "code_refs": asked})
    (tmp_path / "c.ts").write_text("")
    catalogue = declarations.catalogue(spark, str(tmp_path), ["a.ts", "../x.ts", "no.ts"])
    got = [(r.outcome, r.resolved_kind) for r in symbols.resolve(symbols.requests(rows), catalogue).orderBy("pos").collect()]
    assert got == [("resolved", "function"), ("ambiguous", None), ("resolved", "type"), ("resolved", "const"), ("resolved", "method"), ("not found", None), ("missing", None), ("escapes", None), ("unsupported", None), ("resolved", "import"), ("resolved", "class")]
    assert len(messages(symbols.code_ref_errors(symbols.resolve(symbols.requests(rows), catalogue)))) == 5


def test_check_of_a_vault_of_files(spark, tmp_path):
    write(tmp_path, GRAPH | {"bad": "no front matter [[gone]]", "old": text("old", "[[root]]", last_verified="2020-01-01")}, **{"root.schema.yml": "schemas:\n  - id: root\n    children: [guide, api]\n    namespace: true\n", "HIERARCHY.md": "not a note"})
    got = verbs.check(spark, config.load(tmp_path), DAY)
    assert '[bad] wikilink "[[gone]]" points at unknown note "gone"' in got and any(m.startswith("[old] freshness expired") for m in got)
    assert "[bad] frontmatter.title must not be empty" in got and not any("HIERARCHY" in m for m in got)
    assert verbs.check(spark, config.load(tmp_path / "nowhere"), DAY)[0].startswith("vault directory not found")


def test_alike_declarations_and_references(spark):
    """Alike ones meet once: 20,000 declarations of a symbol by 20,000 references to it aren't 400 million pairs."""
    import time

    from pyspark.sql import functions as F

    many = spark.range(20_000)
    known = many.select(F.lit("a.ts").alias("file"), F.when(F.col("id") % 2 == 0, "one").otherwise("two").alias("symbol"), F.when(F.col("id") % 4 == 1, "class").otherwise("function").alias("kind"), F.array(F.lit("value")).alias("namespaces"), F.col("id").cast("int").alias("line"), F.lit(1).alias("column"), F.lit("k").alias("symbol_key"))
    known = known.withColumn("symbol_key", F.when(F.col("symbol") == "two", F.col("kind")).otherwise("k"))
    kind = F.when(F.col("id") % 3 == 0, "class")
    asked = many.select(F.concat(F.lit("n"), "id").alias("note_id"), F.lit(0).alias("pos"), F.lit("a.ts").alias("file"), F.when(F.col("id") % 2 == 0, "one").otherwise("two").alias("symbol"), kind.alias("kind"), F.lit(None).cast("string").alias("namespace"))
    began = time.time()
    got = symbols.resolve(asked, known).groupBy("symbol", "kind", "outcome", "resolved_kind", "line").count().collect()
    assert time.time() - began < 40
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [("one", None, "resolved", "function", 0, 6666), ("one", "class", "not found", None, None, 3334), ("two", None, "ambiguous", None, None, 6667), ("two", "class", "resolved", "class", 1, 3333)]))
