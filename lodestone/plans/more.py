"""Queries of the operators that star.py's don't reach, through the functions that a user calls, on the star schema's vault and its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normal_list, search_text
from ..functions.vectors import cosine_distance
from ..model import SCHEMA_DOC, Vault, limited
from ..operators import extract, graph, lifecycle, rules, search, sidecars, symbols
from ..sources import benchmarks, changes, declarations, storage, vault as reader
from . import build
from .star import AS_OF, STAR, built_vault, no_schemas, note, once, place, query, star_notes, star_vault, table, text_notes, vectors, written_notes


# ---- files

PLACES = """places as (select 'r' || r_regionkey as id, r_name as title, 'A region.' as desc_, 'about ' || r_name as words from region
  union all select 'r' || n_regionkey || '.n' || n_nationkey, n_name, 'A nation.', 'see r' || n_regionkey from nation)"""


def place_texts(spark: SparkSession, d: str) -> DataFrame:
    """(name, content) of a Markdown file for each region and nation."""
    made = lambda df, id_, title, desc, body: df.select(F.concat(id_, F.lit(".md")).alias("name"), F.concat(F.lit("---\nid: "), id_, F.lit("\ntitle: "), title, F.lit(f"\ndesc: {desc}\nstatus: active\nowner: team\nlast_verified: 1999-12-01\nttl_days: 365\ntags: [a, "), F.lower(title), F.lit("]\nlayer: core\n---\n# "), title, F.lit("\n\n"), body, F.lit("\n")).alias("content"))
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    regions = made(region, F.concat(F.lit("r"), "r_regionkey"), F.col("r_name"), "A region.", F.concat(F.lit("about "), "r_name"))
    nations = made(nation, F.concat(F.lit("r"), "n_regionkey", F.lit(".n"), "n_nationkey"), F.col("n_name"), "A nation.", F.concat(F.lit("see [[r"), "n_regionkey", F.lit("]]")))
    return regions.union(nations)


def written_vault(spark: SparkSession, d: str) -> str:
    """A folder of these files, the listing and a schema file."""
    folder = place(spark)
    for r in place_texts(spark, d).collect():
        storage.write_text(spark, f"{folder}/{r.name}", r.content)
    storage.write_text(spark, f"{folder}/HIERARCHY.md", "# Hierarchy\n")
    storage.write_text(spark, f"{folder}/r0.schema.yml", "version: 1\nschemas:\n  - id: r0\n    title: First\n    children: [n0, n5, zz]\n    namespace: true\n")
    return folder


@query("o01_vault_scan", f"with {PLACES} select id, title, desc_ as desc, id || '.md' as file from places")
def vault_scan(spark, d):
    return reader.read_notes(spark, written_vault(spark, d)).select("id", "title", "desc", "file")


@query("o02_front_matter_parse", f"with {PLACES} select id, title, 365::bigint as ttl_days, '1999-12-01' as last_verified, 'a,' || lower(title) as tags, 'core' as layer, '# ' || title || chr(10) || chr(10) || case when id like '%.%' then 'see [[' || split_part(id, '.', 1) || ']]' else words end || chr(10) as body from places")
def front_matter_parse(spark, d):
    return reader.parsed(place_texts(spark, d)).select("id", "title", "ttl_days", "last_verified", F.array_join("tags", ",").alias("tags"), F.col("extra")["layer"].alias("layer"), "body")


@query("o04_schema_scan", "select 'r0' as top, unnest(['n0', 'n5', 'zz']) as child, true as namespace")
def schema_scan(spark, d):
    return reader.read_schemas(spark, written_vault(spark, d)).select("top", F.explode("schemas").alias("s")).select("top", F.explode("s.children").alias("child"), F.col("s.namespace").alias("namespace"))


@query("o10_benchmark_loaders", "select item_id::varchar as doc, 'T' || item_id as title, text, (item_id % 3)::double as gain from benchmark")
def loaders(spark, d):
    """The whole benchmark, written in the loaders' formats and read back."""
    to, rows = place(spark), table(spark, d, "benchmark")
    rows.select(F.col("item_id").cast("string").alias("_id"), F.concat(F.lit("T"), "item_id").alias("title"), "text").write.json(f"{to}/corpus")
    rows.select(F.lit("q"), "item_id", F.col("item_id") % 3).write.option("sep", "\t").option("header", True).csv(f"{to}/judged")
    judged = benchmarks.read_judgements(spark, f"{to}/judged").select("doc", "gain")
    return benchmarks.read_corpus(spark, f"{to}/corpus").join(judged, "doc")


@query("o08_source_scan", "select p_brand || '.ts' as file, 'f' || p_partkey as symbol, case when p_size > 25 then 'class' else 'function' end as kind, 'value' || case when p_size > 25 then ',type' else '' end as namespaces from part")
def source_scan(spark, d):
    """A source file for each brand, with a declaration for each of its parts."""
    line = F.concat(F.lit("export "), F.when(F.col("p_size") > 25, "class ").otherwise("function "), F.lit("f"), "p_partkey", F.when(F.col("p_size") > 25, " {}").otherwise("() {}"))
    files = table(spark, d, "part").groupBy(F.concat("p_brand", F.lit(".ts")).alias("file")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("content"))
    return declarations.scanned(files).select("file", "symbol", "kind", F.array_join("namespaces", ",").alias("namespaces"))


@query("o24_candidate_notes", "select distinct p_brand as id from part")
def candidates(spark, d):
    """Names of files that changed, as version control lists them, to notes."""
    brands = [r[0] for r in table(spark, d, "part").select("p_brand").distinct().collect()]
    files = [f for b in brands for f in (f"{b}.md", f"{b}.schema.yml", f"sub/{b}.md", f"{b}.ts")] + ["HIERARCHY.md", "code-refs.json"]
    return spark.createDataFrame([(i,) for i in changes.note_ids(files)], "id string")


@query("o11_tables", f"with {STAR} select 'note' as name, count(*) as n from star union all select 'links_to', count(*) from links union all select 'has_child', (select count(distinct id) from star where id like '%.%') union all select 'has_tag', (select count(*) from customer) + (select count(*) from part) + (select count(*) from nation)")
def tables(spark, d):
    """The vault written and read back."""
    to = place(spark)
    star_vault(spark, d).write(to)
    v = Vault.read(spark, to)
    return _counts([(n, getattr(v, n)) for n in ("note", "links_to", "has_child", "has_tag")])


def _counts(named: list[tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for name, df in named:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


# ---- builds

@once
def built_twice(spark: SparkSession, d: str) -> tuple[build.Built, build.Built]:
    """An index of the regions' and nations' notes, then one after a third of the nations changed and a third went."""
    to, notes = place(spark), reader.parsed(place_texts(spark, d))
    number = F.regexp_extract("id", "[.]n([0-9]+)$", 1).try_cast("int")
    later = notes.where(F.coalesce(number % 3 != 1, F.lit(True))).withColumn("body", F.when(number % 3 == 2, F.concat("body", F.lit("edited"))).otherwise(F.col("body")))
    embedder = search.HashEmbedder(8)
    first = build.build(spark, notes, no_schemas(spark), to, build.Meta("star", "heading", 2000), embedder)
    return first, build.build(spark, later, no_schemas(spark), to, build.Meta("star", "heading", 2000), embedder)


@query("o86_incremental_build", f"with {PLACES} select id, case when regexp_extract(id, '[.]n([0-9]+)$', 1) = '' then 'same' when regexp_extract(id, '[.]n([0-9]+)$', 1)::int % 3 = 1 then 'removed' when regexp_extract(id, '[.]n([0-9]+)$', 1)::int % 3 = 2 then 'changed' else 'same' end as change, false as full from places")
def incremental(spark, d):
    second = built_twice(spark, d)[1]
    return second.changes.withColumn("full", F.lit(second.full))


@query("o85_built_tables", f"with {PLACES}, kept as (select * from places where regexp_extract(id, '[.]n([0-9]+)$', 1) = '' or regexp_extract(id, '[.]n([0-9]+)$', 1)::int % 3 <> 1), n as (select count(*) as n from kept) select name, case name when 'tag' then 1 + (select count(distinct lower(title)) from kept) when 'has_tag' then 2 * n when 'has_child' then (select count(*) from kept where id like '%.%') when 'links_to' then (select count(*) from kept where id like '%.%') when 'vectors' then 2 * n when 'chunk' then 2 * n else n end as n from n, (values ('note'), ('chunk'), ('heading'), ('tag'), ('has_tag'), ('has_child'), ('links_to'), ('vectors')) v(name)")
def built_tables(spark, d):
    second = built_twice(spark, d)[1]
    return _counts([*((n, getattr(second.vault, n)) for n in ("note", "chunk", "heading", "tag", "has_tag", "has_child", "links_to")), ("vectors", second.vectors)])


@query("o14_meta", "select 'star' as vault, 'hash:8' as embedder, (5 + 25 - (select count(*) from nation where n_nationkey % 3 = 1))::bigint as notes")
def meta(spark, d):
    m = built_twice(spark, d)[1].meta
    return spark.createDataFrame([(m.vault, m.embedder[0], m.notes)], "vault string, embedder string, notes long")


@query("o63_staleness", "select * from (values ('fresh', ''), ('drift', 'max_chunk_chars changed'), ('embedder', 'embedder changed'), ('embedder, fts', ''), ('fts only', ''), ('changed', 'changed: a'), ('none', 'no index')) v(name, reasons)")
def staleness(spark, d):
    m = lambda most=2000, e="e": build.Meta("v", "heading", most, [e, 8] if e else None)
    cases = {"fresh": (m(), m(), [], "hybrid"), "drift": (m(), m(1000), [], "fts"), "embedder": (m(), m(e="f"), [], "hybrid"), "embedder, fts": (m(), m(e="f"), [], "fts"), "fts only": (m(e=None), m(), [], "hybrid"), "changed": (m(), m(), ["changed: a"], "fts"), "none": (None, m(), [], "fts")}
    return spark.createDataFrame([(k, ", ".join(build.stale(*v))) for k, v in cases.items()], "name string, reasons string")


@query("o88_rebuild_decision", "select * from (values ('same', false), ('forced', true), ('no index', true), ('chunks', true), ('embedder', true), ('vectors now', true)) v(name, needed)")
def rebuild(spark, d):
    m = lambda most=2000, e="e": build.Meta("v", "heading", most, [e, 8] if e else None)
    cases = {"same": (m(), m()), "forced": (m(), m(), True), "no index": (None, m()), "chunks": (m(), m(1000)), "embedder": (m(), m(e="f")), "vectors now": (m(e=None), m())}
    return spark.createDataFrame([(k, build.needs_full(*v)) for k, v in cases.items()], "name string, needed boolean")


# ---- rules and symbols

@query("o58_check", f"with {STAR}, day as (select id, case when id like 'p%' then 1 else 0 end as part from star) select 4 as seq, 'r9.n9' as note_id, '[r9.n9] missing ancestor \"r9.md\" in the hierarchy' as message union all select 6, 'r9.n9', '[r9.n9] wikilink \"[[nowhere]]\" points at unknown note \"nowhere\"' union all select 8, 'r9.n9', '[r9.n9] freshness expired ' || date_diff('day', date '1990-01-11', date '2000-01-01') || ' day(s) ago' union all select 1, 'zz', '[zz] frontmatter.owner must not be empty' union all select 2, 'zz', '[zz] frontmatter.id \"other\" does not match filename id \"zz\"'")
def check(spark, d):
    """All rules on the whole vault, with two notes that break some."""
    one = spark.range(1)
    bad = note(one, id=F.lit("r9.n9"), title=F.lit("T"), desc=F.lit("D"), body=F.lit("# T\n\n[[nowhere]]\n"), last_verified=F.lit("1990-01-01"), ttl_days=F.lit(10))
    worse = note(one, id=F.lit("zz"), title=F.lit("T"), desc=F.lit("D"), body=F.lit("# T\n"), owner=F.lit(""), fm_id=F.lit("other"))
    return build.check(written_notes(spark, d).unionByName(bad).unionByName(worse), no_schemas(spark), AS_OF).select("seq", "note_id", "message")


@query("o74_root", f"with {STAR} select 'root' as note_id, 'vault is missing required `root.md`' as message where not exists (select 1 from star where id = 'nothing')")
def root(spark, d):
    return rules.missing_root(star_notes(spark, d).where("id <> 'root'")).select("note_id", "message")


OUTCOMES = "case when p_size % 5 = 0 then 'escapes' when p_size % 5 = 1 then 'unsupported' when p_size % 5 = 2 then 'missing' when p_size % 5 = 3 then 'not found' else 'resolved' end"


def asked(spark: SparkSession, d: str) -> DataFrame:
    """A reference of every part to a symbol of its own, most of them wrong in one way or another."""
    k = F.col("p_size") % 5
    file = F.when(k == 0, "a/../../b.ts").when(k == 1, "c.py").when(k == 2, "gone.ts").otherwise("here.TS")
    known = table(spark, d, "part").where(k == 4).select(F.lit("here.TS").alias("file"), F.concat(F.lit("s"), "p_partkey").alias("symbol"), F.lit("const").alias("kind"), F.array(F.lit("value")).alias("namespaces"), F.lit(1).alias("line"), F.lit(1).alias("column"))
    rows = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("note_id"), F.lit(0).alias("pos"), file.alias("file"), F.concat(F.lit("s"), "p_partkey").alias("symbol"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("namespace"))
    return symbols.resolve(rows, known, spark.createDataFrame([("here.TS",)], "file string"))


@query("o22_path_predicates", f"select 'p' || p_partkey as note_id, {OUTCOMES} as outcome from part")
def path_predicates(spark, d):
    return asked(spark, d).select("note_id", "outcome")


@query("o81_code_refs", "select 'p' || p_partkey as note_id, '[p' || p_partkey || '] code_ref ' || case p_size % 5 when 0 then 'a/../../b.ts' when 1 then 'c.py' when 2 then 'gone.ts' else 'here.TS' end || ':s' || p_partkey || ' ' || case p_size % 5 when 0 then 'is outside the repository' when 1 then 'has an unsupported extension' when 2 then 'does not exist' else 'has no such symbol' end as message from part where p_size % 5 <> 4")
def code_refs(spark, d):
    return symbols.code_ref_errors(asked(spark, d)).select("note_id", "message")


@query("o35_code_edges", "select 'p' || p_partkey as note_id, 'here.TS:s' || p_partkey as symbol_id, 'const' as kind from part where p_size % 5 = 4")
def code_edges(spark, d):
    declared, known = symbols.edges(asked(spark, d))
    return declared.join(known.select(F.col("id").alias("symbol_id"), "kind"), "symbol_id").select("note_id", "symbol_id", "kind")


@query("o13_code_refs_file", "select 'p' || p_partkey as note_id, 'here.TS' as file, 's' || p_partkey as symbol, (row_number() over (order by 'p' || p_partkey))::bigint as pos from part where p_size % 5 = 4")
def code_refs_file(spark, d):
    rows = symbols.sidecar(asked(spark, d)).select("note_id", "file", "symbol")
    return rows.withColumn("pos", F.row_number().over(Window.orderBy("note_id", "file", "symbol")).cast("long"))


@query("o101_kinds", "select p_brand, min(case when p_size % 3 = 0 then 'function' when p_size % 3 = 1 then 'interface' else 'export' end) filter (true) is not null as any_, case when count(*) filter (p_size % 3 = 0) > 0 then 'function' when count(*) filter (p_size % 3 = 1) > 0 then 'interface' else 'export' end as kind from part group by p_brand")
def kinds(spark, d):
    """One symbol a brand, declared once for each part and of one candidate: the first kind counts."""
    k = F.col("p_size") % 3
    known = table(spark, d, "part").select(F.lit("x.ts").alias("file"), F.col("p_brand").alias("symbol"), F.when(k == 0, "function").when(k == 1, "interface").otherwise("export").alias("kind"), F.array(F.lit("value")).alias("namespaces"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.col("p_brand").alias("symbol_key"))
    rows = table(spark, d, "part").select("p_brand").distinct().select(F.col("p_brand").alias("note_id"), F.lit(0).alias("pos"), F.lit("x.ts").alias("file"), F.col("p_brand").alias("symbol"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("namespace"))
    return symbols.resolve(rows, known).select(F.col("note_id").alias("p_brand"), F.lit(True).alias("any_"), F.col("resolved_kind").alias("kind"))


@query("o34_schema_children", f"with {STAR} select 'r' || n_regionkey as schema_id, 'r' || n_regionkey || '.n' || n_nationkey as child_id from nation union all select 'root', 'r' || r_regionkey from region")
def schema_children(spark, d):
    kids = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_append(F.collect_list(F.concat(F.lit("n"), "n_nationkey")), F.lit("nobody")).alias("children"))
    top = F.concat(F.lit("r"), "n_regionkey")
    docs = kids.select(top.alias("top"), F.array(F.struct(top.alias("id"), top.alias("title"), "children", F.lit(False).alias("namespace"))).alias("schemas"))
    roots = table(spark, d, "region").agg(F.collect_list(F.concat(F.lit("r"), "r_regionkey")).alias("children")).select(F.lit("root").alias("top"), F.array(F.struct(F.lit("root").alias("id"), F.lit("root").alias("title"), "children", F.lit(False).alias("namespace"))).alias("schemas"))
    return extract.schema_children(docs.union(roots), star_notes(spark, d).select("id"))


@query("o100_normal_list", "select c_custkey, c_mktsegment || '|' || c_name as items from customer")
def normal(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.array_join(normal_list(F.array(F.concat(F.lit(" "), "c_mktsegment", F.lit("\t")), F.lit("  "), "c_name", F.lit(""))), "|").alias("items"))


@query("o29_search_text", r"select 'd' || doc_id as note_id, 'd' || doc_id || '#part' as part, regexp_replace(source || chr(10) || lang || chr(10) || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s*\n+\s*', ' ', 'g') as search_text from documents where length(regexp_replace(text, '^\s+|\s+$', '', 'g')) between 1 and 2000")
def search_texts(spark, d):
    """Of the notes of one chunk, all documents that aren't split."""
    rows = extract.chunks(text_notes(spark, d)).where("id = note_id").where(F.length("text") > F.length(F.concat_ws("\n", F.lit(""))))
    one = table(spark, d, "documents").where(F.regexp_replace("text", r"^\s+|\s+$", "") != "").select(F.concat(F.lit("d"), "doc_id").alias("note_id"))
    return rows.join(one, "note_id", "left_semi").select("note_id", F.concat("note_id", F.lit("#part")).alias("part"), "search_text")


# ---- search through the functions that a user calls

WORDS = "the public of river and"


@once
def written_search(spark: SparkSession, d: str) -> tuple[Vault, search.TextIndex, str]:
    """All documents as notes, with tags and audiences, compiled, indexed and written."""
    notes = text_notes(spark, d).withColumns({"tags": F.array("desc"), "audience": F.array("title"), "status": F.when(F.length("body") % 3 == 0, "draft").otherwise("active")})
    v, to = build.compile_vault(notes, no_schemas(spark), strategy="whole-note", most=1 << 30), place(spark)
    v.write(to)
    v = Vault.read(spark, to)
    search.TextIndex.of(v.chunk).write(to)
    return v, search.TextIndex.read(spark, to), to


PUBLIC = r"""found as (select doc_id, 'd' || doc_id as id, source, lang, text, case when length(text) % 3 = 0 then 'draft' else 'active' end as status,
  list_filter(regexp_split_to_array(lower(regexp_replace(source || chr(10) || lang || chr(10) || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s*\n+\s*', ' ', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
size as (select count(*) as n, avg(len(w)) as mean from found),
post as (select id, term, length, count(*) as tf from (select id, len(w) as length, unnest(w) as term from found) group by all),
freq as (select term, count(*) as df from post group by term),
scored as (select id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as score from post join freq using (term), size where term in ('the', 'public', 'of', 'river', 'and') group by id)"""


@query("o18_hits", f"with {PUBLIC} select id, id as note_id, '' as heading_path, source as title, status, round(score, 6) as score from scored join found using (id) order by scored.score desc, id limit 20")
def hits(spark, d):
    """search() on a written index; the 20 best are what is asked for."""
    v, index, _ = written_search(spark, d)
    return search.search(v, index, WORDS, "fts", 20).select("id", "note_id", "heading_path", "title", "status", F.round("score", 6).alias("score"))


@query("o42_filtered_hits", f"with {PUBLIC} select id, title, round(score, 6) as score from (select id, source as title, scored.score from scored join found using (id) where status = 'active' and lang in ('en', 'de') and source in ('src1', 'src2', 'src3') order by scored.score desc, id limit 15)")
def filtered_hits(spark, d):
    """Filters come before the limit."""
    v, index, _ = written_search(spark, d)
    return search.search(v, index, WORDS, "fts", 15, status="active", tags=["en", "de"], audience=["src1", "src2", "src3"]).select("id", "title", F.round("score", 6).alias("score"))


@query("o17_rendered_hits", f"with {PUBLIC} select printf('%.4f', score) || chr(9) || id || chr(9) || source || chr(9) as line from (select id, source, scored.score from scored join found using (id) order by scored.score desc, id limit 10)")
def rendered(spark, d):
    v, index, _ = written_search(spark, d)
    return sidecars.rendered_hits(search.search(v, index, WORDS, "fts", 10))


ASKED = "one as (select embedding::double[] as q from embeddings order by vec_id limit 1), near as (select 'd' || vec_id as id, round(list_cosine_distance(embedding::double[], q), 9) + 0.0 as distance from embeddings, one)"


def chunk_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    rows = vectors(spark, d).select(F.concat(F.lit("d"), "id").alias("id"), "embedding")
    return rows, list(table(spark, d, "embeddings").orderBy("vec_id").first().embedding)


@query("o40_vector_hits", f"with {ASKED}, top as (select * from near order by distance, id limit 50) select id, round(1 - distance, 5) as score from top where distance <= 0.6 and exists (select 1 from documents where 'd' || doc_id = top.id) order by distance, top.id limit 10")
def vector_hits(spark, d):
    """search() by vector: the nearest 50 chunks, within the radius, to notes."""
    v, index, _ = written_search(spark, d)
    rows, asked = chunk_vectors(spark, d)
    return search.search(v, index, "", "vector", 10, rows, _Given(asked)).select("id", F.round("score", 5).alias("score"))


class _Given:
    """An embedder that gives one vector for every query."""

    id = "given"

    def __init__(self, vector: list[float]):
        self.vector, self.dimensions = vector, len(vector)

    def embed_query(self, text: str) -> list[float]:
        return self.vector


@query("o62_hybrid_hits", f"with {PUBLIC}, {ASKED}, t as (select id, row_number() over (order by score desc, id) as rank from scored), top as (select * from near order by distance, id limit 250), v as (select id, row_number() over (order by distance, id) as rank from top where distance <= 0.6), both_ as (select * from t where rank <= 50 union all select * from v where rank <= 50), sums as (select id, sum(1.0::double / (60 + rank)) as score from both_ group by id), best as (select * from sums order by score desc, id limit 10) select best.id, round(best.score, 9) as score from best join found using (id)")
def hybrid_hits(spark, d):
    v, index, _ = written_search(spark, d)
    rows, asked = chunk_vectors(spark, d)
    return search.search(v, index, WORDS, "hybrid", 10, rows, _Given(asked)).select("id", F.round("score", 9).alias("score"))


@query("o47_fused", "with a as (select p_partkey as id, row_number() over (order by p_retailprice desc, p_partkey) as rank from part where p_size % 2 = 0), b as (select p_partkey as id, row_number() over (order by p_size desc, p_partkey) as rank from part where p_partkey % 3 = 0) select id, round(sum(1.0::double / (60 + rank)), 9) as score from (select * from a union all select * from b) group by id")
def fused(spark, d):
    part = table(spark, d, "part")
    a = part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    b = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"))
    return search.fused(a, b).select("id", F.round("score", 9).alias("score"))


@query("o96_cosine", "select a.vec_id, round(list_cosine_distance(a.embedding::double[], b.q), 7) + 0.0 as distance from embeddings a, (select embedding::double[] as q from embeddings order by vec_id limit 1) b")
def cosine(spark, d):
    asked = F.array(*(F.lit(float(x)) for x in chunk_vectors(spark, d)[1]))
    return table(spark, d, "embeddings").select("vec_id", (F.round(cosine_distance(F.col("embedding"), asked), 7) + 0.0).alias("distance"))


@query("o60_vector_cells", "with near as (select a.vec_id as query, b.vec_id as id, round(list_cosine_distance(a.embedding::double[], b.embedding::double[]), 9) + 0.0 as distance from embeddings a, embeddings b where a.vec_id % 50 = 0) select query, id, round(distance, 6) as distance from (select *, row_number() over (partition by query order by distance, id) as rank from near) where rank <= 10")
def vector_cells(spark, d):
    """The index by cells, asked for every vector whose id is divisible by 50; with all cells probed it must find what a scan does."""
    v = vectors(spark, d)
    index = search.VectorIndex.fitted(v, 16)
    found = index.top_all(v.where("id % 50 = 0"), 10, 16)
    return found.select("query", "id", F.round("distance", 6).alias("distance"))


# ---- graph

@query("o64_limited", f"with {STAR} select source as id from links where target = 'p7' order by source limit 3")
def limits(spark, d):
    return graph.backlinks(built_vault(spark, d), "p7", 3).select("id")


@query("o73_dispatch", f"with {STAR} select 'descendants' as command, count(*) as n from star where id like 'r1.%' union all select 'orphans', (select count(*) from star s where id <> 'root' and not exists (select 1 from links where source = s.id or target = s.id)) union all select 'backlinks', (select count(*) from links where target = 'p7')")
def dispatch(spark, d):
    v = built_vault(spark, d)
    return _counts([("descendants", graph.run_graph(v, "descendants", "r1")), ("orphans", graph.run_graph(v, "orphans")), ("backlinks", graph.run_graph(v, "backlinks", "p7"))]).withColumnRenamed("name", "command")


@query("o21_requests", "select 'p' || p_partkey as note_id, 0 as pos, p_brand || '.ts' as file, p_name as symbol from part")
def requests(spark, d):
    return symbols.requests(star_notes(spark, d)).select("note_id", "pos", "file", "symbol")


@query("o23_checked_limits", "select * from (values ('none', true), ('1', true), ('0', false), ('-1', false)) v(given, fine)")
def checked_limits(spark, d):
    def fine(n: int | None) -> bool:
        try:
            limited(spark.range(3), n)
            return True
        except ValueError:
            return False

    return spark.createDataFrame([("none" if n is None else str(n), fine(n)) for n in (None, 1, 0, -1)], "given string, fine boolean")


@query("o91_refinement_states", "select 'e' || event_id as id, case when event_type < 'q' then 2 else 0 end as evidence from events")
def refinement_states(spark, d):
    rows = table(spark, d, "events").select(F.concat(F.lit("e"), "event_id").alias("id"), F.when(F.col("event_type") < "q", F.array(F.lit(" a "), F.lit(""), F.lit("b"))).alias("evidence"), F.lit(None).cast("array<string>").alias("related_notes"))
    return lifecycle.staged(rows).select("id", F.size("evidence").alias("evidence"))
