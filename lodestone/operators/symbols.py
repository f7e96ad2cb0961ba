"""References to code symbols: requests, path rules, resolution against a catalogue of declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rules import finding, text, with_validity

KINDS = ("function", "class", "const", "let", "var", "interface", "type", "enum", "namespace", "method", "property", "import", "export")
EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")


def requests(notes: DataFrame) -> DataFrame:
    """(note_id, pos, file, symbol, kind, namespace) of valid notes."""
    rows = with_validity(notes).where("valid").select(F.col("id").alias("note_id"), F.posexplode("code_refs").alias("pos", "r"))
    return rows.select("note_id", "pos", "r.file", "r.symbol", "r.kind", "r.namespace")


def resolve(asked: DataFrame, catalogue: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """asked with (outcome, resolved_kind, namespaces, line, column).

    outcome: "escapes" for a path out of the root, "unsupported" for an extension beyond the eight, "missing" for a file
    that isn't there, "not found", "ambiguous" or "resolved". files: (file); those of the catalogue if not given.
    Declarations of one symbol are one candidate (symbol_key, if the catalogue has it); of several kinds the first counts.
    """
    files = (catalogue if files is None else files).select("file").distinct().withColumn("there", F.lit(True))
    key = "symbol_key" if "symbol_key" in catalogue.columns else None
    known = catalogue.select("file", "symbol", F.col("kind").alias("k"), F.col("namespaces").alias("ns"), F.col("line").alias("l"), F.col("column").alias("c"), (F.col(key) if key else F.concat_ws("\x00", "kind", F.col("line").cast("string"), F.col("column").cast("string"))).alias("candidate"))
    # Alike declarations are one row, and alike references are looked up once, so that a symbol that is declared and asked for often isn't all pairs of these.
    known = known.groupBy("file", "symbol", "k", "ns").agg(F.min(F.struct("l", "c")).alias("at"), F.min("candidate").alias("low"), F.max("candidate").alias("high"))
    fits = (F.col("kind").isNull() | (F.col("kind") == F.col("k"))) & (F.col("namespace").isNull() | F.array_contains("ns", F.col("namespace")))
    order = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("k")), F.lit(0)), F.lit(len(KINDS) + 1))
    wanted = ["file", "symbol", "kind", "namespace"]
    hits = asked.select(*wanted).distinct().join(known, ["file", "symbol"]).where(fits)
    best = hits.groupBy(*wanted).agg(F.coalesce(F.min("low") != F.max("high"), F.lit(False)).alias("several"), F.min(F.struct(order.alias("o"), "at.l", "at.c", "k", "ns")).alias("b"))
    best = best.select(*(F.col(c).alias(f"asked_{c}") for c in wanted), "several", "b")
    rows = asked.join(files, "file", "left")
    rows = rows.join(best, (rows.file == best.asked_file) & (rows.symbol == best.asked_symbol) & rows.kind.eqNullSafe(best.asked_kind) & rows.namespace.eqNullSafe(best.asked_namespace), "left")
    escapes = F.col("file").startswith("/") | F.concat(F.lit("/"), "file", F.lit("/")).contains("/../")
    good = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)).isin(*EXTENSIONS)
    outcome = F.when(escapes, "escapes").when(~good, "unsupported").when(F.col("there").isNull(), "missing").when(F.col("several").isNull(), "not found").when(F.col("several"), "ambiguous").otherwise("resolved")
    done = outcome == "resolved"
    return rows.select(*asked.columns, outcome.alias("outcome"), F.when(done, F.coalesce("kind", "b.k")).alias("resolved_kind"), F.when(done, F.col("b.ns")).alias("namespaces"), F.when(done, F.col("b.l")).alias("line"), F.when(done, F.col("b.c")).alias("column"))


def code_ref_errors(resolved: DataFrame) -> DataFrame:
    says = {"escapes": "is outside the repository", "unsupported": "has an unsupported extension", "missing": "does not exist", "not found": "has no such symbol", "ambiguous": "has several such symbols"}
    what = F.coalesce(*(F.when(F.col("outcome") == k, F.lit(v)) for k, v in says.items()))
    return finding(resolved.where("outcome <> 'resolved'"), 7, "code_refs", text("[", F.col("note_id"), "] code_ref ", F.col("file"), ":", F.col("symbol"), " ", what), "note_id")


def edges(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(note_id, symbol_id) a row for each reference, and the symbols (id, file, symbol, kind); of several kinds asked for the last note's counts."""
    rows = resolved.where("outcome = 'resolved'").withColumn("symbol_id", F.concat("file", F.lit(":"), "symbol"))
    last = F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("note_id"), F.desc("pos")))
    symbols = rows.withColumn("n", last).where("n = 1").select(F.col("symbol_id").alias("id"), "file", "symbol", F.col("resolved_kind").alias("kind"))
    return rows.select("note_id", "symbol_id"), symbols


def sidecar(resolved: DataFrame) -> DataFrame:
    """Resolved references in the order of the file code-refs.json."""
    return resolved.where("outcome = 'resolved'").orderBy("note_id", "file", "symbol", F.col("kind").asc_nulls_first(), F.col("namespace").asc_nulls_first())
