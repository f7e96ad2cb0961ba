"""Graph queries over a compiled vault. Each returns a DataFrame in a defined order; limits and depths are checked first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import depth, upto
from ..model import Vault, limited, positive
from ..sources import storage
from .components import joined_components


def _into(v: Vault) -> DataFrame:
    """Links, best read by target."""
    return v.links_to if v.linked_from is None else v.linked_from


def backlinks(v: Vault, note: str, limit: int | None = None) -> DataFrame:
    """(id, title, anchor, status) of the notes that link here, a row for each link."""
    rows = _into(v).where(F.col("target") == note).select(F.col("source").alias("id"), "anchor")
    return limited(rows.join(v.note.select("id", "title", "status"), "id").select("id", "title", "anchor", "status").orderBy("id", F.col("anchor").asc_nulls_first()), limit)


def forward_links(v: Vault, note: str, limit: int | None = None) -> DataFrame:
    """(id, title, anchor, status) of the notes linked from here, a row for each link."""
    rows = v.links_to.where(F.col("source") == note).select(F.col("target").alias("id"), "anchor")
    return limited(rows.join(v.note.select("id", "title", "status"), "id").select("id", "title", "anchor", "status").orderBy("id", F.col("anchor").asc_nulls_first()), limit)


def _prefixes(rows: DataFrame, low: int, high) -> DataFrame:
    return rows.select("id", F.explode(F.sequence(F.lit(low), high)).alias("i")).select("id", upto(F.col("id"), F.col("i")).alias("up"))


def descendants(v: Vault, note: str, depth_limit: int | None = None) -> DataFrame:
    """(id, title, depth, status) under a note, by depth and id. A path holds if every note on it exists, so ids' prefixes tell; no recursion."""
    positive(depth_limit, "depth")
    dots = note.count(".")
    under = v.note.where(F.col("id").startswith(note + ".")).withColumn("depth", depth(F.col("id")) - dots)
    if depth_limit is not None:
        under = under.where(F.col("depth") <= depth_limit)
    ups = _prefixes(under, dots + 1, F.size(F.split("id", r"\.")) - 1)
    broken = ups.join(v.note.select(F.col("id").alias("up")), "up", "left_anti").select("id").distinct()
    return under.join(broken, "id", "left_anti").select("id", "title", F.col("depth").cast("long").alias("depth"), "status").orderBy("depth", "id")


def ancestors(v: Vault, note: str, depth_limit: int | None = None) -> DataFrame:
    """(id, title, depth, status) over a note, the nearest first, as far as none is missing."""
    positive(depth_limit, "depth")
    parts = note.split(".")
    ids = [".".join(parts[:i]) for i in range(1, len(parts))]
    here = v.note.where(F.col("id") == note).select(F.lit(1).alias("here"))
    rows = v.note.where(F.col("id").isin(ids) if ids else F.lit(False)).withColumn("depth", (F.lit(len(parts) - 1) - depth(F.col("id"))).cast("long"))
    rows = rows.withColumn("n", F.row_number().over(Window.orderBy("depth"))).where("n = depth").join(F.broadcast(here.limit(1)))
    if depth_limit is not None:
        rows = rows.where(F.col("depth") <= depth_limit)
    return rows.select("id", "title", "depth", "status").orderBy("depth", "id")


def orphans(v: Vault, limit: int | None = None) -> DataFrame:
    """(id, title, status) of notes, but root, without any link or code reference."""
    rows = v.note.where("id <> 'root'")
    for used, column in ((v.links_to, "source"), (v.links_to, "target"), (v.declares, "note_id")):
        rows = rows.join(used.select(F.col(column).alias("id")), "id", "left_anti")
    return limited(rows.select("id", "title", "status").orderBy("id"), limit)


def related(v: Vault, note: str, limit: int | None = None) -> DataFrame:
    """(id, title, shared_tags, common_backlinks): notes that share tags, or are linked from the same notes; most first."""
    mine = v.has_tag.where(F.col("note_id") == note).select("tag")
    tags = v.has_tag.where(F.col("note_id") != note).join(mine, "tag").groupBy(F.col("note_id").alias("id")).agg(F.sort_array(F.collect_list("tag")).alias("shared_tags"))
    sources = _into(v).where(F.col("target") == note).select("source").distinct()
    cited = v.links_to.where(F.col("target") != note).join(sources, "source").groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("common_backlinks"))
    rows = tags.join(cited, "id", "full_outer").join(v.note.select("id", "title"), "id")
    rows = rows.select("id", "title", F.coalesce("shared_tags", F.array().cast("array<string>")).alias("shared_tags"), F.coalesce("common_backlinks", F.lit(0)).cast("long").alias("common_backlinks"))
    return limited(rows.orderBy(F.size("shared_tags").desc(), F.desc("common_backlinks"), "id"), limit)


def code_impact(v: Vault, file: str | None = None, symbol: str | None = None) -> DataFrame:
    """(note_id, title, file, symbol, kind) of the notes that refer to a file or symbol."""
    rows = v.symbol
    for column, value in (("file", file), ("symbol", symbol)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    rows = rows.withColumnRenamed("id", "symbol_id").join(v.declares, "symbol_id").join(v.note.select(F.col("id").alias("note_id"), "title"), "note_id")
    return rows.select("note_id", "title", "file", "symbol", "kind").orderBy("note_id", "file", "symbol")


def find_cycles(edges: dict[str, list[str]]) -> list[list[str]]:
    """Paths, closed, of the cycles that back edges of a depth-first search in id order show; each in its least rotation."""
    colour: dict[str, bool] = {}
    found: dict[str, list[str]] = {}
    for root in sorted(edges):
        if root in colour:
            continue
        path, at = [root], {root: 0}
        colour[root] = True
        todo = [iter(sorted(edges[root]))]
        while todo:
            target = next(todo[-1], None)
            if target is None:
                todo.pop()
                done = path.pop()
                del at[done]
                colour[done] = False
            elif target in at:
                cycle = path[at[target] :]
                best = min((cycle[i:] + cycle[:i] for i in range(len(cycle))), key=" ".join)
                found.setdefault(" ".join(best), [*best, best[0]])
            elif target not in colour:
                colour[target] = True
                at[target] = len(path)
                path.append(target)
                todo.append(iter(sorted(edges.get(target, []))))
    return sorted(found.values(), key="".join)


def trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Edges less those into notes that lead nowhere; in each round what the one before left so goes too."""
    for _ in range(rounds):
        edges = edges.join(edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
    return edges.select("source", "target")


def _cycles_of(batches: Iterator[pa.RecordBatch], at_once: int = 1000) -> Iterator[pa.RecordBatch]:
    """(key, path) from edges (root, source, target) that come root by root; no more than one root's are held."""
    edges: dict[str, list[str]] = {}
    now, paths = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(["".join(p) for p in paths], pa.string()), pa.array(paths, pa.list_(pa.string()))], ["key", "path"])

    for rows in batches:
        for root, a, b in zip(*(rows.column(c).to_pylist() for c in ("root", "source", "target"))):
            if root != now:
                paths += find_cycles(edges)
                now, edges = root, {}
                if len(paths) >= at_once:
                    yield out()
                    paths = []
            edges.setdefault(a, []).append(b)
    paths += find_cycles(edges)
    if paths:
        yield out()


def cycles(v: Vault, limit: int | None = None) -> DataFrame:
    """(pos, path). Which cycles a depth-first search shows depends on where it enters and on the order of all that leads to them, so the edges of a connected part of the graph go through one task; parts don't tell on each other.

    Edges into notes that lead nowhere are trimmed across the cluster first: a search that goes there comes back with
    nothing done, so the result is the same. What leads to a cycle stays, because it decides where the search enters.
    """
    positive(limit, "limit")
    spark, links = v.links_to.sparkSession, v.links_to.select("source", "target")
    ws = storage.Tables(spark, "cycles")
    try:
        edges = ws.table(links.distinct())
        left = edges.count()
        for _ in range(3):
            edges, before = ws.table(trimmed(edges, 1)), left
            left = edges.count()
            if left in (0, before):
                break
        # Parts of all links, not of those that are left: as they come, most lie beside those that they belong with.
        parts = joined_components(ws, links.select(F.col("source").alias("a"), F.col("target").alias("b")) if left else edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
        rows = edges.join(parts.select(F.col("node").alias("source"), "root"), "source").select("root", "source", "target")
        found = ws.table(rows.repartition("root").sortWithinPartitions("root").mapInArrow(_cycles_of, "key string, path array<string>"))
        placed = found.repartitionByRange("key").sortWithinPartitions("key").select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i"), "path")
        placed = ws.keep(placed)
    finally:
        ws.close()
    begin, offsets = 0, []
    for r in placed.groupBy("part").count().orderBy("part").collect():
        offsets.append((r.part, begin))
        begin += r["count"]
    offsets = spark.createDataFrame(offsets, "part int, begin long")
    return limited(placed.join(F.broadcast(offsets), "part").select((F.col("begin") + F.col("i")).alias("pos"), "path").orderBy("pos"), limit)


def run_graph(v: Vault, command: str, note: str | None = None, **options: object) -> DataFrame:
    """A query by its name; those about a note need one, impact needs a file or symbol."""
    scoped = {"backlinks": backlinks, "links": forward_links, "descendants": descendants, "ancestors": ancestors, "related": related}
    if command in scoped:
        if not note:
            raise ValueError(f"{command} requires a note id")
        return scoped[command](v, note, **options)
    if command == "impact":
        if not options.get("file") and not options.get("symbol"):
            raise ValueError("impact requires a file or a symbol")
        return code_impact(v, **options)
    if command in ("orphans", "cycles"):
        return {"orphans": orphans, "cycles": cycles}[command](v, **options)
    raise ValueError(f"unknown graph command: {command}")
