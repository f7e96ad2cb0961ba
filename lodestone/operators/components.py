"""Connected components of an edge list by local forests and alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Tables(Protocol):
    """Where steps are written, which cuts lineage."""

    def table(self, df: DataFrame) -> DataFrame: ...


#: Edges that a task joins at once; so many fit in its memory at any size of the corpus.
CHUNK = 50_000


def forest(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect what edges do, a star for each group within a chunk of a partition."""
    kind = edges.select("a").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        held = 0

        def find(x):
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def stars() -> pa.RecordBatch:
            pairs = [(find(x), x) for x in list(parent)]
            pairs = [(a, b) for a, b in pairs if a != b]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], rows.column("a").type) for k in (0, 1)], ["a", "b"])

        for rows in batches:
            for a, b in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            held += rows.num_rows
            if held >= chunk:
                yield stars()
                parent, held = {}, 0
        if parent:
            yield stars()

    return edges.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def connected_components(ws: Tables, edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, root) for every node of edges (a, b), which may be of any type that sorts; root is the least node of its component. No edges give no rows.

    Tasks first join the edges that they read. Star steps then go on until the edges are stars; each replaces the edges
    by a table in the workspace, so the plan stays short and a lost executor costs one step. The number of steps grows
    with the logarithm of the longest chain.
    """

    def least(e: DataFrame) -> DataFrame:
        both = e.union(e.select("b", "a"))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        return both.join(low, both.a == low.n)

    def large(e: DataFrame) -> DataFrame:
        return least(e).where("b > a").select(F.col("m").alias("a"), "b").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("v"))
        low = down.groupBy(F.col("n").alias("k")).agg(F.min("v").alias("m"))
        return down.join(low, down.n == low.k).select(F.col("m").alias("a"), F.explode(F.array("v", "n")).alias("b")).where("a < b").distinct()

    def done(e: DataFrame) -> bool:
        """Whether each node hangs on one other at most, and on one that hangs on none."""
        ends = e.select(F.col("a").alias("n"), F.lit(0).alias("up")).union(e.select(F.col("b").alias("n"), F.lit(1).alias("up")))
        return ends.groupBy("n").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where("up > 1 or up = 1 and low = 0").isEmpty()

    edges = ws.table(forest(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b"), chunk).distinct())
    while not done(edges):
        edges = ws.table(small(large(edges)))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def joined_components(ws: Tables, edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """connected_components() of edges that mostly lie beside those that they belong with: star steps are taken on the centres of the first stars alone, and only on those that share a node."""
    stars = forest(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), chunk)
    nodes = stars.union(stars.select("a", F.col("a").alias("b"))).union(edges.where("a = b").select("a", "b"))
    nodes = ws.table(nodes.groupBy(F.col("b").alias("node")).agg(F.collect_set("a").alias("centres")).withColumn("m", F.array_min("centres")))
    shared = nodes.where(F.size("centres") > 1).select(F.col("m").alias("a"), F.explode("centres").alias("b"))
    roots = ws.table(connected_components(ws, shared.where("a < b"), chunk)).select(F.col("node").alias("m"), "root")
    return ws.table(nodes.select("node", "m").join(roots, "m", "left").select("node", F.coalesce("root", "m").alias("root")))
