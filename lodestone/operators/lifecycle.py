"""Content hashes, their reconciliation, removal of what no note uses, and states of refinements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, normal_list


def hashes(notes: DataFrame) -> DataFrame:
    """(id, hash) over front matter and body. Notes of equal content have equal hashes in every run."""
    front = F.to_json(F.struct(*(c for c in notes.columns if c not in ("body", "file", "fm_errors"))))
    return notes.select("id", content_hash(front, F.coalesce("body", F.lit(""))).alias("hash"))


def reconcile(new: DataFrame, old: DataFrame) -> DataFrame:
    """(id, change): added, changed, removed or same, for every id of either."""
    rows = new.select("id", F.col("hash").alias("now")).join(old.select("id", F.col("hash").alias("was")), "id", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "changed").otherwise("same")
    return rows.select("id", change.alias("change"))


def without_notes(table: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """table less the rows of these notes."""
    return table.join(ids.select(F.col("id").alias(column)), column, "left_anti")


def collected(nodes: DataFrame, key: str, edges: DataFrame, column: str) -> DataFrame:
    """The nodes that an edge still refers to."""
    return nodes.join(edges.select(F.col(column).alias(key)), key, "left_semi")


def staged(records: DataFrame) -> DataFrame:
    """Records with their lists stripped of white space and empty items."""
    return records.withColumns({c: normal_list(F.coalesce(c, F.array().cast("array<string>"))) for c in ("evidence", "related_notes")})


def listed(records: DataFrame, status: str = "all") -> DataFrame:
    rows = records if status == "all" else records.where(F.col("status") == status)
    return rows.orderBy("created_at", "id")
