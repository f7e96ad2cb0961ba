"""The listing of a vault by its hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import depth


def hierarchy_lines(notes: DataFrame) -> DataFrame:
    """(id, line), root first and then by id; indented by depth, the status shown unless active."""
    n = F.when(F.col("id") == "root", 0).otherwise(depth(F.col("id")))
    status = F.when(F.col("status") == "active", "").otherwise(F.concat(F.lit(" ("), "status", F.lit(")")))
    line = F.concat(F.repeat(F.lit("  "), n), F.lit("- **"), "id", F.lit("**"), status, F.lit(" - "), "title", F.lit(". "), "desc")
    return notes.select("id", line.alias("line")).orderBy(F.col("id") != "root", "id")


def rendered_hits(hits: DataFrame) -> DataFrame:
    """A line for each hit: score to four places, note, title and heading path, with tabs between."""
    return hits.select(F.format_string("%.4f\t%s\t%s\t%s", "score", "note_id", "title", "heading_path").alias("line"))
