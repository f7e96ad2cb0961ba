"""Rows that every operator must stand: nulls, empty and long texts, repeated rows, extra columns whose names clash."""

import re

from pyspark.sql import functions as F

from lodestone.llm.base import SLICE_BYTES, WORD as PATTERN

WORD = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", PATTERN))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, "a text without an id that goes on for some words more", "en", "s1", 10),
    (1, None, "en", "s1", None),
    (2, "", None, None, 0),
    (3, "   \n\t ", "en", "s1", 6),
    (4, "One. Two!", "en", "s1", 9),
    (5, "the same row twice and a few words more to make it long enough", "en", "s2", 62),
    (5, "the same row twice and a few words more to make it long enough", "en", "s2", 62),
    (6, "long word " * (SLICE_BYTES // 8), "en", "s2", 10 * (SLICE_BYTES // 8)),
    (7, "été ÀÉÎ 漢字 😀 naïve “quoted” text", "fr", "s3", 30),
]
CLASH = ["id", "h", "c", "k", "s", "n", "tier", "shard", "bad", "_gone", "part", "text2", "words", "rule_id", "mix_source", "mix_cuts"]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def clashing(docs):
    return docs.withColumns({c: F.lit("x") for c in CLASH})


def lettered(docs, column="doc_id"):
    """The same rows with ids that aren't numbers."""
    return docs.withColumn(column, F.concat(F.lit("id-"), F.col(column)))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
