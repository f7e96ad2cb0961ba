"""Retrieval benchmarks: documents and queries as JSON lines, judgements as tab-separated values with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc, title, text)"""
    return spark.read.schema("_id string, title string, text string").json(path).select(F.col("_id").alias("doc"), "title", "text")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query, text)"""
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("query"), "text")


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc, gain); lines whose score is no number, such as the header, are left out."""
    rows = spark.read.option("sep", "\t").schema("query string, doc string, gain string").csv(path)
    return rows.withColumn("gain", F.col("gain").try_cast("double")).where("gain is not null")
