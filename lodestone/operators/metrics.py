"""Retrieval quality: nDCG@10, recall@100 and MRR@10, means over judged queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_note(hits: DataFrame) -> DataFrame:
    """(query, doc, rank) from hits (query, doc, rank): a document's first hit counts, and ranks close up."""
    first = hits.groupBy("query", "doc").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank", "doc")).cast("long"))


def per_query(ranked: DataFrame, judged: DataFrame, ndcg_at: int = 10, recall_at: int = 100, mrr_at: int = 10) -> DataFrame:
    """(query, ndcg, recall, mrr) for the queries of judged (query, doc, gain); recall is null where nothing is relevant."""
    gain = lambda at: F.col("gain") / F.log2(at + 1)
    ideal = judged.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("gain"))))
    ideal = ideal.groupBy("query").agg(F.sum(F.when(F.col("place") <= ndcg_at, gain(F.col("place")))).alias("best"), F.sum((F.col("gain") > 0).cast("long")).alias("relevant"))
    hits = ranked.join(judged, ["query", "doc"]).groupBy("query").agg(
        F.sum(F.when(F.col("rank") <= ndcg_at, gain(F.col("rank")))).alias("dcg"),
        F.sum(F.when((F.col("rank") <= recall_at) & (F.col("gain") > 0), 1)).alias("found"),
        F.min(F.when((F.col("rank") <= mrr_at) & (F.col("gain") > 0), F.col("rank"))).alias("first"),
    )
    rows = ideal.join(hits, "query", "left")
    return rows.select("query", F.when(F.col("best") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("best")).otherwise(0.0).alias("ndcg"), (F.coalesce("found", F.lit(0)) / F.nullif("relevant", F.lit(0))).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def means(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """(queries, ndcg, recall, mrr); recall's mean leaves out queries without a relevant document."""
    return per_query(ranked, judged).agg(F.count("*").alias("queries"), F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"))
