"""Retrieval quality of search on a judged collection: all queries of a mode in one job, lists of notes, means of the metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import NOTE
from ..operators import extract, metrics, search


def notes_of(corpus: DataFrame) -> DataFrame:
    """A note for each document (doc, title, text)."""
    given = {"id": F.col("doc"), "title": F.coalesce("title", F.lit("")), "desc": F.lit(""), "body": F.col("text"), "file": F.concat("doc", F.lit(".md")), "fm_id": F.col("doc"), "status": F.lit("active")}
    types = dict(x.split(" ", 1) for x in NOTE.replace(", ", "\n").split("\n"))
    return corpus.select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()))


def best(scores: DataFrame, most: int) -> DataFrame:
    """(query, id, rank) of the most best of each query, from (query, id, score)."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", place).where(F.col("rank") <= most).select("query", "id", "rank")


def vector_scores(spark: SparkSession, vectors: DataFrame, queries: DataFrame, embedder: search.Embedder, most: int) -> DataFrame:
    """(query, id, score) of the nearest chunks within the radius. Queries are embedded on the driver, one by one as a user's are."""
    asked = queries.collect()
    rows = spark.createDataFrame([(i, q.query, [float(x) for x in embedder.embed_query(q.text)]) for i, q in enumerate(asked)], "n long, query string, v array<float>")
    keyed = vectors.withColumn("key", F.xxhash64("id"))
    near = search.nearest_all(keyed, rows, most, id="key", vector="embedding", asked=("n", "v")).where(F.col("distance") <= search.RADIUS)
    return near.join(rows.select(F.col("n").alias("query"), F.col("query").alias("name")), "query").join(keyed.select(F.col("key").alias("key"), F.col("id").alias("chunk")), F.col("id") == F.col("key")).select(F.col("name").alias("query"), F.col("chunk").alias("id"), (1 - F.col("distance")).alias("score"))


def evaluate(spark: SparkSession, path: str, corpus: DataFrame, queries: DataFrame, judged: DataFrame, embedder: search.Embedder | None = None, limit: int = 100, strategy: str = "heading", most: int = 2000) -> DataFrame:
    """(mode, queries, ndcg, recall, mrr) for full-text search, and with an embedder by vector and hybrid. path: a folder for the index.

    corpus: (doc, title, text); queries: (query, text); judged: (query, doc, gain). Only queries with a judgement are
    asked. A note's best chunk counts. Hybrid fuses lists of five times the limit, 25 at least, as search() does.
    """
    chunks = extract.chunks(notes_of(corpus), strategy, most).select("id", "note_id", "text", "search_text")
    chunks.write.mode("overwrite").parquet(f"{path}/chunk")
    chunks = spark.read.schema(chunks.schema).parquet(f"{path}/chunk")
    search.TextIndex.of(chunks).write(path)
    index = search.TextIndex.read(spark, path)
    queries = queries.join(judged.select("query").distinct(), "query", "left_semi")
    wide = max(5 * limit, 25)
    lists = {"fts": best(index.scores(queries), limit)}
    if embedder:
        search.embedded(chunks, embedder).select("id", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
        near = vector_scores(spark, spark.read.parquet(f"{path}/vectors"), queries, embedder, wide)
        lists["vector"] = best(near, limit)
        both = best(index.scores(queries), wide).unionByName(best(near, wide))
        lists["hybrid"] = best(both.groupBy("query", "id").agg(F.sum(1.0 / (search.RRF + F.col("rank"))).alias("score")), limit)
    out = None
    for mode, rows in lists.items():
        ranked = metrics.by_note(rows.join(chunks.select("id", F.col("note_id").alias("doc")), "id").select("query", "doc", "rank"))
        one = metrics.means(ranked, judged).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out.select("mode", "queries", "ndcg", "recall", "mrr")
