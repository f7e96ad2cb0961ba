"""Full-text, vector and fused search over chunks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import cosine_distance
from ..model import Vault, positive
from ..sources import storage

K1, B, RRF = 1.2, 0.75, 60
#: Cosine distance beyond which a neighbour is no match.
RADIUS = 0.6
#: Terms of queries, each counted once a query, that are sent to every task.
FEW = 200_000
MODES = ("fts", "vector", "hybrid")


class Embedder(Protocol):
    id: str
    dimensions: int

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """A vector of character codes by position, at length 1: the same in every run, and no model at all."""

    dimensions: int = 8

    @property
    def id(self) -> str:
        return f"hash:{self.dimensions}"

    def embed_query(self, text: str) -> list[float]:
        v = [0.0] * self.dimensions
        for i, c in enumerate(text):
            v[i % self.dimensions] += ord(c)
        size = sum(x * x for x in v) ** 0.5
        return [x / size for x in v] if size else v

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]


def embedded(chunks: DataFrame, embedder: Embedder, batch: int = 32) -> DataFrame:
    """chunks with the column embedding. Within a task texts are taken in order of length, so that a batch has alike ones."""
    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        order = texts.str.len().sort_values().index
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            for k, v in zip(at, embedder.embed_documents(texts.loc[at].tolist())):
                out[k] = v
        return out

    return chunks.withColumn("embedding", vectors(F.coalesce("text", F.lit(""))))


@dataclass(frozen=True)
class TextIndex:
    """postings (term, id, tf, length), terms (term, df) and totals (n, mean): what BM25 needs. Written out in the order of terms, so that a query by literal terms reads only the row groups that may have them."""

    postings: DataFrame
    totals: DataFrame
    terms: DataFrame

    @classmethod
    def of(cls, chunks: DataFrame, text: str = "search_text", id: str = "id") -> "TextIndex":
        words = chunks.select(F.col(id).alias("id"), tokens(F.coalesce(text, F.lit(""))).alias("words")).withColumn("length", F.size("words"))
        totals = words.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
        # Counted within each row, so that a chunk's words meet nowhere else: in order, a word's count is the way to where the next one begins.
        starts = F.filter(F.sequence(F.lit(1), F.greatest("length", F.lit(1))), lambda i: (i == 1) | (F.element_at("words", i) != F.element_at("words", F.greatest(i - 1, F.lit(1)))))
        rows = words.withColumn("words", F.sort_array("words")).withColumn("starts", starts)
        ends = F.array_append(F.slice("starts", F.lit(2), F.size("starts")), F.col("length") + 1)
        tf = F.zip_with("starts", ends, lambda a, b: F.struct(F.element_at("words", a).alias("term"), (b - a).cast("long").alias("tf")))
        postings = rows.select("id", "length", F.explode(F.when(F.col("length") > 0, tf)).alias("x")).select("x.term", "id", "length", "x.tf")
        return cls(postings, totals, postings.groupBy("term").agg(F.count("*").alias("df")))

    def write(self, path: str, buckets: int = 64) -> None:
        # Made once, as texts are dear to read: the order by ranges reads its input twice, and the terms are counted from it.
        spark, made = self.postings.sparkSession, f"{path}/postings-made"
        self.postings.write.mode("overwrite").parquet(made)
        postings = spark.read.schema(self.postings.schema).parquet(made)
        # By id as well, so that a term of very many chunks is spread over files.
        postings.repartitionByRange(buckets, "term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
        postings.groupBy("term").agg(F.count("*").alias("df")).repartitionByRange(max(1, buckets // 8), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        self.totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
        storage.delete(spark, made)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "TextIndex":
        kind = spark.read.parquet(f"{path}/postings").schema["id"].dataType.simpleString()
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
        return cls(read("postings", f"term string, id {kind}, length int, tf long"), read("totals", "n long, mean double"), read("terms", "term string, df long"))

    def _scored(self, hits: DataFrame) -> DataFrame:
        """(query, id, score) of hits (query, id, tf, length, df)."""
        hits = hits.crossJoin(F.broadcast(self.totals))
        idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        return hits.groupBy("query", "id").agg(F.sum(part).alias("score"))

    def of_terms(self, words: Sequence[str]) -> DataFrame:
        """(query, id, score) of one query, its words given as literals that reach the scan; the few terms' frequencies are sent to every task."""
        some = F.col("term").isin(list(words)) if words else F.lit(False)
        return self._scored(self.postings.where(some).join(F.broadcast(self.terms.where(some)), "term").withColumn("query", F.lit(0)))

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query, id, score) for rows (query, text): BM25 of every chunk that has a term of the query; all queries in one job."""
        asked = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).join(self.terms, "term")
        if asked.limit(FEW + 1).count() > FEW:
            return self._scored(self.postings.join(asked, "term"))
        # A chunk's postings are exchanged before each meets the queries of its term, which are many more rows; sums need no exchange then.
        some = self.postings.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").repartition("id")
        return self._scored(some.join(F.broadcast(asked), "term"))


def words_of(text: str) -> list[str]:
    """The distinct tokens() of a string, in order."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", text.lower())))


def filtered(v: Vault, status: str | None = None, tags: Sequence[str] = (), audience: Sequence[str] = ()) -> DataFrame | None:
    """(note_id) that pass: the status, and any of the tags, and any of the audiences; None if nothing is asked."""
    if not (status or tags or audience):
        return None
    rows = v.note.select(F.col("id").alias("note_id"), "status")
    if status:
        rows = rows.where(F.col("status") == status)
    if tags:
        rows = rows.join(v.has_tag.where(F.col("tag").isin(list(tags))).select("note_id"), "note_id", "left_semi")
    if audience:
        rows = rows.join(v.has_audience.where(F.col("audience").isin(list(audience))).select("note_id"), "note_id", "left_semi")
    return rows.select("note_id")


def _kept(rows: DataFrame, chunk: DataFrame, passing: DataFrame | None) -> DataFrame:
    return rows if passing is None else rows.join(chunk.select("id", "note_id"), "id").join(passing, "note_id", "left_semi").drop("note_id")


def fts_top(v: Vault, index: TextIndex, query: str, limit: int, passing: DataFrame | None = None) -> DataFrame:
    """(id, score), the best first; filters come before the limit."""
    rows = _kept(index.of_terms(words_of(query)).select("id", "score"), v.chunk, passing)
    return rows.orderBy(F.desc("score"), "id").limit(limit)


def nearest(vectors: DataFrame, query: Column, id: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, distance) of every vector that has one."""
    return vectors.select(F.col(id).alias("id"), cosine_distance(F.col(vector), query).alias("distance")).where("distance is not null")


def vector_top(v: Vault, vectors: DataFrame, query: Sequence[float], limit: int, passing: DataFrame | None = None, prefilter: bool = False) -> DataFrame:
    """(id, score): of the max(5 limit, 25) nearest chunks, those within the radius that pass the filters. prefilter: filter before that cut."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    if prefilter and passing is not None:
        vectors = vectors.join(v.chunk.select("id", "note_id"), "id").join(passing, "note_id", "left_semi")
    near = nearest(vectors, literal).orderBy("distance", "id").limit(max(5 * limit, 25))
    near = _kept(near.where(F.col("distance") <= RADIUS), v.chunk, passing)
    return near.orderBy("distance", "id").limit(limit).select("id", (1 - F.col("distance")).alias("score"))


def fused(*ranked: DataFrame) -> DataFrame:
    """(id, score): the sum of 1 / (60 + rank) over lists (id, score)."""
    rows = None
    for r in ranked:
        place = r.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", (1.0 / (RRF + F.col("rank"))).alias("part"))
        rows = place if rows is None else rows.unionByName(place)
    return rows.groupBy("id").agg(F.sum("part").alias("score"))


def search(v: Vault, index: TextIndex, query: str, mode: str = "hybrid", limit: int = 10, vectors: DataFrame | None = None, embedder: Embedder | None = None, index_embedder: tuple[str, int] | None = None, status: str | None = None, tags: Sequence[str] = (), audience: Sequence[str] = (), prefilter: bool = False) -> DataFrame:
    """(id, note_id, heading_path, title, text, status, score), the best first."""
    positive(limit, "limit")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    passing = filtered(v, status, tags, audience)
    if mode != "fts":
        if vectors is None or embedder is None:
            raise ValueError(f"{mode} search needs an index with vectors and an embedder")
        if index_embedder and index_embedder != (embedder.id, embedder.dimensions):
            raise ValueError(f"the index was built by {index_embedder[0]}, not {embedder.id}")
    if mode == "fts":
        top = fts_top(v, index, query, limit, passing)
    elif mode == "vector":
        top = vector_top(v, vectors, embedder.embed_query(query), limit, passing, prefilter)
    else:
        wide = max(5 * limit, 25)
        top = fused(fts_top(v, index, query, wide, passing), vector_top(v, vectors, embedder.embed_query(query), wide, passing, prefilter)).orderBy(F.desc("score"), "id").limit(limit)
    rows = v.chunk.join(F.broadcast(top), "id").join(v.note.select(F.col("id").alias("note_id"), "title", "status"), "note_id")
    return rows.select("id", "note_id", "heading_path", "title", "text", "status", "score").orderBy(F.desc("score"), "id")


@dataclass(frozen=True)
class VectorIndex:
    """Vectors by cell, the nearest of centres that are fitted on a bounded sample; every vector is in one cell. A query reads the cells of the nearest centres only, and ranks what they hold exactly."""

    vectors: DataFrame
    centres: np.ndarray

    @classmethod
    def fitted(cls, vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 8, id: str = "id", vector: str = "embedding") -> "VectorIndex":
        """Centres by spherical k-means on the sample vectors of least hash of their id, at most sample; all rows are put in cells. Vectors that are null or of norm 0 are left out."""
        rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("embedding")).where(F.col(vector).isNotNull())
        taken = rows.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample).select("embedding").toArrow().column("embedding")
        m = np.array([x.as_py() for x in taken], np.float64).reshape(len(taken), -1 if len(taken) else 0)
        size = np.linalg.norm(m, axis=1) if len(m) else np.zeros(0)
        m = m[size > 0] / size[size > 0, None]
        centres = m[:: max(1, len(m) // max(1, cells))][:cells]
        for _ in range(rounds):
            if not len(centres):
                break
            near = np.argmax(m @ centres.T, 1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, m)
            size = np.linalg.norm(sums, axis=1)
            centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-12)[:, None], centres)
        kind = rows.schema["id"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
                some = np.flatnonzero((m * m).sum(1) > 0)
                kept = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("embedding"), pa.array((np.argmax(m[some] @ centres.T, 1) if len(centres) else np.zeros(len(some))).astype(np.int32))], ["id", "embedding", "cell"])

        return cls(rows.mapInArrow(run, f"id {kind}, embedding array<float>, cell int"), centres)

    def write(self, path: str) -> None:
        """A folder for each cell, so that a query prunes to its cells; centres beside them. A cell of very many vectors is spread over files."""
        spread = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(4))
        self.vectors.repartition("cell", spread).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
        self.vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "VectorIndex":
        centres = [r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()]
        return cls(spark.read.parquet(f"{path}/cells"), np.array(centres, np.float64))

    def cells_of(self, query: Sequence[float], probes: int) -> list[int]:
        """The probes cells whose centres are nearest to a query."""
        return np.argsort(-(self.centres @ np.asarray(query, np.float64)), kind="stable")[:probes].tolist()

    def top(self, query: Sequence[float], k: int, probes: int) -> DataFrame:
        """(id, distance): the k nearest of the vectors in the probed cells; with probes for all cells, of all."""
        some = self.vectors.where(F.col("cell").isin(self.cells_of(query, probes)))
        return nearest(some, F.array(*(F.lit(float(x)) for x in query))).orderBy("distance", "id").limit(k)

    def top_all(self, queries: DataFrame, k: int, probes: int, id: str = "id", vector: str = "embedding") -> DataFrame:
        """(query, rank, id, distance) of many queries at once: each goes to its cells, and a cell's queries and vectors meet in blocks."""
        sent = self.centres

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    m = np.stack(batch.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
                    near = np.argsort(-(m @ sent.T), axis=1, kind="stable")[:, :probes]
                    at = pa.array(np.repeat(np.arange(len(m)), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("v").take(at), pa.array(near.ravel().astype(np.int32))], ["id", "v", "cell"])

        asked = queries.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
        asked = asked.mapInArrow(run, f"id long, v {queries.schema[vector].dataType.simpleString()}, cell int")
        return nearest_all(self.vectors, asked, k, vector="embedding", asked=("id", "v"), by="cell")


def nearest_all(vectors: DataFrame, queries: DataFrame, k: int, id: str = "id", vector: str = "embedding", block: int = 2048, asked: tuple[str, str] | None = None, by: str | None = None) -> DataFrame:
    """(query, rank, id, distance): the k nearest vectors of every query, exactly, ties by id; distances to nine places.

    asked: id and vector of queries, if they are named otherwise. by: a column of both sides; only equal values meet.

    Both sides are packed into blocks; each pair of blocks is one matrix product, which keeps k of a query. Vectors that
    are null or of norm 0 are left out; all must have one length.
    """
    def packed(df: DataFrame, name: str, id: str, vector: str) -> DataFrame:
        def grouped(batches):
            for rows in batches:
                for g in np.unique(rows.column("g").to_numpy()):
                    yield rows.filter(pa.array(rows.column("g").to_numpy() == g))

        def run(batches):
            batches = grouped(batches)
            for rows in batches:
                for i in range(0, rows.num_rows, block):
                    part = rows.slice(i, block)
                    ids, m = part.column("id").to_numpy(), np.stack(part.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
                    size = np.sqrt((m * m).sum(1))
                    some = size > 0
                    m = m[some] / size[some, None]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[some].tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), part.column("g")[:1]], [f"{name}_ids", f"{name}_vectors", "g"])

        rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"), (F.col(by) if by else F.lit(0)).cast("int").alias("g")).where("id is not null and v is not null")
        rows = rows.repartition("g", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("g") if by else rows
        return rows.mapInArrow(run, f"{name}_ids binary, {name}_vectors binary, g int")

    def run(batches):
        for rows in batches:
            for qi, qv, vi, vv in zip(*(rows.column(c).to_pylist() for c in ("q_ids", "q_vectors", "v_ids", "v_vectors"))):
                qi, vi = np.frombuffer(qi, np.int64), np.frombuffer(vi, np.int64)
                if not len(qi) or not len(vi):
                    continue
                d = np.round(1 - np.frombuffer(qv).reshape(len(qi), -1) @ np.frombuffer(vv).reshape(len(vi), -1).T, 9) + 0.0
                by = np.argsort(vi, kind="stable")
                best = by[np.argsort(d[:, by], axis=1, kind="stable")[:, :k]]
                n = best.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, n)), pa.array(vi[best].ravel()), pa.array(np.take_along_axis(d, best, 1).ravel())], ["query", "id", "distance"])

    q, v = packed(queries, "q", *(asked or (id, vector))), packed(vectors, "v", id, vector)
    pairs = q.join(v, "g") if by else q.drop("g").crossJoin(v.drop("g"))
    near = pairs.mapInArrow(run, "query long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query", "rank", "id", "distance")
