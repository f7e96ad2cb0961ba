"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are learnt from labels of documents.

A document is toxic if any sentence is: P(document) = 1 - prod(1 - p(sentence)), p being a logistic model of a sentence's
words and their beginnings. Labels are of documents only; the gradient of the document's likelihood says which sentences
have to answer for it. Only features that toxic documents have significantly more often than others get a weight, for a
rare word could else answer for the one document that it is in. The threshold is the best on labelled documents held out
of training.

Training takes the p.sample labelled documents of least hash, whole. Everything else covers all documents: one scan, no
exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import kind_of, ragged, read, slices
from .features import sampled, sentences, sigmoid


@dataclass(frozen=True)
class Params:
    """sample: most labelled documents to train on; held: every so many of them are held out. bits: of feature columns. least: documents that a feature must be in; sure: standard errors by which toxic ones must have it more often."""

    sample: int = 8000
    held: int = 5
    bits: int = 18
    least: int = 3
    sure: float = 3.0
    rounds: int = 15
    batch: int = 128
    rate: float = 0.05
    decay: float = 1e-5
    bias: float = -5.0
    guilty: float = 0.5


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    threshold: float

    def scores(self, columns: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[columns], dtype=np.float64)])
        return sigmoid(sums[at[1:]] - sums[at[:-1]] + self.bias)


def noisy_or(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 - prod(1 - score) over the sentences of each document; 0 where there are none."""
    logs = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(scores, 1 - 1e-12)))])
    return -np.expm1(logs[first[1:]] - logs[first[:-1]])


def gradient(w: np.ndarray, bias: float, columns: np.ndarray, at: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Of the mean negative log-likelihood of documents' labels, by weights and bias. A sentence of a toxic document has to answer for it by its score over the odds of the whole."""
    score = Model(w, bias, 0).scores(columns, at)
    total = np.clip(noisy_or(score, first), 1e-9, 1 - 1e-12)
    pull = np.where(labels > 0, -(1 - total) / total, 1.0)
    g = score * np.repeat(pull, np.diff(first)) / len(labels)
    return np.bincount(columns, np.repeat(g, np.diff(at)), len(w)), float(g.sum())


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, p: Params) -> Model:
    """docs: (columns, at) of each document's sentences."""
    size = 1 << p.bits
    w, m, v, bias, mb, vb = np.zeros(size), np.zeros(size), np.zeros(size), p.bias, 0.0, 0.0
    held = np.arange(len(docs)) % p.held == p.held - 1
    learn = np.flatnonzero(~held)
    rng, step = np.random.default_rng(1), 0
    if len(set(labels.tolist())) < 2:
        return Model(w, -30.0 if not labels.any() else p.bias, 0.5)

    def joined(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns = np.concatenate([docs[i][0] for i in which])
        counts = [np.diff(docs[i][1]) for i in which]
        at = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return columns, at, np.concatenate([[0], np.cumsum([len(c) for c in counts])])

    bad = labels[learn] > 0
    often = np.zeros((2, size))
    for i, b in zip(learn, bad):
        often[int(b), np.unique(docs[i][0])] += 1
    n, k = len(learn), max(1, bad.sum())
    share = np.minimum(often.sum(0), n - 0.5) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / k + 1 / max(1, n - k)))
    tells = (often.sum(0) >= p.least) & (often[1] / k - often[0] / max(1, n - k) >= p.sure * spread)

    for _ in range(p.rounds):
        rng.shuffle(learn)
        for i in range(0, len(learn), p.batch):
            which = learn[i : i + p.batch]
            columns, at, first = joined(which)
            if not len(columns):
                continue
            grad, slope = gradient(w, bias, columns, at, first, labels[which])
            grad = grad * tells + p.decay * w
            step += 1
            for x, y, z, is_bias in ((grad, m, v, False), (slope, mb, vb, True)):
                y = 0.9 * y + 0.1 * x
                z = 0.999 * z + 0.001 * x * x
                move = p.rate * (y / (1 - 0.9**step)) / (np.sqrt(z / (1 - 0.999**step)) + 1e-8)
                if is_bias:
                    mb, vb, bias = y, z, bias - move
                else:
                    m, v, w = y, z, w - move
    model = Model(w, float(bias), 0.5)
    check = np.flatnonzero(held)
    if len(check) and labels[check].any():
        columns, at, first = joined(check)
        found = noisy_or(model.scores(columns, at), first)
        tries = np.arange(0.05, 0.96, 0.05)
        f1 = [2 * ((found >= t) & (labels[check] > 0)).sum() / max(1, (found >= t).sum() + (labels[check] > 0).sum()) for t in tries]
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
        model.threshold = float(tries[best[len(best) // 2]])
    return model


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the labelled documents, p.sample of them at most. Rows with a null id, text or label are not used; the greatest label of an id counts, and the least of its texts."""
    bits = p.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in slices(batches, "text"):
            s = sentences(data, bounds, bits)
            cuts = s.at[s.first]
            counts = np.diff(s.at).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("y"), ragged(s.columns.astype(np.int32), cuts), ragged(counts, s.first)], ["id", "y", "columns", "counts"])

    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    chosen = sampled(known, F.col("id"), p.sample)
    some = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    some = some.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = some.mapInArrow(run, f"id {kind_of(docs, doc_id)}, y int, columns binary, counts binary").toArrow().sort_by("id").combine_chunks()
    columns, counts = (rows.column(c).combine_chunks() for c in ("columns", "counts"))
    made = [(np.frombuffer(a.as_buffer(), np.int32), np.concatenate([[0], np.cumsum(np.frombuffer(b.as_buffer(), np.int32))])) for a, b in zip(columns, counts)]
    return train(made, rows.column("y").to_numpy(), p)


def score(docs: DataFrame, model: Model, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, toxic, spans) for every row of docs: spans (start, stop, score) are the sentences that answer for it, in characters.

    Ids may be of any type. Nulls: a null text counts as empty; rows with a null id are scored too. Empty texts score 0. Very long texts are
    scored whole. Repeated rows have a row each. An empty table gives no rows. Other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.bias, model.threshold))
    bits, guilty = p.bits, p.guilty
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for rows, data, bounds in slices(batches, "text"):
            s = sentences(data, bounds, bits)
            each = m.scores(s.columns, s.at)
            whole = noisy_or(each, s.first)
            toxic = whole >= m.threshold
            found = []
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            for i in range(len(whole)):
                own = []
                if toxic[i]:
                    j = np.arange(s.first[i], s.first[i + 1])
                    j = j[each[j] >= min(guilty, each[j].max())]
                    own = [{"start": int(chars[s.start[k]] - chars[bounds[i]]), "stop": int(chars[s.end[k]] - chars[bounds[i]]), "score": round(float(each[k]), 4)} for k in j]
                found.append(own)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(np.round(whole, 4)), pa.array(toxic), pa.array(found, span)], ["doc_id", "score", "toxic", "spans"])

    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {kind_of(docs, doc_id)}, score double, toxic boolean, spans array<struct<start:long,stop:long,score:double>>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
