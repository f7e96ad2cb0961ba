"""Sparse and dense features of texts for the trained classifiers, from one vectorised scan, and bounded training samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import fold, mix, scan

#: Lengths in bytes of the word beginnings that are features beside the whole word.
STEMS = (3, 5, 7)
SHAPES = 140


@dataclass
class Sentences:
    """Sentences of several texts: text i has first[i] up to first[i + 1]; bytes [start, end); features of sentence j are columns[at[j] : at[j + 1]]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    columns: np.ndarray
    at: np.ndarray


def sentences(data: np.ndarray, bounds: np.ndarray, bits: int) -> Sentences:
    """Sentences with a word at least. One ends at a line's end, or at a full stop, question or exclamation mark before white space.

    Features are the distinct words of a sentence and their beginnings, hashed to 2^bits columns.
    """
    low = fold(data)
    s = scan(low, bounds)
    n = len(data)
    space = np.ones(n + 1, bool)
    space[:-1] = (data == 32) | (data == 10) | (data == 9) | (data == 13)
    space[bounds] = True
    stops = np.flatnonzero((data == 10) | (((data == 46) | (data == 33) | (data == 63)) & space[1:])) + 1
    cuts = np.union1d(stops, bounds[1:])
    which = np.searchsorted(cuts, s.start, "right")
    some, inverse = np.unique(which, return_inverse=True)
    text = s.text_of
    m = len(some)
    begin, stop = np.zeros(m, np.int64), np.zeros(m, np.int64)
    owner = np.zeros(m, np.int64)
    begin[inverse[::-1]] = s.start[::-1]
    stop[inverse] = s.end
    owner[inverse] = text
    columns = [s.hashes, *(s.beginnings(k) for k in STEMS)]
    mask = np.uint64((1 << bits) - 1)
    codes = np.unique(np.concatenate([(inverse.astype(np.uint64) << np.uint64(bits)) | (mix(c) & mask) for c in columns])) if m else np.zeros(0, np.uint64)
    at = np.searchsorted(codes >> np.uint64(bits), np.arange(m + 1, dtype=np.uint64))
    return Sentences(begin, np.minimum(cuts[some], n) if m else stop, np.searchsorted(owner, np.arange(len(bounds))), (codes & mask).astype(np.int64), at)


def shapes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of SHAPES dense features for each text, of half precision: shares of its bytes, and statistics of its words and lines."""
    n = len(bounds) - 1
    out = np.zeros((n, SHAPES), np.float32)
    if not n:
        return out.astype(np.float16)
    text = np.repeat(np.arange(n), np.diff(bounds))
    kind = np.minimum(data, 128).astype(np.int64)
    count = np.bincount(text * 129 + kind, minlength=n * 129).reshape(n, 129).astype(np.float64)
    size = np.maximum(count.sum(1), 1)
    out[:, :129] = np.sqrt(count / size[:, None])
    s = scan(fold(data), bounds)
    words = np.diff(s.first)
    have = np.maximum(words, 1)
    of = s.text_of
    length = (s.end - s.start).astype(np.float64)
    out[:, 129] = np.bincount(of, length, n) / have / 10
    out[:, 130] = np.bincount(of, length > 12, n) / have
    distinct = np.unique(np.stack([of.astype(np.uint64), s.hashes]), axis=1)[0].astype(np.int64) if len(of) else of
    out[:, 131] = np.bincount(distinct, minlength=n) / have
    lines = np.flatnonzero(data == 10)
    line_of = np.bincount(text[lines], minlength=n) if len(lines) else np.zeros(n)
    out[:, 132] = np.log1p(line_of) / np.log1p(have)
    upper = count[:, 65:91].sum(1)
    out[:, 133] = upper / np.maximum(upper + count[:, 97:123].sum(1), 1)
    marks = count[:, 33:48].sum(1) + count[:, 58:65].sum(1) + count[:, 91:97].sum(1) + count[:, 123:127].sum(1)
    out[:, 134] = marks / size
    out[:, 135] = marks / have
    out[:, 136] = words == 0
    out[:, 137] = count[:, 48:58].sum(1) / size
    out[:, 138] = count[:, 128] / size
    out[:, 139] = np.log1p(words) / 10
    return np.minimum(out, 60_000).astype(np.float16)


def sampled(table: DataFrame, key: Column, most: int) -> DataFrame:
    """The most rows of least hash: the same rows in every run, whatever their order or partitions."""
    return table.withColumn("_at", F.xxhash64(key.cast("string"))).orderBy("_at", key).limit(most).drop("_at")


def floats(rows: np.ndarray) -> pa.Array:
    """A column of lists, one for each row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
