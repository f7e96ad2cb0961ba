"""What the training-data operators share: a workspace in the cluster's shared folder and vectorised text scanning."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are scanned at once; a longer document is scanned alone.
SLICE_BYTES = 1 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
LOWER = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
#: Ranges of code points beyond ASCII that separate words: Latin-1's marks, general, supplemental, CJK, vertical and full-width punctuation.
SEPARATE = ((0x80, 0xBF), (0x2000, 0x207F), (0x2E00, 0x2E7F), (0x3000, 0x303F), (0xFE10, 0xFE6F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
#: Scripts that put no spaces between words; each of their characters is a word: Thai and Lao, Myanmar, Khmer, Kana, Han.
SINGLE = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _classes() -> tuple[str, str]:
    """Regular-expression classes of the characters beyond ASCII that are words alone, and that are parts of words."""
    form = lambda ranges: "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)
    rest, at = [], 0x80
    for a, b in sorted(SEPARATE + SINGLE):
        if a > at:
            rest.append((at, a - 1))
        at = b + 1
    return form(SINGLE), form([*rest, (at, 0x10FFFF)])


#: A word, as the scanner sees it: a character of the scripts without spaces, or a run of ASCII letters and digits and of other characters beyond ASCII.
WORD = r"[{}]|[0-9A-Za-z{}]+".format(*_classes())


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may go without: it gets a temporary folder."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Folders of results that outlived their workspace.
_kept: list[str] = []


@contextlib.contextmanager
def borrowing(spark: SparkSession) -> Iterator[None]:
    """Results that operators return inside are deleted at the end; what is wanted of them must be written by then."""
    before = len(_kept)
    try:
        yield
    finally:
        while len(_kept) > before:
            _delete(spark, _kept.pop())


def release(spark: SparkSession) -> None:
    """Deletes the tables of all results that operators have returned so far."""
    while _kept:
        _delete(spark, _kept.pop())


#: Most bytes of a table that is sent to every executor.
SIDE_BYTES = 16 << 20


class Workspace:
    """Written tables in the shared folder, which cut lineage and survive the loss of executors; close() deletes them.

    A result that outlives the workspace goes through keep(); release() and borrowing() delete such results.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
        self.n = 0

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return self._write(df, f"{self.root}/{self.n}")

    def keep(self, df: DataFrame) -> DataFrame:
        _kept.append(f"{shared_dir(self.spark)}/kept-{uuid.uuid4().hex}")
        return self._write(df, _kept[-1])

    def side(self, df: DataFrame, limit: int = SIDE_BYTES, keep: bool = False) -> DataFrame:
        """df, written; marked to be broadcast if its rows take no more than limit bytes, else joined as any table: the rows of the result are the same."""
        df = self.keep(df) if keep else self.table(df)
        size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))) + 16)).first()[0] or 0
        return F.broadcast(df) if size <= limit else df

    def close(self) -> None:
        _delete(self.spark, self.root)

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def kind_of(df: DataFrame, column: str) -> str:
    """The type of a column, as schemas spell it."""
    return df.select(F.col(column)).schema[0].dataType.simpleString()


def several(rows: DataFrame, key: str, of: str, *more) -> DataFrame:
    """(key, least, ...) of the keys whose rows have different values of a column; sums of rows before any exchange, so a hot key is no burden."""
    found = rows.groupBy(key).agg(F.min(of).alias("least"), F.max(of).alias("most"), *more)
    return found.where("least < most").drop("most")


def sql_fold(text):
    """Column: the scanner's folding to lower case."""
    return F.translate(text, UPPER, LOWER)


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[65:91] = word[128:] = True
    return fold, word


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for À to Þ in UTF-8; every character keeps its length."""
    out = _tables()[0][data]
    if len(out) > 1:
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        c = data[at]
        at = at[(c >= 0x80) & (c <= 0x9E) & (c != 0x97)]
        out[at] += 32
    return out


_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's odd base and of its inverse, mod 2^64, n of each at least."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for k, base in enumerate((_P, _P_INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Scan:
    """Words of several texts. Offsets are in the texts' joined bytes; text i has words first[i] up to first[i + 1]."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    sums: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def chars(self) -> np.ndarray:
        """chars()[b]: characters before byte b of the joined texts."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out

    def beginnings(self, size: int) -> np.ndarray:
        """Hashes of the first size bytes of each word."""
        stop = np.minimum(self.start + size, self.end)
        return mix((self.sums[stop] - self.sums[self.start]) * powers(len(self.data) + 1)[1][self.start] + np.uint64(size))


_EDGES = np.array(sorted(x for a, b in SEPARATE + SINGLE for x in (a, b + 1)))
_IS_SINGLE = np.array([any(a <= x <= b for a, b in SINGLE) for x in _EDGES])
_IS_APART = np.array([any(a <= x <= b for a, b in SEPARATE) for x in _EDGES])


def word_mask(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes of folded UTF-8 belong to words; and first and end bytes of the characters that are words alone."""
    n = len(data)
    out = _tables()[1][data]
    none = np.zeros(0, np.int64)
    at = np.flatnonzero(data == 0xC2)
    out[at] = False
    out[np.minimum(at + 1, n - 1)] = False
    at = np.flatnonzero(data >= 0xE0)
    if not len(at):
        return out, none, none
    lead, wide = data[at].astype(np.int64), data[at] >= 0xF0
    a, b, c = (data[np.minimum(at + i, n - 1)].astype(np.int64) & 0x3F for i in (1, 2, 3))
    code = np.where(wide, ((lead & 7) << 18) | (a << 12) | (b << 6) | c, ((lead & 15) << 12) | (a << 6) | b)
    k = np.searchsorted(_EDGES, code, "right") - 1
    apart, single = (k >= 0) & _IS_APART[k], (k >= 0) & _IS_SINGLE[k]
    for i in range(3):
        out[np.minimum(at[apart] + i, n - 1)] = False
    first = at[single]
    return out, first, np.minimum(first + np.where(wide[single], 4, 3), n)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of the words of texts joined in data (folded already), text i being bounds[i] up to bounds[i + 1]."""
    n = len(data)
    word = np.zeros(n + 2, bool)
    word[1:-1], alone, stop = word_mask(data)
    begins = word[1:-1] & ~word[:-2]
    ends = word[1:-1] & ~word[2:]
    begins[alone] = ends[stop - 1] = True
    begins[stop[stop < n]] |= word[stop[stop < n] + 1]
    ends[alone[alone > 0] - 1] |= word[alone[alone > 0]]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] = word[inner + 1]
    ends[inner - 1] = word[inner]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def scan(data: np.ndarray, bounds: np.ndarray) -> Scan:
    """Finds and hashes the words of texts joined in data (folded already), text i being bounds[i] up to bounds[i + 1]."""
    n = len(data)
    start, end = words(data, bounds)
    first = np.searchsorted(start, bounds)
    p, inv = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    return Scan(data, bounds, start, end, first, mix((sums[end] - sums[start]) * inv[start]), sums)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Joined UTF-8 bytes and bounds of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with their joined raw bytes and bounds, about SLICE_BYTES of text at a time."""
    for batch in batches:
        data, bounds = texts(batch.column(text))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(row, stop - row), data[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row]
            row = stop


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 have none and the caller drops runs across texts."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(_P)
        out += hashes[i : i + n]
    return mix(out)


def binary(rows: np.ndarray) -> pa.Array:
    """A binary column of the bytes of each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows)])


def ragged(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column of the bytes of values[first[i] : first[i + 1]]."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """The rows of a binary column without nulls, each of width values."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros((0, width), dtype)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype).reshape(-1, width)


def nearly(first: np.ndarray, k: int) -> np.ndarray:
    """For words of texts by first: whether k words from here on lie in one text."""
    count = np.diff(first)
    left = np.repeat(first[1:], count) - np.arange(first[-1])
    return left >= k


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
