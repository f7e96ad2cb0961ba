"""Token ids in binary files of independent zstandard frames, with a trailing seek table and a checksum for each frame.

A file holds, one after another: a frame for each document, of its token ids as little-endian unsigned integers; a
skippable frame of the documents' ids; and the seek table of zstandard's seekable format (compressed size, size and the
low 32 bits of XXH64 of each frame), which is a skippable frame too and ends in its number of frames and a magic number.
Any zstandard reader can decompress the whole; a reader that wants some documents reads the file's end, then only
their frames, and checks each.

A row of the result is a file. A task makes files from the documents that it reads, in their order, so a task that is
run again makes the same files under the same names.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import kind_of, read

SKIPPABLE, SEEK, FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
SCHEMA = "file string, documents long, tokens long, doc_ids array<long>, data binary"


@dataclass(frozen=True)
class Params:
    """tokenizer: path of a rank file, which the driver reads; there is no default. end: id after each document, or None. bits: of an id. file_bytes: a file is closed beyond these."""

    tokenizer: str
    pattern: str = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    end: int | None = 50256
    bits: int = 16
    level: int = 3
    file_bytes: int = 8 << 20
    cached: int = 1 << 20


class Encoder:
    """Ids of texts as bytes. White space before a word belongs to it, so a text is cut at single spaces and the pieces' ids are kept; a text with other white space about a space is encoded in one go."""

    odd = re.compile(r"\s |\s\Z| \s|\A ")

    def __init__(self, ranks: bytes, p: Params):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("own", pat_str=p.pattern, mergeable_ranks=table, special_tokens={})
        self.dtype = np.dtype(f"<u{p.bits // 8}")
        if max([*table.values(), p.end or 0]) >= 1 << p.bits:
            raise ValueError(f"the tokenizer has ids beyond {p.bits} bits")
        self.end = b"" if p.end is None else np.array([p.end], self.dtype).tobytes()
        self.most, self.known = p.cached, {}

    def direct(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), self.dtype).tobytes()

    def __call__(self, text: str) -> bytes:
        if self.odd.search(text):
            return self.direct(text) + self.end
        first, *rest = text.split(" ")
        known = self.known
        try:
            body = [known[x] for x in rest]
        except KeyError:
            if len(known) > self.most:
                known.clear()
            body = []
            for x in rest:
                ids = known.get(x)
                if ids is None:
                    ids = self.direct(" " + x)
                    if len(x) < 48:
                        known[x] = ids
                body.append(ids)
        return self.direct(first) + b"".join(body) + self.end


_encoders: dict[tuple, Encoder] = {}


def encoder(ranks: bytes, p: Params) -> Encoder:
    key = (xxhash.xxh64_intdigest(ranks), p)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, p)
    return _encoders[key]


def pack(frames: list[bytes], sizes: list[int], sums: list[int], doc_ids: list[int]) -> bytes:
    ids = np.array(doc_ids, "<i8").tobytes()
    entries = np.array([[len(f) for f in frames], sizes, sums], "<u4").T.tobytes() if frames else b""
    footer = struct.pack("<IBI", len(frames), 0x80, FOOTER)
    return b"".join(frames) + struct.pack("<II", SKIPPABLE, len(ids)) + ids + struct.pack("<II", SEEK, len(entries) + len(footer)) + entries + footer


def token_files(docs: DataFrame, p: Params, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(file, documents, tokens, doc_ids, data): the files that hold every document. A file's ids are 64-bit whole numbers, so doc_id must be of such a type.

    Nulls: rows with a null id are left out; a null text counts as empty. An empty text has a frame without ids but for
    the end. Very long texts are encoded whole, in one frame. Repeated rows have a frame each. An empty table gives no
    files. Other columns of docs are not looked at, whatever their names.
    """
    if kind_of(docs, doc_id) not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{doc_id} must be a whole number, not {kind_of(docs, doc_id)}")
    with open(p.tokenizer, "rb") as f:
        ranks = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, squeeze = encoder(sent.value, p), zstandard.ZstdCompressor(level=p.level, write_checksum=False)
        part, made = TaskContext.get().partitionId(), 0
        frames, sizes, sums, ids = [], [], [], []
        total = 0

        def file() -> pa.RecordBatch:
            tokens = sum(sizes) // (p.bits // 8)
            row = [f"tokens-{part:06d}-{made:04d}.zst"], [len(ids)], [tokens], pa.array([ids], pa.list_(pa.int64())), pa.array([pack(frames, sizes, sums, ids)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, list) else x for x in row], ["file", "documents", "tokens", "doc_ids", "data"])

        for rows in batches:
            for i, t in zip(rows.column("id").to_pylist(), rows.column("text")):
                raw = encode(t.as_py())
                frames.append(squeeze.compress(raw))
                sizes.append(len(raw))
                sums.append(xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
                ids.append(i)
                total += len(frames[-1])
                if total >= p.file_bytes:
                    yield file()
                    made, total = made + 1, 0
                    frames, sizes, sums, ids = [], [], [], []
        if ids:
            yield file()

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id is not null").mapInArrow(run, SCHEMA)


class TokenFile:
    """A reader of one file, given a function that reads (offset, length) and the file's size."""

    def __init__(self, read_at, size: int, bits: int = 16):
        self.read_at, self.dtype = read_at, np.dtype(f"<u{bits // 8}")
        n, flags, magic = struct.unpack("<IBI", read_at(size - 9, 9))
        if magic != FOOTER or flags != 0x80:
            raise ValueError("no seek table at the end")
        start = size - 9 - 12 * n - 8 - 8 * n - 8
        tail = read_at(start, size - 9 - start)
        if struct.unpack_from("<II", tail) != (SKIPPABLE, 8 * n) or struct.unpack_from("<II", tail, 8 + 8 * n) != (SEEK, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.doc_ids = np.frombuffer(tail, "<i8", n, 8)
        table = np.frombuffer(tail, "<u4", 3 * n, 16 + 8 * n).reshape(n, 3).astype(np.int64)
        self.sizes, self.raw, self.sums = table.T
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])

    @classmethod
    def of(cls, data: bytes, bits: int = 16) -> "TokenFile":
        return cls(lambda at, n: data[at : at + n], len(data), bits)

    @classmethod
    def open(cls, uri: str, bits: int = 16) -> "TokenFile":
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        f = fs.open_input_file(path)
        return cls(lambda at, n: f.read_at(n, at), fs.get_file_info(path).size, bits)

    def frame(self, k: int) -> np.ndarray:
        raw = zstandard.ZstdDecompressor().decompress(bytes(self.read_at(int(self.at[k]), int(self.sizes[k]))), max_output_size=max(1, int(self.raw[k])))
        if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} doesn't fit its checksum")
        return np.frombuffer(raw, self.dtype)

    def documents(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(id, tokens) of the frames that hold these documents; no other is read."""
        for k in np.flatnonzero(np.isin(self.doc_ids, np.fromiter(doc_ids, np.int64))):
            yield int(self.doc_ids[k]), self.frame(int(k))


def decode(files: DataFrame, doc_ids: list[int] | None = None, bits: int = 16) -> DataFrame:
    """(doc_id, tokens) of the documents in a table of files, or of those of doc_ids.

    A document of several frames has a row for each; ids that no file has, or null, give none; a file without frames or an
    empty table gives no rows. Other columns are not looked at. A frame that doesn't fit its checksum is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for data in rows.column("data"):
                f = TokenFile.of(data.as_py(), bits)
                ids = np.unique(f.doc_ids) if doc_ids is None else [i for i in doc_ids if i is not None]
                found = list(f.documents(ids))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t.astype(np.int32) for _, t in found], pa.list_(pa.int32()))], ["doc_id", "tokens"])

    return files.where("data is not null").select("data").mapInArrow(run, "doc_id long, tokens array<int>")


def write_files(files: DataFrame, uri: str) -> None:
    """Writes each row's data as uri/file. A file gets its name when it is whole, so a task may be run again.

    Rows whose file or data is null are left out; of rows with one name the last written stays. An empty table writes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(root)
        for rows in batches:
            for name, data in zip(rows.column("file").to_pylist(), rows.column("data")):
                with fs.open_output_stream(part := f"{root}/.{name}.{TaskContext.get().taskAttemptId()}") as out:
                    out.write(data.as_buffer())
                fs.move(part, f"{root}/{name}")
            yield rows.select(["file"])

    files.where("file is not null and data is not null").select("file", "data").mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()


def op10_token_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """tokenizer: a rank file; else what LODESTONE_TOKENIZER names, else the 50k one of /opt/tokenizers."""
    path = tokenizer or os.environ.get("LODESTONE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
    return token_files(read(spark, sf_dir, "documents"), Params(path))
