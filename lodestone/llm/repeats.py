"""Long repeated passages by run-length indexes: run-compressed Burrows-Wheeler transforms with sampled run ends.

What is marked is every passage of p.length words or more that occurs at another place of the corpus too.

1. Anchors. Of every p.length words in a row, the word gram of least hash is an anchor, so equal passages have an equal
   anchor at an equal place. An anchor's context is all passages of that length that contain it.
2. Anchors that share their gram are brought together. Those with equal contexts repeat throughout; one stands for all.
   Grams that occur once are done with, which is most of a corpus.
3. Where contexts differ, how far they agree is read off an index. The contexts of a batch of grams are joined to
   segments of their documents, so that no place of the corpus is in it twice, and the Burrows-Wheeler transform of the
   segments is compressed to runs. Samples at both ends of each run hold a text position and how many words it has in
   common with its neighbour in suffix order. Between two samples in the text that number falls by one a word, so one
   pass along the text streams the matching statistics: at each word, the longest match anywhere else.
4. A hot gram, an anchor at more than `crowd` places, is never brought to one task: its equal contexts are counted with
   sums before the exchange, and the passages of the others are compared by hash across the cluster. The result is the
   same by either way; `crowd` bounds what a task holds, not what is found.

Places are told by id and a hash of the text, so rows of one id that differ in text don't disturb each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Scan, Workspace, fold, grams, kind_of, mix, nearly, powers, ragged, read, scan, several, slices


@dataclass(frozen=True)
class Params:
    """length: words of a passage. gram: words of an anchor. batch: words of an index. crowd: places of a gram from which it is hot."""

    length: int = 50
    gram: int = 8
    batch: int = 400_000
    crowd: int = 4_000


#: Document and its text's hash, first and end word, first and end character.
SPAN = ["id", "t", "i", "j", "start", "stop"]


def slide(values: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over values[i : i + width] for each i; fill stands beyond the end."""
    size, out = 1, values

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([x[by:], np.full(min(by, len(x)), fill, x.dtype)])

    while 2 * size <= width:
        out = op(out, shifted(out, size))
        size *= 2
    return op(out, shifted(out, width - size)) if width > size else out


def anchors(s: Scan, p: Params) -> np.ndarray:
    """Words at which an anchor begins, and the hash of each one's gram."""
    n, top = len(s.hashes), np.iinfo(np.uint64).max
    if n < p.length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, top, np.uint64)
    h[: n - p.gram + 1] = grams(s.hashes, p.gram)
    width = p.length - p.gram + 1
    least = slide(h, width, np.minimum, top)
    least[~nearly(s.first, p.length)] = 0
    most = slide(np.concatenate([np.zeros(width - 1, np.uint64), least]), width, np.maximum, 0)[:n]
    at = np.flatnonzero((most == h) & (most > 0))
    return at, h[at]


def contexts(s: Scan, at: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end word of each anchor's context, and its text."""
    text = np.searchsorted(s.first, at, "right") - 1
    return np.maximum(s.first[text], at - (p.length - p.gram)), np.minimum(s.first[text + 1], at + p.length), text


def anchor_rows(docs: DataFrame, p: Params) -> DataFrame:
    """(h, c, id, t, w, e, start, stop): gram, context, document, its text's hash, word, the context's end word and its characters. docs: (id, t, text)."""
    kind = kind_of(docs, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in slices(batches, "text"):
            s = scan(fold(data), bounds)
            at, h = anchors(s, p)
            if not len(at):
                continue
            lo, hi, text = contexts(s, at, p)
            power, inverse = powers(len(s.hashes) + 1)
            sums = np.zeros(len(s.hashes) + 1, np.uint64)
            np.cumsum(s.hashes * power[: len(s.hashes)], out=sums[1:])
            c = mix((sums[hi] - sums[lo]) * inverse[lo] + mix((at - lo).astype(np.uint64) + (hi - lo).astype(np.uint64) * np.uint64(1 << 20)))
            chars = s.chars()
            base = chars[bounds[text]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), rows.column("id").take(pa.array(text)), rows.column("t").take(pa.array(text)), pa.array((at - s.first[text]).astype(np.int32)), pa.array((hi - s.first[text]).astype(np.int32)), pa.array((chars[s.start[lo]] - base).astype(np.int32)), pa.array((chars[s.end[hi - 1]] - base).astype(np.int32))],
                ["h", "c", "id", "t", "w", "e", "start", "stop"],
            )

    return docs.mapInArrow(run, f"h long, c long, id {kind}, t int, w int, e int, start int, stop int")


def fetch(docs: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """(h, id, t, at, words, starts, stops): the contexts of wanted (id, t, anchors (h, w)), at being the first word."""
    kind = kind_of(docs, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in slices(batches, "text"):
            s = scan(fold(data), bounds)
            lists = rows.column("anchors")
            count = lists.value_lengths().to_numpy()
            flat = lists.flatten()
            text = np.repeat(np.arange(rows.num_rows), count)
            at = s.first[text] + flat.field("w").to_numpy()
            h = flat.field("h").to_numpy()
            lo, hi, _ = contexts(s, at, p)
            chars = s.chars()
            for i in range(0, len(at), 20_000):
                a, b, t = lo[i : i + 20_000], hi[i : i + 20_000], text[i : i + 20_000]
                size = b - a
                first = np.concatenate([[0], np.cumsum(size)])
                j = np.repeat(a - first[:-1], size) + np.arange(first[-1])
                base = np.repeat(chars[bounds[t]], size)
                columns = (s.hashes[j].astype(np.uint32), (chars[s.start[j]] - base).astype(np.int32), (chars[s.end[j]] - base).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 20_000]), rows.column("id").take(pa.array(t)), rows.column("t").take(pa.array(t)), pa.array((a - s.first[t]).astype(np.int32)), *(ragged(x, first) for x in columns)], ["h", "id", "t", "at", "words", "starts", "stops"])

    return docs.join(wanted, ["id", "t"]).mapInArrow(run, f"h long, id {kind}, t int, at int, words binary, starts binary, stops binary")


def suffix_order(t: np.ndarray) -> np.ndarray:
    """The suffix array of t, whose last value occurs nowhere else, by doubling."""
    n = np.int64(len(t))
    rank, size = t.astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[:-size] += rank[size:] + 1
        order = np.argsort(key)
        key = key[order]
        step = np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)])
        np.cumsum(step, out=step)
        if step[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = step
        size *= 2


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values the texts from a and from b on have in common."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    n, k = len(t), 0
    while len(live):
        x, y = a[live] + k, b[live] + k
        ok = (x < n) & (y < n)
        ok[ok] = t[x[ok]] == t[y[ok]]
        live = live[ok]
        k += 1
        out[live] = k
    return out


@dataclass
class RunIndex:
    """runs: (value, length) of the transform. Samples at runs' first and last rows: text positions in order, and words in common with the row before, and after."""

    runs: tuple[np.ndarray, np.ndarray]
    heads: tuple[np.ndarray, np.ndarray]
    tails: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, t: np.ndarray) -> "RunIndex":
        order = suffix_order(t)
        last = t[order - 1]
        begin = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        end = np.concatenate([begin[1:], [len(t)]]) - 1

        def samples(row: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            inside = (other >= 0) & (other < len(t))
            shared = np.zeros(len(row), np.int64)
            shared[inside] = common(t, order[row[inside]], order[other[inside]])
            by = np.argsort(order[row])
            return order[row][by], shared[by]

        return cls((last[begin], end - begin + 1), samples(begin, begin - 1), samples(end, end + 1))

    def statistics(self, n: int) -> np.ndarray:
        """At each of the n text positions, the length of its longest match elsewhere."""
        out = np.zeros(n, np.int64)
        at = np.arange(n)
        for place, shared in (self.heads, self.tails):
            k = np.searchsorted(place, at, "right") - 1
            out = np.maximum(out, np.where(k >= 0, shared[k] - (at - place[k]), 0))
        return out


def matches(ids: np.ndarray, at: np.ndarray, words: np.ndarray, starts: np.ndarray, stops: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """(document, first word, end word, start, stop) of the words, each given by document and place, that long matches among these words cover."""
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (at[1:] != at[:-1])])
    ids, at, words, starts, stops = ids[fresh], at[fresh], words[order][fresh], starts[order][fresh], stops[order][fresh]
    breaks = np.flatnonzero(np.concatenate([(ids[1:] != ids[:-1]) | (at[1:] != at[:-1] + 1), [True]])) + 1
    # Each segment ends in a value of its own, least for the last.
    n = len(words) + len(breaks)
    place = np.arange(len(words)) + np.searchsorted(breaks, np.arange(len(words)), "right")
    t = np.empty(n, np.int64)
    t[place] = np.unique(words, return_inverse=True)[1] + len(breaks)
    t[breaks + np.arange(len(breaks))] = np.arange(len(breaks))[::-1]
    found = RunIndex.of(t).statistics(n)
    long = np.flatnonzero(found >= p.length)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, long, 1)
    np.add.at(cover, long + found[long], -1)
    inside = (np.cumsum(cover[:-1]) > 0)[place]
    follows = np.concatenate([[False], (ids[1:] == ids[:-1]) & (at[1:] == at[:-1] + 1) & inside[:-1]])
    first = np.flatnonzero(inside & ~follows)
    ends = np.flatnonzero(inside & ~np.concatenate([follows[1:] & inside[1:], [False]]))
    return ids[first], at[first], at[ends] + 1, starts[first], stops[ends]


def unpacked(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(gram, row, word, hash, start, stop) of every word of contexts, row being their place among rows."""
    words, starts, stops = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("words", np.uint32), ("starts", np.int32), ("stops", np.int32)))
    size = np.array([len(x) // 4 for x in rows.column("words").to_pylist()], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    h, at = (rows.column(c).to_numpy() for c in ("h", "at"))
    return np.repeat(h, size), np.repeat(np.arange(rows.num_rows), size), np.repeat(at - first[:-1], size) + np.arange(first[-1]), words, starts, stops


def documents(rows: pa.Table) -> np.ndarray:
    """A number for each row's document, by id and text."""
    code = rows.column("id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.unique(np.stack([code, rows.column("t").to_numpy().astype(np.int64)]), axis=1, return_inverse=True)[1].reshape(-1)


def indexed(parts: DataFrame, p: Params) -> DataFrame:
    """SPAN rows of long matches between contexts of one gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) for c in rows.columns], rows.column_names)
            doc, (_, row, *columns) = documents(rows), unpacked(batch)
            found, *ends = matches(doc[row], *columns, p)
            some = np.zeros(doc.max() + 1, np.int64)
            some[doc] = np.arange(len(doc))
            at = pa.array(some[found])
            return pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("t").take(at), *(pa.array(x.astype(np.int32)) for x in ends)], SPAN)

        held: list[pa.RecordBatch] = []
        size = 0
        for rows in batches:
            h = rows.column("h").to_numpy()
            cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                # An index is closed before the first gram after it has its words.
                if i < j and size >= p.batch and h[i] != held[-1].column("h")[-1].as_py():
                    yield flush(held)
                    held, size = [], 0
                if i < j:
                    held.append(rows.slice(i, j - i))
                    size += sum(len(x) for x in held[-1].column("words").to_pylist()) // 4
        if held:
            yield flush(held)

    return parts.repartition("h").sortWithinPartitions("h").mapInArrow(run, f"id {kind_of(parts, 'id')}, t int, i int, j int, start int, stop int")


def hashed(ws: Workspace, parts: DataFrame, p: Params) -> DataFrame:
    """As indexed(), by hashes of all passages of p.length words; what each task has of a passage is summed up before the exchange."""
    kind = kind_of(parts, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            _, row, place, words, starts, stops = unpacked(rows)
            size = np.bincount(row, minlength=rows.num_rows)
            i = np.flatnonzero(nearly(np.concatenate([[0], np.cumsum(size)]), p.length))
            code = grams(mix(words.astype(np.uint64)), p.length)[i]
            at = pa.array(row[i])
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), rows.column("id").take(at), rows.column("t").take(at), *(pa.array(x.astype(np.int32)) for x in (place[i], place[i] + p.length, starts[i], stops[i + p.length - 1]))], ["code", *SPAN])

    rows = ws.table(parts.mapInArrow(run, f"code long, id {kind}, t int, i int, j int, start int, stop int"))
    repeated = several(rows.select("code", F.struct("id", "t", "i").alias("place")), "code", "place")
    return rows.join(repeated.select("code"), "code", "left_semi").select(*SPAN)


def merged(spans: DataFrame) -> DataFrame:
    """SPAN rows, those without a word between them made one. A text's spans meet in one task; they are at most as many as its words."""
    order = Window.partitionBy("id", "t").orderBy("i", "j")
    before = F.max("j").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.when(F.col("i") <= before, 0).otherwise(1))
    return new.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("id", "t", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def repeated_passages(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, stop): the characters [start, stop) of each document that repeated passages cover, every occurrence.

    Each row is a longest run of words that are all in such passages.
    A passage is p.length words or more, case and punctuation aside; in scripts without spaces each character is a word.
    It may repeat in another document or elsewhere in its own. Ids may be of any type that sorts. Nulls: rows whose id or
    text is null are left out. Texts of fewer words have none; very long ones are read whole. Repeated rows are copies of
    each other, and so wholly repeated; rows of one id that differ in text are each searched, and what they have is
    listed under the id. An empty table gives no rows. Other columns of docs are not looked at, whatever their names.
    """
    chosen = docs.select(F.col(doc_id).alias("id"), F.hash(F.col(text)).alias("t"), F.col(text).alias("text")).where("id is not null and text is not null")
    place, wanted = F.struct("id", "t", "w"), lambda first: first.groupBy("id", "t").agg(F.collect_list(F.struct("h", "w")).alias("anchors"))
    with Workspace(docs.sparkSession) as ws:
        every = ws.table(anchor_rows(chosen, p))
        hot = ws.side(every.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > p.crowd).select("h"))
        gram, context = Window.partitionBy("h"), Window.partitionBy("h", "c")
        rows = every.join(hot, "h", "left_anti").repartition("h").withColumns({"n": F.count("*").over(context), "k": F.row_number().over(context.orderBy("id", "t", "w"))})
        # Contexts of a gram are counted by the first of each.
        rows = ws.table(rows.withColumn("kinds", F.sum((F.col("k") == 1).cast("long")).over(gram)).where("n > 1 or kinds > 1"))
        span = ["id", "t", F.greatest(F.lit(0), F.col("w") - (p.length - p.gram)).alias("i"), F.col("e").alias("j"), "start", "stop"]
        spans = rows.where("n > 1").select(*span)
        few = rows.where("kinds > 1 and k = 1").select("h", "id", "t", "w")

        rows = ws.table(every.join(hot, "h", "left_semi"))
        kinds = ws.table(rows.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(place).alias("first")))
        spans = spans.union(rows.join(kinds.where("n > 1").select("h", "c"), ["h", "c"], "left_semi").select(*span))
        # Texts are exchanged once, for the contexts of both.
        parts = ws.table(fetch(chosen, wanted(few.unionByName(kinds.select("h", "first.*"))), p))
        spans = spans.union(indexed(parts.join(hot, "h", "left_anti"), p))
        spans = spans.union(hashed(ws, parts.join(hot, "h", "left_semi"), p)).distinct()
        return ws.keep(merged(spans).select(F.col("id").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).distinct())


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))
