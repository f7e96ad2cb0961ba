"""MinHash near-duplicates with sequential Bayesian verification.

1. One scan of the texts makes, per document, a 128-bit fingerprint of its words and a MinHash signature.
2. Equal fingerprints are exact copies; one row stands for all from here on.
3. Signatures are banded. Within a band bucket every member is paired with the bucket's least member, which is linear
   in the bucket. Only buckets whose members still lie in different groups after step 5 are compared further: their
   signatures are cut into slices by hash, each two slices of a bucket meet in a cell of their own, and a cell compares
   its signatures as matrices. Cells are of bounded size and spread evenly, and give only the pairs that survive step 4.
4. A pair's signatures are compared batch by batch. After n hashes with m matches the posterior of the similarity is
   Beta(m + 1, n - m + 1); the pair is dropped as soon as P(similarity >= threshold) is under the chance of miss, which
   is shared between the batches, so that a pair at the threshold is dropped with that chance in all.
5. Survivors are verified exactly, on their sets of shingles: each document's most alike and least partner first, then
   all pairs whose documents these haven't connected.
6. Groups are the connected components of verified pairs and exact copies.

A pair of similarity s shares no bucket, and so may be missed, at a chance of (1 - s^rows)^bands: 4.5 % at the
threshold of 0.5, 1 % at 0.55, 0.1 % at 0.61, and far less beyond; copies of copies often connect it all the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Workspace, binary, fold, grams, kind_of, matrix, mix, nearly, ragged, read, scan, several, slices
from .components import connected_components


@dataclass(frozen=True)
class Params:
    """threshold: least Jaccard similarity of word shingles. miss: chance at which a pair at the threshold may be dropped. slice: members of a bucket that a cell has of each of its two slices."""

    shingle: int = 3
    bands: int = 48
    rows: int = 4
    threshold: float = 0.5
    miss: float = 0.001
    batch: int = 32
    slice: int = 2048

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def least_matches(p: Params) -> list[tuple[int, int]]:
    """(n, least m that survives) after each batch of n hashes. P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    looks = [*range(p.batch, p.hashes, p.batch), p.hashes]
    for n in looks:
        total, m = 0.0, -1
        while total < p.miss / len(looks) and m < n:
            m += 1
            total += math.comb(n + 1, m) * p.threshold**m * (1 - p.threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def multipliers(p: Params) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * p.hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[: p.hashes] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[p.hashes :] >> np.uint64(32)).astype(np.uint32)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles, text i's being values[at[i] : at[i + 1]]. A text of 1 to k - 1 words has one, of all of them."""
    whole = nearly(first, k)[: max(0, len(hashes) - k + 1)]
    values = grams(hashes, k)[whole]
    count = np.diff(first)
    at = np.concatenate([[0], np.cumsum(np.maximum(count - k + 1, 0))])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.array([grams(hashes[first[i] : first[i + 1]], int(count[i]))[0] for i in short], np.uint64)
        values = np.insert(values, at[short], extra)
        more = np.zeros(len(count), np.int64)
        more[short] = 1
        at = at + np.concatenate([[0], np.cumsum(more)])
    return values, at


def signatures(values: np.ndarray, at: np.ndarray, p: Params) -> np.ndarray:
    """Rows of p.hashes minima for texts by their shingles; all ones for a text without any."""
    out = np.full((len(at) - 1, p.hashes), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        x = (values >> np.uint64(32)).astype(np.uint32)
        a, b = multipliers(p)
        y = np.empty_like(x)
        for j in range(p.hashes):
            np.multiply(x, a[j], out=y)
            np.add(y, b[j], out=y)
            np.bitwise_xor(y, y >> np.uint32(15), out=y)
            out[some, j] = np.minimum.reduceat(y * np.uint32(0x2C1B3C6D), at[some])
    return out


def chosen(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")


def sketch(docs: DataFrame, p: Params, doc_id: str, text: str) -> DataFrame:
    """(id, h1, h2, sig) of every document with an id and at least one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in slices(batches, "text"):
            s = scan(fold(data), bounds)
            has = np.diff(s.first) > 0
            values, at = shingles(s.hashes, s.first, p.shingle)
            place = np.arange(len(s.hashes)) - np.repeat(s.first[:-1], np.diff(s.first))
            prints = []
            for salt in (0x51ED270B, 0x2F0B4C47):
                h = mix(s.hashes + (place.astype(np.uint64) + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
                prints.append(mix(total[s.first[1:]] - total[s.first[:-1]] + np.diff(s.first).astype(np.uint64)).view(np.int64)[has])
            yield pa.RecordBatch.from_arrays([rows.column("id").filter(pa.array(has)), pa.array(prints[0]), pa.array(prints[1]), binary(signatures(values, at, p)[has])], ["id", "h1", "h2", "sig"])

    return chosen(docs, doc_id, text).mapInArrow(run, f"id {kind_of(docs, doc_id)}, h1 long, h2 long, sig binary")


def band_members(sigs: DataFrame, p: Params) -> DataFrame:
    """(band, id), p.bands rows for each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sig = matrix(rows.column("sig"), np.uint32, p.hashes).reshape(-1, p.bands, p.rows)
            h = np.zeros(sig.shape[:2], np.uint64) + np.arange(p.bands, dtype=np.uint64)
            for j in range(p.rows):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, j].astype(np.uint64) + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), rows.column("id").take(pa.array(np.repeat(np.arange(len(sig)), p.bands)))], ["band", "id"])

    return sigs.select("id", "sig").mapInArrow(run, f"band long, id {kind_of(sigs, 'id')}")


def sliced(rows: DataFrame, sigs: DataFrame, p: Params) -> DataFrame:
    """(band, r, c, s, id, g, least, sig): the members of each cell. rows: (band, id, g, least, n), n being the bucket's members."""
    rows = rows.withColumn("k", F.ceil(F.col("n") / p.slice).cast("int")).withColumn("s", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    rows = rows.join(sigs.select("id", "sig"), "id")
    cells = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = cells.select("band", F.least("s", "x").alias("r"), F.greatest("s", "x").alias("c"), "s", "id", "g", "least", "sig")
    return cells.repartition("band", "r", "c").sortWithinPartitions("band", "r", "c", "s")


def within(cells: DataFrame, p: Params) -> DataFrame:
    """(a, b, matches) of the pairs across groups in each cell that no batch of hashes rules out, but those with the bucket's least member."""
    steps, kind = least_matches(p), kind_of(cells, "id")

    def pairs(sig: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = [(np.zeros(0, np.int64),) * 3]
        n, least = steps[0]
        for i in range(0, len(left), 64):
            x = left[i : i + 64]
            m = np.zeros((len(x), len(right)), np.int16)
            for j in range(n):
                m += sig[x, j][:, None] == sig[right, j][None]
            u, v = np.nonzero((m >= least) & (group[x][:, None] != group[right][None]))
            m, u, v, at = m[u, v].astype(np.int64), x[u], right[v], n
            for stop, low in steps[1:]:
                m = m + (sig[u, at:stop] == sig[v, at:stop]).sum(1)
                keep = m >= low
                m, u, v, at = m[keep], u[keep], v[keep], stop
            out.append((u, v, m))
        return tuple(np.concatenate(x) for x in zip(*out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = rows.column("id").combine_chunks()
            group = np.unique(rows.column("g").combine_chunks().dictionary_encode().indices.to_numpy(), return_inverse=True)[1]
            sig = matrix(pa.concat_arrays(rows.column("sig").chunks), np.uint32, p.hashes)
            s, r, c = (rows.column(x).to_numpy() for x in ("s", "r", "c"))
            left, right = np.flatnonzero(s == r[0]), np.flatnonzero(s == c[0])
            u, v, m = pairs(sig, group, left, right)
            x, y = ids.take(pa.array(u)).to_pylist(), ids.take(pa.array(v)).to_pylist()
            least = rows.column("least")[0].as_py()
            found = [(min(a, b), max(a, b), k) for a, b, k in zip(x, y, m.tolist()) if a != b and (r[0] != c[0] or a < b) and least not in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], ids.type), pa.array([f[1] for f in found], ids.type), pa.array([f[2] for f in found], pa.int64())], ["a", "b", "matches"])

        now = None
        for rows in batches:
            band, r, c = (rows.column(x).to_numpy() for x in ("band", "r", "c"))
            cuts = [0, *(np.flatnonzero((band[1:] != band[:-1]) | (r[1:] != r[:-1]) | (c[1:] != c[:-1])) + 1).tolist(), len(band)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                if held and (band[i], r[i], c[i]) != now:
                    yield flush()
                    held = []
                now = band[i], r[i], c[i]
                held.append(rows.slice(i, j - i))
        if held:
            yield flush()

    return cells.mapInArrow(run, f"a {kind}, b {kind}, matches long").dropDuplicates(["a", "b"])


def survivors(ws: Workspace, pairs: DataFrame, sigs: DataFrame, p: Params) -> DataFrame:
    """(a, b, matches) of the pairs (a, b) that no batch of hashes rules out."""
    steps = least_matches(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x, y = (matrix(rows.column(c), np.uint32, p.hashes) for c in ("sa", "sb"))
            alive, m, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, least in steps:
                m = m + (x[alive, done:n] == y[alive, done:n]).sum(1)
                keep = m >= least
                alive, m, done = alive[keep], m[keep], n
            yield pa.RecordBatch.from_arrays([rows.column("a").take(pa.array(alive)), rows.column("b").take(pa.array(alive)), pa.array(m)], ["a", "b", "matches"])

    kind = kind_of(sigs, "id")
    some = sigs.select("id", "sig").join(ws.side(ends(pairs)), "id", "left_semi")
    left, right = some.select(F.col("id").alias("a"), F.col("sig").alias("sa")), some.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}, matches long").dropDuplicates(["a", "b"])


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) with their exact Jaccard similarity, by sets (id, set) of sorted distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for x, y in zip(rows.column("xa"), rows.column("xb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("xa")), sets.select(F.col("id").alias("b"), F.col("set").alias("xb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "xa", "xb").mapInArrow(run, "a {0}, b {0}, similarity double".format(kind_of(sets, "id")))


def shingle_sets(ws: Workspace, docs: DataFrame, p: Params, doc_id: str, text: str, ids: DataFrame) -> DataFrame:
    """(id, set) of these documents, a row for each text of an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in slices(batches, "text"):
            s = scan(fold(data), bounds)
            values, at = shingles(s.hashes, s.first, p.shingle)
            sets = [np.unique(values[i:j]) for i, j in zip(at[:-1], at[1:])]
            first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            yield pa.RecordBatch.from_arrays([rows.column("id"), ragged(np.concatenate(sets), first)], ["id", "set"])

    found = chosen(docs, doc_id, text).join(ws.side(ids), "id", "left_semi").mapInArrow(run, f"id {kind_of(docs, doc_id)}, set binary")
    return found.where(F.length("set") > 0).dropDuplicates(["id", "set"])


def near_duplicates(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, duplicate_of, exact) for every document that is not the first of its group; duplicate_of has the least id.

    Two documents are alike when the Jaccard similarity of their sets of word shingles is p.threshold or more; a group is
    what such pairs, or equal words, connect. Words are runs of letters and digits, case aside, and single characters of
    scripts without spaces; a text of fewer words than a shingle has one shingle of all of them. exact: some document of
    less id has the same words.

    Ids may be of any type that sorts. Nulls: rows whose id or text is null are in no group. Texts without a word are in
    no group. Very long texts are read whole. Repeated rows of one id count as one document; rows of one id that differ
    in text are one document too, alike to whatever any of its texts is alike to. An empty table gives no rows. Other
    columns of docs are not looked at, whatever their names.
    """
    spark, kind = docs.sparkSession, kind_of(docs, doc_id)
    with Workspace(spark) as ws:
        every = ws.table(sketch(docs, p, doc_id, text))
        same = ws.side(every.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "rep"))
        copies = ws.table(every.select("h1", "h2", "id").join(same, ["h1", "h2"]).where("id > rep").select("id", "rep").distinct())
        stands = every.join(same, ["h1", "h2"]).groupBy("h1", "h2", "rep").agg(F.min("sig").alias("sig")).select(F.col("rep").alias("id"), "sig")
        sigs = ws.table(every.join(same, ["h1", "h2"], "left_anti").select("id", "sig").union(stands))
        # An id with several texts ties what it is a copy of to what its other texts are alike to.
        texts = every.select("id", F.struct("h1", "h2").alias("print"))
        tied = copies.join(several(texts, "id", "print").select("id"), "id", "left_semi").select(F.col("rep").alias("a"), F.col("id").alias("b"))

        bands = ws.table(band_members(sigs, p))
        members = ws.table(bands.join(several(bands, "band", "id", F.count("*").alias("n")), "band").select("band", "id", "least", "n"))
        star = ws.table(members.where("id > least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct())
        likely = ws.table(survivors(ws, star, sigs, p))
        sets = ws.table(shingle_sets(ws, docs, p, doc_id, text, ends(likely)))
        groups = spark.createDataFrame([], f"node {kind}, root {kind}")

        def connect(pairs: DataFrame) -> None:
            nonlocal groups
            known = groups.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
            # Written first, so that a task has one Python worker at a time.
            alike = ws.table(verified(pairs, sets, p).where(F.col("similarity") >= p.threshold).select("a", "b"))
            groups = ws.table(connected_components(ws, known.union(alike)))

        def across(pairs: DataFrame) -> DataFrame:
            """The pairs whose ends are in different groups."""
            ga, gb = groups.select(F.col("node").alias("a"), F.col("root").alias("ra")), groups.select(F.col("node").alias("b"), F.col("root").alias("rb"))
            return pairs.join(ga, "a", "left").join(gb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).drop("ra", "rb")

        def both(likely: DataFrame) -> None:
            """Each document's most alike and least partner come first; then all pairs that are still between groups."""
            best = likely.groupBy("b").agg(F.min(F.struct(-F.col("matches"), "a"))["a"].alias("most"), F.min("a").alias("low"))
            turn = ws.table(likely.join(best, "b").select("a", "b", ((F.col("a") == F.col("most")) | (F.col("a") == F.col("low"))).alias("now")))
            connect(turn.where("now"))
            rest = ws.table(across(turn.where("not now").select("a", "b")))
            if not rest.isEmpty():
                connect(rest)

        groups = ws.table(connected_components(ws, tied))
        both(likely)
        # Buckets that the stars left in several groups: there every pair across groups is a candidate.
        labelled = ws.table(members.join(groups, members.id == groups.node, "left").select("band", "id", F.coalesce("root", "id").alias("g"), "least", "n"))
        split = several(labelled, "band", "g").select("band")
        found = ws.table(within(sliced(labelled.join(split, "band", "left_semi"), sigs, p), p))
        if not found.isEmpty():
            sets = ws.table(sets.union(shingle_sets(ws, docs, p, doc_id, text, ends(found).join(sets.select("id"), "id", "left_anti"))))
            both(found)

        roots = groups.where("node <> root").select(F.col("node").alias("id"), F.col("root").alias("duplicate_of"))
        by_copy = copies.join(groups, copies.rep == groups.node, "left").select("id", F.coalesce("root", "rep").alias("duplicate_of"))
        out = by_copy.withColumn("exact", F.lit(True)).union(roots.withColumn("exact", F.lit(False)))
        return ws.keep(out.groupBy(F.col("id").alias("doc_id")).agg(F.min("duplicate_of").alias("duplicate_of"), F.max("exact").alias("exact")))


def drop_near_duplicates(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that near_duplicates() lists: the least id of each group stays, with all its rows.

    Rows with a null id or text stay, and so do texts without a word. Very long texts are read whole. An empty table
    gives no rows. Extra columns stay, whatever their names.
    """
    gone = near_duplicates(docs, p, doc_id, text).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
