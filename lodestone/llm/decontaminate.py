"""Benchmark decontamination by one Aho-Corasick automaton over normalised test questions and answers.

Texts and benchmark items are normalised alike: words in lower case, one space between, all else dropped; in scripts
without spaces each character is a word. The patterns are an item's passages of `window` words, or the whole item if it is
shorter. Every text is normalised and scanned once, whole; a hit at word bounds is mapped back to characters of the
original text, and hits of one item that overlap or touch make one span. Items of fewer than `least` words are looked for
too, but their hits are marked as short: such words may well be there by chance.

The automaton grows with the benchmark alone. Passages are made by the executors; the driver reads them a group at a time,
each of `limit` characters at most, and sends each group on. A task scans a text by all groups' automata in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import LOWER, UPPER, WORD, Workspace, fold, kind_of, read, slices, texts, words


@dataclass(frozen=True)
class Params:
    """window: words of a passage. least: words below which an item's hits are marked as short. limit: characters of the patterns that are sent at once."""

    window: int = 13
    least: int = 8
    limit: int = 16 << 20


@dataclass
class Words:
    """Texts as one string, normalised, a newline after each; where each word starts in it, and in bytes of the texts."""

    joined: str
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def normalise(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Of the raw bytes of texts, text i being bounds[i] up to bounds[i + 1]."""
    low = fold(data)
    start, end = words(low, bounds)
    first = np.searchsorted(start, bounds)
    size = end - start
    off = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(off[-1], 32, np.uint8)
    inside = np.ones(off[-1], bool)
    inside[off[1:] - 1] = False
    take = np.zeros(len(low) + 1, np.int32)
    take[start] += 1
    take[end] -= 1
    out[inside] = low[np.cumsum(take[:-1]) > 0]
    last = first[1:][np.diff(first) > 0] - 1
    out[off[last + 1] - 1] = 10
    chars = np.cumsum((out & 0xC0) != 0x80)
    return Words(out.tobytes().decode("utf-8", "replace"), chars[off[:-1]] - 1, start, end, first)


def normal_words(text: str) -> list[str]:
    data, bounds = texts(pa.array([text]))
    return normalise(data, bounds).joined.split()


def passages(ws: Workspace, benchmark: DataFrame, p: Params, item_id: str, text: str) -> DataFrame:
    """(passage, items, g, short), g numbering the groups."""
    kind = kind_of(benchmark, item_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in slices(batches, "t"):
            w = normalise(data, bounds)
            said, of, short = w.joined.split(), [], []
            made = []
            for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                for j in range(a, max(a + 1, b - p.window + 1) if b > a else a):
                    made.append(" ".join(said[j : min(b, j + p.window)]))
                    of.append(i)
                    short.append(b - a < p.least)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), rows.column("i").take(pa.array(of, pa.int64())), pa.array(short, pa.bool_())], ["passage", "item", "short"])

    given = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    made = given.mapInArrow(run, f"passage string, item {kind}, short boolean").groupBy("passage", "short").agg(F.sort_array(F.collect_set("item")).alias("items"))
    made = ws.table(made)
    groups = max(1, -(-(made.agg(F.sum(F.length("passage"))).first()[0] or 0) // p.limit))
    return ws.table(made.withColumn("g", F.pmod(F.xxhash64("passage"), F.lit(groups)).cast("int")).repartition(min(groups, 200), "g").sortWithinPartitions("g"))


def senders(spark: SparkSession, benchmark: DataFrame, p: Params, item_id: str, text: str) -> list[Broadcast]:
    """A broadcast of (passage, short, items) for each group; the driver holds one group at a time."""
    with Workspace(spark) as ws:
        table = passages(ws, benchmark, p, item_id, text)
        out = []
        for (g,) in table.select("g").distinct().orderBy("g").collect():
            rows = table.where(F.col("g") == g).select("passage", "short", "items").toArrow()
            out.append(spark.sparkContext.broadcast(list(zip(*(rows.column(c).to_pylist() for c in ("passage", "short", "items"))))))
        return out


_built: dict[int, tuple] = {}


def automata(sent: list[Broadcast]) -> list[ahocorasick.Automaton]:
    """Built once in a worker."""
    keys = [id(b.value) for b in sent]
    if any(k not in _built for k in keys):
        _built.clear()
        for k, b in zip(keys, sent):
            a = ahocorasick.Automaton()
            for passage, short, items in b.value:
                # An item of few words and a passage of a longer one are never the same: the latter has window words.
                a.add_word(passage, (len(passage), passage.count(" ") + 1, short, items))
            a.make_automaton()
            _built[k] = (b.value, a)
    return [_built[k][1] for k in keys]


def hits(w: Words, found_by: list[ahocorasick.Automaton], shorts: bool = True) -> list[tuple[int, object, bool, int, int]]:
    """(text, item, short, first word, end word) of spans, words counted over all texts."""
    found: dict[tuple, list[tuple[int, int]]] = {}
    joined, at, first = w.joined, w.at, w.first
    for a in found_by:
        for last, (length, size, short, items) in a.iter(joined):
            begin = last + 1 - length
            if short and not shorts or joined[last + 1] not in " \n" or begin and joined[begin - 1] not in " \n":
                continue
            i = int(np.searchsorted(at, begin))
            doc = int(np.searchsorted(first, i, "right")) - 1
            for item in items:
                found.setdefault((doc, item, short), []).append((i, i + size))
    out = []
    for key, spans in found.items():
        spans.sort()
        low, high = spans[0]
        for i, j in spans[1:]:
            if i > high:
                out.append((*key, low, high))
                low, high = i, j
            high = max(high, j)
        out.append((*key, low, high))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, stop, short) for every span of characters [start, stop) of a text that passages of an item cover.

    short: the item has fewer than p.least words. Ids may be of any type. Nulls: rows of docs or of the benchmark whose
    id or text is null are left out. Empty texts have no hits; very long ones are scanned whole. Passages that several
    items share give a span for each. Repeated rows of docs each give theirs; repeated items count once; an item id with
    several texts is looked for by all. An empty table gives no rows. Other columns are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    kinds = kind_of(docs, doc_id), kind_of(benchmark, item_id)
    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    sent = senders(spark, benchmark, p, item_id, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = automata(sent)
        for rows, data, bounds in slices(batches, "text"):
            w = normalise(data, bounds)
            found = hits(w, by)
            if not found:
                continue
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            doc, item, short, i, j = zip(*found)
            doc, i, j = (np.array(x, np.int64) for x in (doc, i, j))
            base = chars[bounds[doc]]
            yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(doc)), pa.array(item), pa.array(chars[w.start[i]] - base), pa.array(chars[w.end[j - 1]] - base), pa.array(short)], ["doc_id", "item_id", "start", "stop", "short"])

    return chosen.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, start long, stop long, short boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), text: str = "text", item_id: str = "item_id", item_text: str = "text", shorts: bool = False) -> DataFrame:
    """The rows of docs without any hit, with their columns as they are. No exchange: a row is judged where it is read.

    shorts: whether items of fewer than p.least words count; by default they don't. Rows with a null or empty text stay;
    a null id doesn't matter. Very long texts are scanned whole. Repeated rows stay or go together. An empty table gives
    no rows, an empty benchmark all. Extra columns stay, whatever their names.
    """
    sent = senders(docs.sparkSession, benchmark, p, item_id, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = automata(sent)
        for rows, data, bounds in slices(batches, text):
            keep = np.ones(rows.num_rows, bool)
            keep[[x[0] for x in hits(normalise(data, bounds), by, shorts)]] = False
            yield rows.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def sql(docs: str = "documents", benchmark: str = "benchmark") -> str:
    """WITH clauses that end in dec_spans (n, id, item_id, start, stop, short), n numbering the rows of docs."""
    p = Params()
    found = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}')"
    leads = ", ".join(f"lead(w, {i}) over near as w{i}, lead(stop, {i}) over near as s{i}" for i in range(1, p.window))
    gram = lambda k: "concat_ws(' ', w" + "".join(f", w{i}" for i in range(1, k)) + ")"
    return rf"""dec_docs as (select row_number() over () as n, doc_id as id, text from {docs} where doc_id is not null and text is not null),
dec_words as (select n, id, unnest({found}) as w, unnest(regexp_split_to_array(text, '{WORD}')[1:len({found})]) as gap, generate_subscripts({found}, 1) as j from dec_docs),
dec_at as (select n, id, w, j, sum(length(gap) + length(w)) over (partition by n order by j) as stop from dec_words),
dec_items as (select distinct item_id, text, {found} as ws from {benchmark} where item_id is not null and text is not null),
dec_passages as (select distinct item_id, k, short, array_to_string(ws[j:j + k - 1], ' ') as passage from (select item_id, ws, len(ws) < {p.least} as short, least(len(ws), {p.window}) as k, unnest(range(1, greatest(2, len(ws) - {p.window} + 2))) as j from dec_items where len(ws) > 0)),
dec_near as (select n, id, j, w, stop, stop - length(w) as start, {leads} from dec_at window near as (partition by n order by j)),
dec_grams as ({" union all ".join(f"select n, id, j, start, {f's{k - 1}' if k > 1 else 'stop'} as stop, {k} as k, {gram(k)} as passage from dec_near" for k in range(1, p.window + 1))}),
dec_hits as (select distinct n, id, item_id, short, j, j + k as e, start, stop from dec_grams join dec_passages using (k, passage)),
dec_groups as (select *, sum(new) over (partition by n, item_id, short order by j, e) as g from (select *, case when j <= max(e) over (partition by n, item_id, short order by j, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from dec_hits)),
dec_spans as (select n, id, item_id, short, min(start)::bigint as start, max(stop)::bigint as stop from dec_groups group by n, id, item_id, short, g)"""


ORACLE = f"with {sql()}\nselect id as doc_id, item_id, start, stop, short from dec_spans"
