"""A quality classifier by co-training: a view of the text and a view of the page's metadata teach each other.

1. Both views are logistic models: one of the text's make-up (shares of characters, words, lines), one of language,
   source and length. Each is fitted to labelled documents and calibrated on others held out. Each language and source
   that training sees has a weight of its own, by its whole value; values that it doesn't see share one.
2. In each round both views score all documents that have no label in the sample, where they lie. A view is confident of
   a document if its calibrated odds, less what the calibration's error may add, are `lift` times the labels' odds. Those that it is most confident of
   join the other view's training set, good and bad in the labels' proportion, with the calibrated probability as their
   label and with the share of a label's information that it holds as their weight: a view that knows little says little.
   Both are fitted and calibrated again.
3. A logistic model of the two calibrated log-odds, fitted on the documents held out, combines the views and scores
   every document.

Texts are read once, for the features of the text view, which are written as a table; rounds and scores read that. The
driver gets at most p.sample labelled documents, those of least hash, and in each round p.teach rows of each kind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Workspace, binary, kind_of, matrix, read, slices
from .features import SHAPES, sampled, shapes, sigmoid

#: Powers of two of a length, and their quarters.
SIZES = 40
#: The metadata view's columns before those of the known values: unknown language, unknown source, lengths, null length.
META = 2 + 5 * SIZES + 1


@dataclass(frozen=True)
class Params:
    """sample: most labelled documents. held: every so many of them are held out. lift: factor of the odds from which a view is confident. teach: most documents of a kind that a view gives in a round. keep: score from which a document is kept."""

    sample: int = 8000
    held: int = 4
    rounds: int = 4
    lift: float = 1.5
    teach: int = 400
    ridge: float = 1e-3
    keep: float = 0.5


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray | Kinds) -> np.ndarray:
        if isinstance(x, Kinds):
            return x.times(self.weights) + self.bias
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


@dataclass
class Kinds:
    """Rows of width columns that are 1 in the columns at[i] and else 0."""

    at: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, rows: np.ndarray) -> Kinds:
        return Kinds(self.at[rows], self.width)

    def times(self, v: np.ndarray) -> np.ndarray:
        return v[self.at].sum(1)

    def sums(self, v: np.ndarray) -> np.ndarray:
        """By column, the sum of v over the rows that have it."""
        return np.bincount(self.at.ravel(), np.repeat(v, self.at.shape[1]), self.width)


def fit_kinds(x: Kinds, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
    """Newton's method by conjugate gradients. Weights have a standard normal prior: a value seen once says little, one not seen nothing."""
    w, prior = np.zeros(x.width + 1), np.append(np.ones(x.width), 1e-9)
    by = np.ones(len(y)) if weight is None else weight
    for _ in range(50):
        q = sigmoid(x.times(w[:-1]) + w[-1])
        d = by * np.maximum(q * (1 - q), 1e-6)
        diagonal = np.append(x.sums(d), d.sum()) + prior
        rest = np.append(x.sums(by * (y - q)), (by * (y - q)).sum()) - prior * w
        move, z = np.zeros(len(w)), rest / diagonal
        to, rz = z, rest @ z
        for _ in range(500):
            if rz < 1e-20:
                break
            u = d * (x.times(to[:-1]) + to[-1])
            turned = np.append(x.sums(u), u.sum()) + prior * to
            step = rz / (to @ turned)
            move, rest = move + step * to, rest - step * turned
            z = rest / diagonal
            to, rz = z + (rest @ z) / rz * to, rest @ z
        move *= min(1.0, 5 / (np.abs(move).max() + 1e-12))
        w = w + move
        if np.abs(move).max() < 1e-6:
            break
    return Logistic(np.zeros(x.width), np.ones(x.width), w[:-1], float(w[-1]))


def fit_logistic(x: np.ndarray | Kinds, y: np.ndarray, ridge: float, weight: np.ndarray | None = None) -> Logistic:
    """Newton's method on standardised columns; a constant column gets no weight."""
    if isinstance(x, Kinds):
        return fit_kinds(x, y, weight)
    by = np.ones(len(y)) if weight is None else weight
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-6, scale, np.inf)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge * by.sum())
    penalty[-1] = 1e-9
    for _ in range(25):
        q = sigmoid(z @ w)
        h = (z * (by * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ z + np.diag(penalty)
        move = np.linalg.solve(h, z.T @ (by * (y - q)) - penalty * w)
        move *= min(1.0, 5 / (np.abs(move).max() + 1e-12))
        w = w + move
        if np.abs(move).max() < 1e-6:
            break
    return Logistic(mean, scale, w[:-1], float(w[-1]))


#: Columns by language, and by source.
Known = tuple[dict[str | None, int], dict[str | None, int]]


@dataclass
class Rows:
    """Documents as both views see them; at: the hash of the id. A size of -1 is null."""

    at: np.ndarray
    lang: list
    source: list
    size: np.ndarray
    text: np.ndarray

    def __len__(self) -> int:
        return len(self.at)

    def take(self, i: np.ndarray) -> Rows:
        return Rows(self.at[i], [self.lang[k] for k in i], [self.source[k] for k in i], self.size[i], self.text[i])

    def __add__(self, other: Rows) -> Rows:
        return Rows(np.concatenate([self.at, other.at]), self.lang + other.lang, self.source + other.source, np.concatenate([self.size, other.size]), np.concatenate([self.text, other.text]))

    @classmethod
    def of(cls, rows: pa.RecordBatch | pa.Table) -> Rows:
        t = rows.column("t")
        t = t if isinstance(t, pa.Array) else pa.concat_arrays(t.chunks) if t.num_chunks else pa.array([], pa.binary())
        return cls(rows.column("at").to_numpy(), rows.column("lang").to_pylist(), rows.column("source").to_pylist(), rows.column("size").fill_null(-1).to_numpy(), matrix(t, np.float16, SHAPES).astype(np.float32))


@dataclass
class Model:
    """trust: of each view, the part of its log-odds over the labels' that it may teach by. taught: by round, how many good and bad documents the text view gave, and the metadata view."""

    text: Logistic
    meta: Logistic
    text_scale: Logistic
    meta_scale: Logistic
    both: Logistic
    known: Known = ({}, {})
    trust: tuple[float, float] = (1.0, 1.0)
    taught: list[tuple[int, int, int, int]] = field(default_factory=list)

    def odds(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds that a document is good, by each view, calibrated, and by both."""
        a, b = self.text_scale(self.text(rows.text)[:, None]), self.meta_scale(self.meta(metadata(rows, self.known))[:, None])
        return a, b, self.both(np.stack([a, b], 1))


def seen(rows: Rows) -> Known:
    """A column for each language and each source, null being a value too."""
    langs, sources = (sorted(set(column), key=lambda v: (v is not None, v or "")) for column in (rows.lang, rows.source))
    return {v: META + i for i, v in enumerate(langs)}, {v: META + len(langs) + i for i, v in enumerate(sources)}


def metadata(rows: Rows, known: Known) -> Kinds:
    """The columns of language, source, and the length's power of two and its quarter; a null length has one of its own."""
    at = np.empty((len(rows), 4), np.int64)
    for k, column in enumerate((rows.lang, rows.source)):
        at[:, k] = [known[k].get(v, k) for v in column]
    size = np.log2(np.maximum(rows.size, 0) + 1.0)
    for k, parts, first in ((2, 1, 2), (3, 4, 2 + SIZES)):
        at[:, k] = np.where(rows.size < 0, META - 1, first + np.minimum((parts * size).astype(np.int64), parts * SIZES - 1))
    return Kinds(at, META + len(known[0]) + len(known[1]))


#: (view, class) to the documents that the view is most confident of, and its log-odds.
Given = dict[tuple[int, int], tuple[Rows, np.ndarray]]


def confident(rows: Rows, model: Model, prior: float, skip: tuple[np.ndarray, np.ndarray], p: Params) -> Given:
    """The p.teach documents of each kind that each view is most confident of, less those (skip) that it has no need to teach."""
    out = {}
    first = np.zeros(len(rows), bool)
    first[np.unique(rows.at, return_index=True)[1]] = True
    for view, odds in enumerate(model.odds(rows)[:2]):
        odds = prior + model.trust[view] * (odds - prior)
        free = first & ~np.isin(rows.at, skip[view])
        for good, by in ((1, odds - prior), (0, prior - odds)):
            i = np.flatnonzero(free & (by >= np.log(p.lift)))
            i = i[np.lexsort((rows.at[i], -by[i]))][: p.teach]
            out[view, good] = rows.take(i), odds[i]
    return out


def worth(q: np.ndarray, share: float) -> np.ndarray:
    """The information in probabilities q over that in the share of good labels, as a part of what a label of the same kind has."""
    q = np.clip(q, 1e-9, 1 - 1e-9)
    return np.clip((q * np.log(q / share) + (1 - q) * np.log((1 - q) / (1 - share))) / -np.log(np.where(q >= share, share, 1 - share)), 0, 1)


def trusted(x: np.ndarray, y: np.ndarray, scale: Logistic) -> float:
    """1 less 1.64 standard errors of a calibration's slope, as a part of it, 0 at least: what held-out documents vouch for."""
    q = sigmoid(scale(x[:, None]))
    z = np.stack([(x - scale.mean[0]) / scale.scale[0], np.ones(len(x))], 1)
    spread = np.linalg.inv((z * np.maximum(q * (1 - q), 1e-9)[:, None]).T @ z + 1e-9 * np.eye(2))[0, 0] ** 0.5
    return float(np.clip(1 - 1.64 * spread / max(scale.weights[0], 1e-12), 0, 1))


def train(rows: Rows, y: np.ndarray, p: Params, gather: Callable[[Model, float, tuple[np.ndarray, np.ndarray]], Given]) -> Model:
    """y: 1 good, 0 bad. gather(model, prior, skip) is confident() of all unlabelled documents. With one kind of label only, everything scores about its share."""
    held = np.arange(len(y)) % p.held == p.held - 1
    learn, check = np.flatnonzero(~held), np.flatnonzero(held)
    if len(set(y[learn].tolist())) < 2 or len(set(y[check].tolist())) < 2:
        known, rate = seen(rows), (np.sum(y == 1) + 1) / (len(y) + 2)
        flat = lambda n, b: Logistic(np.zeros(n), np.ones(n), np.zeros(n), b)
        prior = float(np.log(rate / (1 - rate)))
        return Model(flat(SHAPES, 0.0), flat(META + len(known[0]) + len(known[1]), 0.0), flat(1, prior), flat(1, prior), flat(2, prior), known)
    share = y[learn].mean()
    prior = float(np.log(share / (1 - share)))
    own, tests, truth = rows.take(learn), rows.take(check), y[check].astype(float)
    # By the view that is taught: rows, labels and weights.
    sets = [(own, y[learn].astype(float), np.ones(len(learn))) for _ in (0, 1)]
    counts: list[tuple[int, int, int, int]] = []

    def fitted() -> Model:
        known = seen(sets[0][0] + sets[1][0])
        text = fit_logistic(sets[0][0].text, sets[0][1], p.ridge, sets[0][2])
        meta = fit_logistic(metadata(sets[1][0], known), sets[1][1], p.ridge, sets[1][2])
        raw = text(tests.text), meta(metadata(tests, known))
        scales = [fit_logistic(x[:, None], truth, 1e-3) for x in raw]
        odds = np.stack([s(x[:, None]) for s, x in zip(scales, raw)], 1)
        trust = tuple(trusted(x, truth, s) for x, s in zip(raw, scales))
        # A view that held-out documents don't vouch for, or speak against, has no say.
        odds = odds * (np.array(trust) > 0)
        both = fit_logistic(odds, truth, 1e-3)
        if (both.weights < 0).any():
            both = fit_logistic(odds * (both.weights > 0), truth, 1e-3)
        return Model(text, meta, *scales, both, known, trust, counts)

    model = fitted()
    for _ in range(p.rounds):
        given = gather(model, prior, tuple(np.concatenate([rows.at, sets[1 - view][0].at]) for view in (0, 1)))
        count = []
        for view in (0, 1):
            good, bad = len(given[view, 1][0]), len(given[view, 0][0])
            # In the labels' proportion, so that an easy kind doesn't swamp the other.
            n = min(p.teach, good / share, bad / (1 - share))
            for kind, most in ((1, round(n * share)), (0, round(n * (1 - share)))):
                more, odds = given[view, kind]
                i = np.arange(min(most, len(more)))
                q = sigmoid(odds[i])
                old = sets[1 - view]
                sets[1 - view] = old[0] + more.take(i), np.concatenate([old[1], q]), np.concatenate([old[2], worth(q, share)])
                count.append(len(i))
        if not any(count):
            break
        counts.append(tuple(count))
        model = fitted()
    return model


def featured(docs: DataFrame, doc_id: str, text: str, lang: str, source: str, size: str) -> DataFrame:
    """(id, at, lang, source, size, t) of every row of docs, t being the text view's features."""
    kind = kind_of(docs, doc_id)
    names = ["id", "at", "lang", "source", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), binary(shapes(data, bounds))], [*names, "t"])

    chosen = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(doc_id).cast("string")).alias("at"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(size).cast("long").alias("size"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, at long, lang string, source string, size long, t binary")


def fit_featured(ws: Workspace, rows: DataFrame, labels: DataFrame, p: Params, doc_id: str, label: str) -> Model:
    """A model from featured() rows."""
    labelled = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
    some = F.broadcast(sampled(labelled, F.col("id"), p.sample))
    columns = ["at", "lang", "source", "size", "t"]
    picked = rows.join(some, "id").groupBy("id", "y").agg(F.min(F.struct(*columns)).alias("r")).select("y", "r.*").toArrow().sort_by("at").combine_chunks()
    pool, schema = rows.where("id is not null").select(*columns), "view int, good int, odds double, at long, lang string, source string, size long, t binary"

    def gather(model: Model, prior: float, skip: tuple[np.ndarray, np.ndarray]) -> Given:
        sent = ws.spark.sparkContext.broadcast((model, prior, skip))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, prior, skip = sent.value
            best: dict[tuple[int, int], tuple[Rows, np.ndarray]] = {}
            for batch in batches:
                for key, (more, odds) in confident(Rows.of(batch), model, prior, skip, p).items():
                    have = best.get(key, (more.take(np.zeros(0, np.int64)), odds[:0]))
                    more, odds = have[0] + more, np.concatenate([have[1], odds])
                    fresh = np.unique(more.at, return_index=True)[1]
                    fresh = fresh[np.lexsort((more.at[fresh], -np.abs(odds[fresh] - prior)))][: p.teach]
                    best[key] = more.take(fresh), odds[fresh]
            for (view, good), (r, odds) in best.items():
                n = len(r)
                yield pa.RecordBatch.from_arrays([pa.array([view] * n, pa.int32()), pa.array([good] * n, pa.int32()), pa.array(odds, pa.float64()), pa.array(r.at), pa.array(r.lang, pa.string()), pa.array(r.source, pa.string()), pa.array(r.size), binary(r.text.astype(np.float16))], ["view", "good", "odds", *columns])

        found = ws.table(pool.mapInArrow(run, schema)).dropDuplicates(["view", "good", "at"])
        out = {}
        for view in (0, 1):
            for good in (0, 1):
                top = found.where((F.col("view") == view) & (F.col("good") == good)).orderBy(F.desc(F.abs(F.col("odds") - prior)), "at").limit(p.teach).toArrow()
                out[view, good] = Rows.of(top), top.column("odds").to_numpy()
        sent.destroy()
        return out

    return train(Rows.of(picked), picked.column("y").to_numpy(), p, gather)


def scored(rows: DataFrame, model: Model, p: Params) -> DataFrame:
    sent, least = rows.sparkSession.sparkContext.broadcast(model), p.keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, both = (np.round(sigmoid(x), 4) for x in sent.value.odds(Rows.of(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= least)], ["doc_id", "text_score", "meta_score", "quality", "keep"])

    return rows.mapInArrow(run, f"doc_id {kind_of(rows, 'id')}, text_score double, meta_score double, quality double, keep boolean")


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", size: str = "n_chars", label: str = "quality") -> Model:
    """A model from p.sample labelled documents and all others. Rows with a null id aren't used; of several labels of an id the least counts, of several rows of an id the least, by its metadata, is learnt from."""
    with Workspace(docs.sparkSession) as ws:
        return fit_featured(ws, ws.table(featured(docs, doc_id, text, lang, source, size)), labels, p, doc_id, label)


def score(docs: DataFrame, model: Model, p: Params = Params(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", size: str = "n_chars") -> DataFrame:
    """(doc_id, text_score, meta_score, quality, keep) for every row of docs.

    Ids may be of any type. Nulls: a null text counts as empty, null metadata as values of their own; rows with a null
    id are scored too. Very long texts are read whole. Repeated rows have a row each. An empty table gives no rows. Other
    columns are not looked at, whatever their names.
    """
    return scored(featured(docs, doc_id, text, lang, source, size), model, p)


def classified(docs: DataFrame, labels: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", size: str = "n_chars", label: str = "quality") -> tuple[DataFrame, Model]:
    """fit() and score() of the same documents, whose texts are read once."""
    with Workspace(docs.sparkSession) as ws:
        rows = ws.table(featured(docs, doc_id, text, lang, source, size))
        model = fit_featured(ws, rows, labels, p, doc_id, label)
        return ws.keep(scored(rows, model, p)), model


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))[0]
