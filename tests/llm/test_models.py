import math
import random

import numpy as np
from cases import SCHEMA, WORD, clashing, empty, lettered, odd, rows
from pyspark.sql import functions as F

from lodestone.llm import base, co_training, toxicity
from lodestone.llm.features import sentences, shapes

CURSES = ["foulword", "nastyterm", "badname"]


def toxic_corpus(spark, n=900, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        parts = [" ".join("w%d" % r.randrange(800) for _ in range(r.randrange(3, 9))) for _ in range(r.randrange(1, 12))]
        bad = r.random() < 0.25
        if bad:
            k = r.randrange(len(parts))
            parts[k] = parts[k] + " " + r.choice(CURSES) + " end"
        docs.append((i, ". ".join(parts) + "."))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels), dict(docs)


def test_toxicity_held_out(spark):
    docs, labels, truth, texts = toxic_corpus(spark)
    p = toxicity.Params(rounds=20)
    model = toxicity.fit(docs.where("doc_id < 600"), labels, p)
    got = {r.doc_id: r for r in toxicity.score(docs.where("doc_id >= 600"), model, p).collect()}
    right = sum(r.toxic == bool(truth[i]) for i, r in got.items())
    assert right >= 0.95 * len(got)
    found = [(texts[i][s.start : s.stop]) for i, r in got.items() if r.toxic and truth[i] for s in r.spans]
    assert sum(any(c in f for c in CURSES) for f in found) >= 0.9 * len(found) > 0


def test_noisy_or():
    first = np.array([0, 2, 2, 3])
    assert np.allclose(toxicity.noisy_or(np.array([0.5, 0.5, 0.2]), first), [0.75, 0, 0.2])


def test_sentences_do_not_cross_texts():
    texts = ["One two. Three!", "", "Été 3.5 kg\nmore", "..."]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    s = sentences(data, bounds, 16)
    assert s.first.tolist() == [0, 2, 2, 4, 4]
    assert [data[a:b].tobytes().decode().strip() for a, b in zip(s.start, s.end)] == ["One two.", "Three!", "Été 3.5 kg", "more"]
    assert shapes(data, bounds).shape == (4, 140) and np.isfinite(shapes(data, bounds)).all()


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learn = labels.where(F.col("doc_id") < 600)
    model = co_training.fit(docs, learn)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = [r.keep == bool(truth[r.doc_id]) for r in co_training.score(docs, model).collect() if truth.get(r.doc_id) is not None and r.doc_id >= 600]
    assert sum(right) >= 0.9 * len(right) > 0


def made(y, r, noise, words=19):
    """Documents whose text and source each say something about y, independently."""
    n = len(y)
    text = np.zeros((n, co_training.SHAPES), np.float32)
    text[:, 0] = y + r.normal(0, noise, n)
    text[:, 1 : 1 + words] = r.normal(0, 1, (n, words))
    right = r.random(n) < 0.97
    return co_training.Rows(np.arange(n), ["en"] * n, ["good" if a == b else "bad" for a, b in zip(y, right)], np.full(n, 500), text)


def test_views_teach_each_other():
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 6000)
    docs = made(y, r, 0.5, 60)
    own, rest, test = docs.take(np.arange(160)), docs.take(np.arange(160, 4000)), docs.take(np.arange(4000, 6000))
    p = co_training.Params(teach=500)
    gather = lambda model, prior, skip: co_training.confident(rest, model, prior, skip, p)
    model = co_training.train(own, y[:160], p, gather)
    alone = co_training.train(own, y[:160], co_training.Params(rounds=0), gather)
    accuracy = lambda m, k: np.mean((m.odds(test)[k] > 0) == y[4000:])
    text_gave, meta_gave = (sum(sum(t[k : k + 2]) for t in model.taught) for k in (0, 2))
    assert text_gave > 100 and meta_gave > 100 and all(min(t) >= 0 for t in model.taught) and alone.taught == []
    # The text view learns from what the metadata view is sure of, on documents that neither has seen.
    assert accuracy(model, 0) > accuracy(alone, 0) + 0.05
    assert accuracy(model, 2) >= accuracy(alone, 2) and accuracy(model, 2) > 0.95


def test_a_view_that_knows_nothing_says_nothing():
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 3000)
    docs = made(y, r, 0.3)
    docs.source = [f"s{k}" for k in r.integers(0, 5, 3000)]
    own, rest = docs.take(np.arange(400)), docs.take(np.arange(400, 3000))
    p = co_training.Params()
    gather = lambda m, prior, skip: co_training.confident(rest, m, prior, skip, p)
    model, alone = (co_training.train(own, y[:400], x, gather) for x in (p, co_training.Params(rounds=0)))
    given = [t[2] + t[3] for t in model.taught]
    assert model.trust[0] > 0.5 and (model.trust[1] < 0.3 or not any(given))
    accuracy = lambda m: np.mean((m.odds(rest)[2] > 0) == y[400:])
    assert accuracy(model) > accuracy(alone) - 0.01 and accuracy(model) > 0.9


def test_worth_of_a_probability():
    assert np.allclose(co_training.worth(np.array([0.8, 1.0, 0.0]), 0.8), [0, 1, 1], atol=1e-6)
    assert 0 < co_training.worth(np.array([0.6]), 0.8)[0] < 0.2


def test_teachers_are_the_same_by_partitions_and_alone(spark):
    """What the cluster gathers is what one machine would; every document can teach, and a repeated one teaches once."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("doc_id % 3 = 0")
    p = co_training.Params(teach=50)
    _, model = co_training.classified(docs.union(docs.limit(40)).repartition(7), labels, p)
    _, again = co_training.classified(docs.coalesce(1), labels, p)
    assert model.taught == again.taught and np.allclose(model.text.weights, again.text.weights)
    rows_ = co_training.Rows.of(co_training.featured(docs, "doc_id", "text", "lang", "source", "n_chars").toArrow())
    gave = co_training.confident(rows_, model, 1.0, (rows_.at[:10], rows_.at[:0]), p)
    assert not set(gave[0, 1][0].at) & set(rows_.at[:10]) and all(len(r) <= 50 for r, _ in gave.values())


def plain_shapes(text):
    """The text view's features, a loop over characters."""
    raw = text.encode()
    size = max(1, len(raw))
    low = "".join(c.lower() if c in base.UPPER else c for c in text)
    words = WORD.findall(low)
    n, have = len(words), max(1, len(words))
    out = [(sum(min(b, 128) == k for b in raw) / size) ** 0.5 for k in range(129)]
    out += [sum(len(w.encode()) for w in words) / have / 10, sum(len(w.encode()) > 12 for w in words) / have, len(set(words)) / have]
    marks = sum(33 <= b < 127 and not chr(b).isalnum() for b in raw)
    upper, lower = sum(65 <= b < 91 for b in raw), sum(97 <= b < 123 for b in raw)
    out += [np.log1p(raw.count(b"\n")) / np.log1p(have), upper / max(1, upper + lower), marks / size, marks / have, float(n == 0), sum(48 <= b < 58 for b in raw) / size, sum(b >= 128 for b in raw) / size, np.log1p(n) / 10]
    return np.array(out, np.float32).astype(np.float16).astype(float)


def plain_quality(row, m):
    """A document's three scores by a model, in plain Python."""
    logit = lambda x: 1 / (1 + math.exp(-min(30, max(-30, x))))
    linear = lambda f, x: f.bias + sum((a - mean) / scale * w for a, mean, scale, w in zip(x, f.mean, f.scale, f.weights))
    size = row.n_chars
    at = [m.known[0].get(row.lang, 0), m.known[1].get(row.source, 1)]
    at += [co_training.META - 1] * 2 if size is None else [2 + min(39, int(math.log2(size + 1))), 2 + 40 + min(159, int(4 * math.log2(size + 1)))]
    a = linear(m.text_scale, [linear(m.text, plain_shapes(row.text or ""))])
    b = linear(m.meta_scale, [m.meta.bias + sum(m.meta.weights[k] for k in at)])
    return logit(a), logit(b), logit(linear(m.both, [a, b]))


def test_quality_scores_by_brute_force(spark):
    docs = odd(spark).union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*odd(spark).columns).limit(60))
    model = co_training.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    got = sorted(([r.text_score, r.meta_score, r.quality] for r in co_training.score(docs, model).collect()), key=repr)
    want = sorted(([round(x, 4) for x in plain_quality(r, model)] for r in docs.collect()), key=repr)
    assert model.text.weights.any() and np.allclose(got, want, atol=2e-3)


def plain_sentences(text):
    """(start, stop) of the sentences with a word."""
    out, begin = [], 0
    for i, c in enumerate(text):
        last = i + 1 == len(text)
        if c == "\n" or last or c in ".!?" and text[i + 1] in " \n\t\r":
            found = [(begin + m.start(), begin + m.end()) for m in WORD.finditer(text[begin : i + 1])]
            if found:
                out.append((found[0][0], i + 1))
            begin = i + 1
    return out


def test_toxicity_scores_by_brute_force(spark):
    """Every sentence's score, the documents' noisy-or and the offending spans, by plain loops over a fixed model."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(odd(spark).select("doc_id", "text").where("doc_id is null or doc_id <> 6"))
    p = toxicity.Params(bits=12)
    r = np.random.default_rng(7)
    model = toxicity.Model(r.normal(0, 0.35, 1 << p.bits).astype(np.float32), -3.0, 0.6)

    def columns(sentence):
        raw = "".join(c.lower() if c in base.UPPER else c for c in sentence).encode()
        low = raw.decode()
        s = base.scan(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert [raw[a:b].decode() for a, b in zip(s.start, s.end)] == WORD.findall(low)
        codes = set()
        for h in (s.hashes, *(s.beginnings(k) for k in (3, 5, 7))):
            codes |= set((base.mix(h) & np.uint64((1 << p.bits) - 1)).tolist())
        return codes

    want = []
    for row in docs.collect():
        text = row.text or ""
        spans = plain_sentences(text)
        each = [1 / (1 + math.exp(-(model.bias + sum(float(model.weights[c]) for c in columns(text[a:b]))))) for a, b in spans]
        whole = 1 - math.prod(1 - x for x in each)
        toxic = whole >= model.threshold
        guilty = [(a, b, round(x, 3)) for (a, b), x in zip(spans, each) if x >= min(p.guilty, max(each))] if toxic else []
        want.append((row.doc_id, round(whole, 3), toxic, guilty))
    got = [(r.doc_id, round(r.score, 3), r.toxic, [(s.start, s.stop, round(s.score, 3)) for s in r.spans]) for r in toxicity.score(docs, model, p).collect()]
    assert sum(w[2] for w in want) > 20 and len(got) == len(want)
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert g[0] == w[0] and abs(g[1] - w[1]) <= 0.002 and g[2] == w[2] and [x[:2] for x in g[3]] == [x[:2] for x in w[3]], (g, w)


def test_gradient_of_noisy_or():
    """toxicity.gradient() against finite differences of the documents' likelihood."""
    r = np.random.default_rng(3)
    columns, at, first = r.integers(0, 20, 60), np.arange(0, 61, 5), np.array([0, 3, 3, 7, 12])
    labels, w, bias = np.array([1, 0, 0, 1]), r.normal(0, 0.5, 20), -0.7

    def loss(w, bias):
        q = toxicity.noisy_or(toxicity.Model(w, bias, 0).scores(columns, at), first)
        return -np.mean(np.where(labels > 0, np.log(np.maximum(q, 1e-12)), np.log(1 - q)))

    grad, slope = toxicity.gradient(w, bias, columns, at, first, labels)
    for k in range(20):
        step = np.eye(20)[k] * 1e-6
        assert abs((loss(w + step, bias) - loss(w - step, bias)) / 2e-6 - grad[k]) < 1e-5
    assert abs((loss(w, bias + 1e-6) - loss(w, bias - 1e-6)) / 2e-6 - slope) < 1e-5


def test_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 1, 1), (5, None, None), (5, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    for module in (co_training, toxicity):
        model = module.fit(docs, labels)
        got = rows(module.score(docs, model))
        assert len(got) == docs.count() and rows(module.score(clashing(docs), model)) == got
        assert rows(module.score(empty(spark), model)) == []
        none = module.fit(empty(spark), labels.limit(0))
        assert len(rows(module.score(docs, none))) == docs.count()
        letters = module.fit(lettered(docs), lettered(labels))
        assert rows(module.score(lettered(docs), letters)) == rows(lettered(module.score(docs, letters)))


def test_every_source_has_a_weight_of_its_own(spark):
    """Ends alike, and more values than any few hashed columns hold; text and length say nothing."""
    hosts = [f"{chr(97 + i // 10)}{i % 10}.example.com" for i in range(100)]
    docs = [(i, "the same words in every text", "en" if i % 2 else "de", hosts[i // 10 % 100], 28) for i in range(4000)]
    labels = [(i, int(hosts.index(s) % 2 == 0)) for i, _, _, s, _ in docs]
    table = spark.createDataFrame(docs, SCHEMA)
    model = co_training.fit(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert co_training.metadata(co_training.Rows(np.zeros(3, np.int64), ["en"] * 3, hosts[:3], np.array([-1, 9_000_000, 0]), None), model.known).at[:, 2:].tolist() == [[co_training.META - 1] * 2, [2 + 23, 42 + 92], [2, 42]]
    got = {r.doc_id: r.meta_score for r in co_training.score(table, model).collect()}
    assert all(got[i] > 0.9 if y else got[i] < 0.1 for i, y in labels)
    unseen = [(1, "the same words in every text", "en", s, 28) for s in ("new.example.com", "other.example.com", "a0.example.com")]
    new = {r.doc_id: r.meta_score for r in co_training.score(spark.createDataFrame([(k, *u[1:]) for k, u in enumerate(unseen)], SCHEMA), model).collect()}
    assert new[0] == new[1] and 0.2 < new[0] < 0.8 and new[2] > 0.9


def test_newton_by_conjugate_gradients():
    r = np.random.default_rng(3)
    at = np.stack([r.integers(0, 5, 400), 5 + r.integers(0, 60, 400)], 1)
    y = (r.random(400) < 0.3 + 0.5 * (at[:, 0] == 2)).astype(float)
    x = co_training.Kinds(at, 70)
    got = co_training.fit_kinds(x, y)
    rest = y - 1 / (1 + np.exp(-got(x)))
    assert np.allclose(x.sums(rest), got.weights, atol=1e-5) and abs(rest.sum()) < 1e-5
    assert (got.weights[65:] == 0).all() and got.weights[2] == got.weights[:65].max()
