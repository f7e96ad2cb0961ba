import random

import numpy as np
import pytest
from cases import SCHEMA, WORD, clashing, empty, lettered, odd, rows

from lodestone.llm import repeats
from lodestone.llm.repeats import Params, RunIndex, repeated_passages


def brute(docs, length):
    """Covered words of each document: (id, start, stop) of the word."""
    places, seen = {}, {}
    for i, (d, t) in enumerate(docs):
        words = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(t)]
        places[i] = words
        for j in range(len(words) - length + 1):
            seen.setdefault(tuple(w[2] for w in words[j : j + length]), []).append((i, j))
    out = set()
    for at in seen.values():
        if len(at) > 1:
            out |= {(docs[i][0], *places[i][k][:2]) for i, j in at for k in range(j, j + length)}
    return out


def covered(docs, spans):
    by = {}
    for d, a, b in spans:
        by.setdefault(d, []).append((a, b))
    return {(d, m.start(), m.end()) for d, t in docs for m in WORD.finditer(t) if any(a <= m.start() and m.end() <= b for a, b in by.get(d, []))}


def corpus(seed, n=60, vocabulary=400):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(vocabulary)
    shared = [[word() for _ in range(r.randrange(8, 40))] for _ in range(6)]
    docs = []
    for i in range(n):
        words = [word() for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(3)):
            p = r.choice(shared)
            at = r.randrange(len(words) + 1)
            cut = r.randrange(len(p))
            words[at:at] = p[cut:] if r.random() < 0.3 else p
        if r.random() < 0.1 and docs:
            words = docs[-1][1].split()
        docs.append((i, " ".join(words)))
    return docs


@pytest.mark.parametrize(("seed", "crowd", "batch"), [(1, 1000, 200), (2, 1000, 10**6), (3, 4, 500), (4, 0, 500)])
def test_against_brute_force(spark, seed, crowd, batch):
    docs = corpus(seed)
    p = Params(length=10, gram=3, batch=batch, crowd=crowd)
    found = [tuple(r) for r in repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), p).collect()]
    assert covered(docs, found) == brute(docs, 10)
    assert found


def test_repetitive_text(spark):
    docs = [(1, "a b " * 40), (2, "a " * 30 + "c " * 30), (3, "x y z")]
    found = [tuple(r) for r in repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), Params(length=10, gram=3)).collect()]
    assert covered(docs, found) == brute(docs, 10)


def test_statistics_of_the_index():
    r = np.random.default_rng(5)
    for _ in range(20):
        t = np.concatenate([r.integers(1, 4, r.integers(1, 60)), [0]])
        n = len(t)
        want = [max([0, *(next((k for k in range(n) if max(i, j) + k >= n or t[i + k] != t[j + k]), 0) for j in range(n) if j != i)]) for i in range(n)]
        index = RunIndex.of(t)
        assert index.statistics(n).tolist() == want
        assert index.runs[1].sum() == n and (index.runs[0][1:] != index.runs[0][:-1]).all()


def test_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    pairs = [tuple(r) for r in docs.collect()]
    found = [tuple(r) for r in repeated_passages(docs).collect()]
    assert covered(pairs, found) == brute(pairs, 50)


def test_odd_rows(spark):
    found = rows(repeated_passages(odd(spark)))
    # The long text repeats within itself; no other text has 50 words.
    assert {r[0] for r in found} == {6}
    assert rows(repeated_passages(clashing(odd(spark)))) == found
    assert rows(repeated_passages(empty(spark))) == []
    twice = spark.createDataFrame([(1, "w " + " ".join(map(str, range(60))), "", "", 0)] * 2, SCHEMA)
    assert rows(repeated_passages(twice)) == [(1, 0, len("w " + " ".join(map(str, range(60)))))]


def test_one_id_of_two_texts(spark):
    """A passage is found wherever it is, if other texts have its document's id."""
    shared = " ".join(f"s{i}" for i in range(60))
    docs = [(1, "start " + shared), (1, "another text of the same id"), (2, "x y z " + shared), (3, "alone " * 10)]
    apart = [(i, t) for i, (_, t) in enumerate(docs)]
    for crowd in (4000, 0):
        p = Params(crowd=crowd)
        got, want = (rows(repeated_passages(spark.createDataFrame(x, "doc_id long, text string"), p)) for x in (docs, apart))
        assert got == [(1, *want[0][1:]), (2, *want[1][1:])] and len(want) == 2


def test_ids_of_letters(spark):
    docs = spark.createDataFrame(corpus(6, 30), "doc_id long, text string")
    p = Params(length=10, gram=3)
    assert rows(repeated_passages(lettered(docs), p)) == sorted(((f"id-{d}", a, b) for d, a, b in rows(repeated_passages(docs, p))), key=repr)


def test_punctuation_and_unspaced_scripts(spark):
    words = [f"s{i}" for i in range(60)]
    docs = [(1, " ".join(words)), (2, "\u201c" + ",\u00a0".join(words) + "\u201d"), (3, "\u3000".join(words).upper())]
    assert {r[0] for r in rows(repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")))} == {1, 2, 3}
    passage = "".join(chr(0x4E00 + 7 * i) for i in range(60))
    docs = [(1, "前" + passage), (2, passage[:30] + "。" + passage[30:]), (3, passage[:40])]
    assert rows(repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"))) == [(1, 1, 61), (2, 0, 61)]


def test_slide():
    x = np.array([5, 3, 8, 1, 9, 2], np.uint64)
    for w in range(1, 7):
        want = [min(x[i : i + w]) if i + w <= 6 else None for i in range(6)]
        got = repeats.slide(x, w, np.minimum, 2**64 - 1)
        assert all(a is None or a == b for a, b in zip(want, got))
