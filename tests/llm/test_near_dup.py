import random

import pytest
from cases import SCHEMA, WORD, clashing, empty, lettered, odd, rows

from lodestone.llm import base, components, near_dup
from lodestone.llm.near_dup import Params, drop_near_duplicates, least_matches, near_duplicates


def shingles(text, k=3):
    words = [w.lower() for w in WORD.findall(text)]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(docs, threshold):
    """The least id of each document's group."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [d for d in sets if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if len(x & y) >= threshold * len(x | y):
                a0, b0 = find(a), find(b)
                root[max(a0, b0)] = min(a0, b0)
    return {d: find(d) for d in sets}


def family(seed, n=120):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(3000)
    bases = [[word() for _ in range(r.randrange(30, 120))] for _ in range(12)]
    docs = []
    for i in range(n):
        words = list(r.choice(bases))
        for _ in range(r.randrange(0, 6)):
            words[r.randrange(len(words))] = word()
        docs.append((i, " ".join(words) if r.random() < 0.8 else " ".join(word() for _ in range(50))))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_and_precision(spark, seed):
    docs = family(seed)
    want = {d: g for d, g in brute(docs, 0.5).items() if d != g}
    got = {r.doc_id: r.duplicate_of for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    pairs = lambda m: {(d, g) for d, g in m.items()}
    assert len(pairs(got) & pairs(want)) >= 0.95 * len(want) > 0
    # What is grouped is verified, so no group is wrong.
    loose = brute(docs, 0.5)
    assert all(loose[d] == loose[g] for d, g in got.items())


def test_posterior_bound():
    p = Params()
    steps = least_matches(p)
    assert steps[-1][0] == p.hashes and all(0 < m < p.threshold * n for n, m in steps)


def test_odd_rows(spark):
    docs = odd(spark)
    assert rows(near_duplicates(docs)) == []
    kept = drop_near_duplicates(clashing(docs))
    assert kept.count() == docs.count() and kept.columns == clashing(docs).columns
    assert rows(near_duplicates(empty(spark))) == []
    copies = spark.createDataFrame([(i, "A b, c d", "", "", 0) for i in (4, 2, 9)] + [(7, "a B c d!", "", "", 0)], SCHEMA)
    assert rows(near_duplicates(copies)) == [(4, 2, True), (7, 2, True), (9, 2, True)]
    assert [r.doc_id for r in drop_near_duplicates(copies).collect()] == [2]


def found(spark, docs, p=Params()):
    return {r.doc_id: r.duplicate_of for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), p).collect()}


def test_every_pair_at_sure_bands(spark):
    """With bands of one hash no similar pair can be missed in practice, so that the result is exact."""
    docs = family(5, 90)
    p = Params(bands=192, rows=1, miss=1e-12)
    assert found(spark, docs, p) == {d: g for d, g in brute(docs, 0.5).items() if d != g}


@pytest.mark.parametrize("size", [2048, 7])
def test_crowded_buckets(spark, size, monkeypatch):
    """Texts that share a beginning but are not alike to the first of them: pairs are found within buckets that stars leave split, in cells of any size."""
    r = random.Random(9)
    words = lambda n: " ".join("v%d" % r.randrange(10**6) for _ in range(n))
    head = words(40)
    docs = [(i, head + " " + words(70)) for i in range(40)]
    docs += [(100 + i, t + " " + words(9)) for i, t in docs[1:30]]
    want = {d: g for d, g in brute(docs, 0.5).items() if d != g}
    assert len(want) == 29
    calls = []
    within = near_dup.within
    monkeypatch.setattr(near_dup, "within", lambda cells, p: (calls.append(cells.count()), within(cells, p))[1])
    p = Params(bands=192, rows=1, miss=1e-12, slice=size)
    assert found(spark, docs, p) == want and calls[0] > 40


def test_one_id_of_several_texts(spark):
    """Alike to whatever any of its texts is alike to, by copies and by near copies."""
    r = random.Random(4)
    a, b, c = (" ".join("u%d" % r.randrange(10**6) for _ in range(60)) for _ in range(3))
    docs = [(1, a), (2, b), (7, a), (7, b + " more"), (8, c), (8, c), (9, c + " less"), (7, None)]
    assert found(spark, docs) == {2: 1, 7: 1, 9: 8}
    assert sorted(r.doc_id for r in drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == [1, 8, 8]


def test_ids_of_letters(spark):
    docs = spark.createDataFrame(family(3, 60), "doc_id long, text string")
    got = {(r.doc_id, r.exact) for r in near_duplicates(lettered(docs)).collect()}
    # The least of a group by letters may be another than by number; the groups are the same in size.
    assert len(got) == near_duplicates(docs).count() and all(d.startswith("id-") for d, _ in got)


def test_unspaced_scripts(spark):
    text = "这是一个普通的句子后面还有另一个句子说的是同样平常的事情。"
    docs = [(1, text * 2), (2, text + text.replace("。", "！")), (3, text * 2 + "完全"), (4, "別的文字没有相同之处的一段話，寫得不一樣。" * 2)]
    assert found(spark, docs) == {2: 1, 3: 1}


@pytest.mark.parametrize("chunk", [1, 5, 10**6])
def test_components(spark, chunk):
    r = random.Random(chunk)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    with base.Workspace(spark) as ws:
        df = spark.createDataFrame(edges, "a long, b long").repartition(7)
        got = sorted(map(tuple, components.connected_components(ws, df, chunk).collect()))
        assert got == sorted((x, find(x)) for x in root)
        assert components.connected_components(ws, df.limit(0)).count() == 0
        assert ws.n > 4
