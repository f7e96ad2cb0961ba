import json
import math

import pytest

from lodestone.operators import metrics, search
from lodestone.plans.evaluate import evaluate
from lodestone.sources import benchmarks
from lodestone.streaming.incremental import follow, snapshot_of


def test_bm25_by_hand(spark):
    docs = [(1, "the cat the mat"), (2, "the dog"), (3, ""), (4, "a b c d e f g h")]
    index = search.TextIndex.of(spark.createDataFrame(docs, "id long, search_text string"))
    got = {r.id: r.score for r in index.scores(spark.createDataFrame([(0, "The cat, the!")], "query int, text string")).collect()}
    words = {i: t.split() for i, t in docs}
    mean = sum(map(len, words.values())) / 4

    def score(i):
        out = 0
        for term in ("the", "cat"):
            df = sum(term in w for w in words.values())
            tf = words[i].count(term)
            out += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
        return out

    assert got == {i: pytest.approx(score(i)) for i in (1, 2)}


def test_terms_reach_the_scan(spark, tmp_path):
    """A written index gives what one in memory does, and a query's terms are pushed down to it."""
    docs = spark.createDataFrame([(i, f"word{i % 50} common w{i}") for i in range(3000)], "id long, search_text string")
    index = search.TextIndex.of(docs)
    index.write(str(tmp_path / "x"), 8)
    read = search.TextIndex.read(spark, str(tmp_path / "x"))
    got = read.of_terms(search.words_of("Word7, W57!"))
    want = index.scores(spark.createDataFrame([(0, "Word7, W57!")], "query int, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [In(term, [w57,word7])") >= 2 and "Exchange rangepartitioning" not in plan
    assert read.of_terms([]).count() == 0 and search.words_of("Ça va_bien? 12") == ["ça", "va", "bien", "12"]


def test_cells_of_vectors(spark, tmp_path):
    """Every vector is in a cell; few cells find nine of ten nearest, all cells all."""
    import numpy as np

    r = np.random.default_rng(3)
    m = r.normal(size=(40, 16))[r.integers(0, 40, 4000)] + 0.5 * r.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(9000, None), (9001, [0.0] * 16)], "id long, embedding array<float>")
    index = search.VectorIndex.fitted(df, 32, sample=1000)
    index.write(str(tmp_path / "x"))
    index = search.VectorIndex.read(spark, str(tmp_path / "x"))
    assert index.vectors.count() == 4000 and len(index.centres) == 32
    some = df.where("id % 50 = 0")
    exact = {(x.query, x.id) for x in search.nearest_all(df, some, 10).collect()}
    found = index.top_all(some, 10, 6).collect()
    assert len({(x.query, x.id) for x in found} & exact) >= 0.9 * len(exact) and len(found) == len(exact)
    assert {(x.query, x.id) for x in index.top_all(some, 10, 32).collect()} == exact
    one = index.top(m[50], 10, 6)
    assert [x.id for x in one.collect()] == [x.id for x in sorted((x for x in found if x.query == 50), key=lambda x: x["rank"])]
    assert "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().executedPlan().toString() or "cell#" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1][:80]
    assert search.VectorIndex.fitted(df.limit(0), 4).vectors.count() == 0


def test_fusion_prefers_both_lists(spark):
    a = spark.createDataFrame([("alpha", 2.0), ("gamma", 1.0)], "id string, score double")
    b = spark.createDataFrame([("gamma", 0.9), ("beta", 0.8)], "id string, score double")
    got = {r.id: r.score for r in search.fused(a, b).collect()}
    assert got == {"gamma": pytest.approx(1 / 62 + 1 / 61), "alpha": pytest.approx(1 / 61), "beta": pytest.approx(1 / 62)}


def test_nearest_of_all(spark):
    import numpy as np

    m = np.random.default_rng(1).normal(size=(90, 6))
    m[5] = m[4]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(100, None), (101, [0.0] * 6)], "id long, embedding array<double>").repartition(3)
    got = {}
    for r in search.nearest_all(df, df, 4, block=16).collect():
        got.setdefault(r.query, {})[r["rank"]] = r.id
    u = m / np.linalg.norm(m, axis=1)[:, None]
    d = np.round(1 - u @ u.T, 9)
    assert {q: [x[k] for k in (1, 2, 3, 4)] for q, x in got.items()} == {q: sorted(range(90), key=lambda j: (d[q, j], j))[:4] for q in range(90)}


def test_metrics(spark):
    judged = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (1, "c", 0.0), (2, "a", 0.0)], "query int, doc string, gain double")
    hits = spark.createDataFrame([(1, "c", 1), (1, "c", 2), (1, "b", 3), (1, "x", 4), (1, "a", 5), (2, "a", 1)], "query int, doc string, rank int")
    ranked = metrics.by_note(hits)
    assert [tuple(r) for r in ranked.where("query = 1").orderBy("rank").select("doc", "rank").collect()] == [("c", 1), ("b", 2), ("x", 3), ("a", 4)]
    one, two = metrics.per_query(ranked, judged).orderBy("query").collect()
    best = 2 + 1 / math.log2(3)
    assert (one.ndcg, one.recall, one.mrr) == (pytest.approx((1 / math.log2(3) + 2 / math.log2(5)) / best), 1.0, 0.5)
    assert (two.ndcg, two.recall, two.mrr) == (0.0, None, 0.0)
    assert metrics.means(ranked, judged).first().recall == 1.0


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id": "d1", "title": "T", "text": "x"}\n')
    (tmp_path / "q.jsonl").write_text('{"_id": "q1", "text": "x"}\n')
    (tmp_path / "r.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\n")
    assert benchmarks.read_corpus(spark, str(tmp_path / "c.jsonl")).collect() == [("d1", "T", "x")]
    assert benchmarks.read_queries(spark, str(tmp_path / "q.jsonl")).collect() == [("q1", "x")]
    assert benchmarks.read_judgements(spark, str(tmp_path / "r.tsv")).collect() == [("q1", "d1", 2.0)]


def test_stream_keeps_a_snapshot(spark, tmp_path):
    schema = "id string, body string, at long, deleted boolean"
    (tmp_path / "in").mkdir()
    seen = []
    empty = spark.createDataFrame([], "id string, body string")

    def run():
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = follow(stream, tmp_path / "out", empty, lambda df: seen.append(sorted(map(tuple, df.collect())))).trigger(availableNow=True).start()
        q.awaitTermination()

    (tmp_path / "in/1.json").write_text('{"id":"a","body":"1","at":1}\n{"id":"b","body":"1","at":1}\n{"id":"a","body":"2","at":2}\n')
    run()
    (tmp_path / "in/2.json").write_text('{"id":"b","at":3,"deleted":true}\n{"id":"c","body":"1","at":3}\n')
    run()
    assert seen == [[("a", "2"), ("b", "1")], [("a", "2"), ("c", "1")]]
    # A batch rewrites the parts of its keys only, and what no part is in any more goes.
    (tmp_path / "in/3.json").write_text('{"id":"c","body":"2","at":4}\n')
    run()
    assert seen[-1] == [("a", "2"), ("c", "2")] == sorted(map(tuple, snapshot_of(spark, tmp_path / "out", empty).collect()))
    state = json.loads((tmp_path / "out/state.json").read_text())
    used = {f.partition("/")[0] for f in [*state["folders"].values(), *state["before"].values()]}
    assert "batch-2" in used and {p.name for p in (tmp_path / "out").glob("batch-*")} == used


def test_evaluation_of_a_judged_collection(spark, tmp_path):
    """Full-text, vector and hybrid lists of notes against hand-made judgements."""
    topics = ["rivers and lakes", "engines and pistons", "breads and ovens", "stars and comets"]
    corpus = [(f"d{i}", f"T{i}", f"# Part\n\nOn {topics[i % 4]} in year {i}.\n\n## More\n\nNothing here {i}.") for i in range(40)]
    queries = [(f"q{k}", t) for k, t in enumerate(topics)] + [("unjudged", "rivers")]
    judged = [(f"q{k}", f"d{i}", 1.0) for k in range(4) for i in range(k, 40, 4)]

    class Topics:
        id, dimensions = "topics", 4

        def embed_query(self, text):
            return [float(t.split()[0] in text) for t in topics]

        def embed_documents(self, texts):
            return [self.embed_query(t) for t in texts]

    frames = (spark.createDataFrame(corpus, "doc string, title string, text string"), spark.createDataFrame(queries, "query string, text string"), spark.createDataFrame(judged, "query string, doc string, gain double"))
    got = {r.mode: r for r in evaluate(spark, str(tmp_path / "x"), *frames, Topics()).collect()}
    assert set(got) == {"fts", "vector", "hybrid"} and all(r.queries == 4 and r.ndcg == r.mrr == pytest.approx(1.0) and r.recall == 1.0 for r in got.values())
    short = evaluate(spark, str(tmp_path / "y"), *frames, limit=5).collect()
    assert [(r.mode, r.recall) for r in short] == [("fts", 0.5)] and 0.6 < short[0].ndcg < 0.7


def test_words_of_a_long_text_are_counted_in_proportion(spark):
    """Each of 60,000 different words was compared with all of them."""
    import time

    text = " ".join(f"w{i} w{i // 2}" for i in range(60_000))
    index = search.TextIndex.of(spark.createDataFrame([(1, text), (2, "b a b"), (3, "..."), (4, None)], "id long, search_text string"))
    began = time.time()
    got = {(r.id, r.term): (r.tf, r.length) for r in index.postings.collect()}
    assert time.time() - began < 40
    want = {}
    for w in text.split():
        want[1, w] = want.get((1, w), 0) + 1
    assert got == {k: (n, 120_000) for k, n in want.items()} | {(2, "a"): (1, 3), (2, "b"): (2, 3)}
    assert index.totals.first().n == 4


def test_terms_are_counted_from_written_postings(spark, tmp_path):
    search.TextIndex.of(spark.createDataFrame([(1, "a b a"), (2, "b c")], "id long, search_text string")).write(str(tmp_path / "x"))
    read = search.TextIndex.read(spark, str(tmp_path / "x"))
    assert sorted(map(tuple, read.terms.collect())) == [("a", 1), ("b", 2), ("c", 1)]
    assert sorted(p.name for p in (tmp_path / "x").iterdir()) == ["postings", "terms", "totals"]


def test_scores_of_few_and_of_many_queries(spark, monkeypatch):
    """Few are sent to all tasks, many joined; a chunk's postings are exchanged before they meet few."""
    index = search.TextIndex.of(spark.createDataFrame([(i, f"a b{i % 3} c{i}") for i in range(30)], "id long, search_text string"))
    queries = spark.createDataFrame([(1, "a b1"), (2, "c3 a"), (3, "nothing")], "query long, text string")
    few = index.scores(queries)
    assert "hashpartitioning(query" not in few._jdf.queryExecution().executedPlan().toString()
    want = sorted((r.query, r.id, round(r.score, 9)) for r in few.collect())
    monkeypatch.setattr(search, "FEW", 1)
    assert sorted((r.query, r.id, round(r.score, 9)) for r in index.scores(queries).collect()) == want and len(want) == 60
