import hashlib
import random

import pytest
from cases import clashing, empty, odd, rows
from pyspark.sql import functions as F

from lodestone.llm.mixing import Params, mix, mixture

HASH = lambda k: int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16)


def brute(docs, p):
    """Tier of each (key, source, tokens)."""
    total = {}
    for _, s, n in docs:
        total[s] = total.get(s, 0) + n
    out = [None] * len(docs)
    for tier, share in reversed(list(enumerate(p.budgets, 1))):
        left, weight, most = sum(total.values()) * share // 1000, {s: p.weights.get(s, p.default_weight) for s in total}, {}
        order = sorted((s for s in total if weight[s]), key=lambda s: (total[s] / weight[s], s))
        for i, s in enumerate(order):
            rest = sum(weight[x] for x in order[i:])
            if total[s] * rest >= weight[s] * left:
                most |= {x: min(total[x], weight[x] * left // rest) for x in order[i:]}
                break
            most[s] = total[s]
            left -= total[s]
        for s in order:
            sums = {}
            for k, x, n in docs:
                if x == s:
                    sums[(HASH(k), str(k))] = sums.get((HASH(k), str(k)), 0) + n
            run, over = 0, False
            for key in sorted(sums):
                run += sums[key]
                over = over or run > most[s]
                if not over:
                    for i, (k, x, _) in enumerate(docs):
                        if x == s and (HASH(k), str(k)) == key:
                            out[i] = tier
    return out


@pytest.mark.parametrize(("seed", "p"), [(1, Params()), (2, Params(weights={"a": 3, "b": 0})), (3, Params(budgets=(10, 990, 1000)))])
def test_against_brute_force(spark, seed, p):
    r = random.Random(seed)
    docs = [(r.randrange(150), r.choices("abcd", [10, 3, 1, 1])[0], r.choice([0, 1, 5, 40, 400])) for _ in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, source string, size long").withColumn("text", F.lit("x"))
    got = rows(mixture(df, p, size=df["size"]))
    assert got == sorted(((k, s, n, t) for (k, s, n), t in zip(docs, brute(docs, p))), key=repr)
    assert len([g for g in got if not p.weights.get(g[1], 1)]) == len([d for d in docs if not p.weights.get(d[1], 1)])


def test_nested_and_near_the_budget(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("source"), F.lit("one two three").alias("text"))
    got = mixture(docs).groupBy("source", "tier").agg(F.sum("tokens").alias("n")).collect()
    by = {(r.source, r.tier): r.n for r in got}
    for s in ("even", "odd"):
        assert [abs(sum(by[s, t] for t in range(1, top + 1)) - 750 * top) < 6 for top in (1, 2, 3)] == [True] * 3
    assert mix(docs).count() == 1500


def test_odd_rows(spark):
    docs = odd(spark)
    got = rows(mixture(docs))
    assert len(got) == docs.count() and {r[2] for r in got if r[0] in (1, 2, 3)} == {0}
    assert rows(mixture(clashing(docs))) == got
    assert mix(clashing(docs)).columns == clashing(docs).columns
    assert rows(mixture(empty(spark))) == []


def test_rows_of_sources_without_weight(spark):
    docs = [(i, s, 10) for i, s in enumerate(["a", "b", None, "c"] * 20)]
    df = spark.createDataFrame(docs, "doc_id long, source string, size long").withColumn("text", F.lit("x"))
    for p in (Params(weights={"a": 3, "b": 0}), Params(weights={"b": 1}, default_weight=0), Params(default_weight=0)):
        got = rows(mixture(df, p, size=df["size"]))
        assert [g[:3] for g in got] == sorted(docs, key=repr)
        none = {s for s in ("a", "b", None, "c") if not p.weights.get(s, p.default_weight)}
        assert none and all(g[3] is None for g in got if g[1] in none)
        assert {g[1] for g in got if g[3] is not None} == {"a", "b", None, "c"} - none
        assert rows(mix(df, p, size=df["size"])) == sorted(((k, s, n, "x") for k, s, n, t in got if t is not None), key=repr)
