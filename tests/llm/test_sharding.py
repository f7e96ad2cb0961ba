import collections

from cases import clashing, empty, odd, rows

from lodestone.llm.sharding import Params, assign, write_shards


def keys(spark, p, n=20000):
    return {r.doc_id: r.shard for r in assign(spark.range(n).withColumnRenamed("id", "doc_id"), p).collect()}


def test_weights_and_moves(spark):
    five = Params(tuple((i, 1.0 + (i == 0)) for i in range(5)))
    six = Params((*five.shards, (9, 1.0)))
    a, b = keys(spark, five), keys(spark, six)
    count = collections.Counter(a.values())
    assert abs(count[0] / 20000 - 2 / 6) < 0.02 and all(abs(count[i] / 20000 - 1 / 6) < 0.02 for i in range(1, 5))
    moved = {k for k in a if a[k] != b[k]}
    assert {b[k] for k in moved} == {9} and abs(len(moved) / 20000 - 1 / 7) < 0.02
    assert keys(spark, Params(five.shards[::-1])) == a


def test_odd_rows(spark, tmp_path):
    got = assign(clashing(odd(spark)))
    assert got.columns == clashing(odd(spark)).columns and got.where("shard is null").count() == 0
    assert len({r.shard for r in got.where("doc_id = 5").collect()}) == 1
    assert rows(assign(empty(spark))) == []
    write_shards(odd(spark), str(tmp_path / "out"), Params(((1, 1.0), (2, 1.0))))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd(spark).count() and {r.shard for r in back.select("shard").distinct().collect()} <= {1, 2}
