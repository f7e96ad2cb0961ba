import os

import duckdb
import pytest
from cases import SCHEMA, clashing, odd
from test_decontaminate import normal_words
from test_near_dup import brute as near_brute

import corpus_pipeline
from lodestone.llm import host_rules, mixing, registry, sharding


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        path = f"{sf}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf}/{f}") else "")
        con.sql(f"create view {f.split('.')[0]} as select * from '{path}'")
    return con


def test_pipeline_against_brute_force(spark, sf):
    con = connect(sf)
    con.sql(f"create table kept as with {host_rules.sql()} select doc_id, text, lang, source, n_chars from flagged join judged on g is not distinct from h where case when bad then soft = '' else hard = '' end")
    docs = con.sql("select doc_id, text from kept order by doc_id").fetchall()
    groups = near_brute(docs, 0.5)
    items = [normal_words(t) for (t,) in con.sql("select text from benchmark").fetchall()]
    passages = [" " + " ".join(w[j : j + 13]) + " " for w in items if len(w) >= 8 for j in range(max(1, len(w) - 12))]
    leaks = {d for d, t in docs if any(p in " " + " ".join(normal_words(t)) + " " for p in passages)}
    con.execute("create table clean as select * from kept where doc_id in (select unnest($1))", [[d for d, _ in docs if groups[d] == d and d not in leaks]])
    want = con.sql(f"with shard_keys as (select doc_id as k from clean), {mixing.sql('clean', mixing.TARGET)}, {sharding.sql()} select doc_id, shard from mixed join shard_of on k_ = doc_id where tier is not null".replace("shard_of as (select k,", "shard_of as (select k as k_,")).fetchall()
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"]
    assert sorted((r.doc_id, r.shard) for r in got.collect()) == sorted(want)
    assert 20 < len(want) < 200 and leaks


def test_odd_rows_through_all_stages(spark, sf, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing names pass every stage; an empty table gives no rows."""
    for name in ("benchmark", "labels"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    plain = "A quiet river runs past the old mill, and the people of the village walk along it when the evenings are warm"
    docs = odd(spark).union(spark.createDataFrame([(20 + i, plain + f" in the year {1900 + i}.", "en", f"s{i % 3}", 120) for i in range(40)], SCHEMA))
    docs = clashing(docs.union(docs.where("doc_id = 21")))
    for rows, name in ((docs, "documents"), (docs.limit(0), "none")):
        path = tmp_path / name
        path.mkdir()
        for t in ("benchmark", "labels"):
            (path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
        rows.write.parquet(str(path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "documents"))
    assert set(got.columns) == {*docs.columns, "shard"} and got.count() > 0
    assert {r.doc_id for r in got.collect()} <= {r[0] for r in docs.select("doc_id").collect()} - {1, 2, 3, 6}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_against_sql(spark, sf, name):
    got = registry.QUERIES[name](spark, sf)
    cursor = connect(sf).execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = [tuple(dict(zip(columns, row))[c] for c in got.columns) for row in cursor.fetchall()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
