"""Rendezvous hashing of stable record keys over weighted shards.

A record goes to the shard of greatest score, the score of a shard being -weight / ln(u) with u in (0, 1) from a hash of
key and shard. Shards don't know of each other: when one is added, only the records that it wins move, and all to it;
when one goes, only its records move. Scores are arithmetic on built-in functions, row by row, without an exchange.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import read

PRIME = (1 << 31) - 1


@dataclass(frozen=True)
class Params:
    """shards: (name, weight) each; a name keeps its records for as long as it stays, wherever in the list it is."""

    shards: tuple[tuple[int, float], ...] = tuple((i, 2.0 if i < 8 else 1.0) for i in range(32))

    def __post_init__(self) -> None:
        names = [s for s, _ in self.shards]
        if not names or len(set(names)) < len(names) or min(w for _, w in self.shards) <= 0:
            raise ValueError("shards need distinct names and positive weights")


def multipliers(shard: int) -> tuple[int, int, int]:
    d = hashlib.sha256(f"shard {shard}".encode()).digest()
    return tuple(1 + int.from_bytes(d[8 * i : 8 * i + 8], "big") % (PRIME - 1) for i in range(3))


def shard_of(key: Column, p: Params = Params()) -> Column:
    """The shard of a key, by its text; a null key goes where an empty one does."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    x, y = (F.conv(F.substring(digest, i, 15), 16, 10).cast("long") % PRIME for i in (1, 17))
    table = F.array(*(F.struct(F.lit(s).cast("long").alias("s"), F.lit(float(w)).alias("w"), *(F.lit(m).cast("long").alias(n) for n, m in zip("abc", multipliers(s)))) for s, w in sorted(p.shards)))
    score = lambda h, t: -t["w"] / F.ln(((h["x"] * t["a"] + h["y"] * t["b"] + t["c"]) % PRIME + F.lit(0.5)) / float(PRIME))
    both = F.array(F.struct(x.alias("x"), y.alias("y")))
    best = F.transform(both, lambda h: F.array_max(F.transform(table, lambda t: F.struct(score(h, t).alias("v"), (-t["s"]).alias("s")))))
    return -best[0]["s"]


def assign(docs: DataFrame, p: Params = Params(), key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """docs with the column shard, which replaces any of that name.

    Nulls: a null key counts as an empty one. Texts and other columns are not looked at. Repeated rows of one key share
    its shard. An empty table gives no rows. Equal scores go to the shard of the least name.
    """
    return docs.withColumn(shard, shard_of(docs[key], p))


def write_shards(docs: DataFrame, path: str, p: Params = Params(), key: str = "doc_id", files: int = 1) -> None:
    """Parquet in a folder by shard, up to files of each; a second hash of the key splits a shard between its files.

    Nulls, repeated rows and extra columns are as in assign(); an empty table writes no shard. Texts are written as they are.
    """
    rows = assign(docs, p, key)
    rows.repartition(len(p.shards) * files, "shard", F.pmod(F.hash(F.col(key)), F.lit(files))).write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return assign(docs.select("doc_id"))


def sql(p: Params = Params()) -> str:
    """A WITH clause shard_of(k, shard) over the distinct keys of shard_keys(k)."""
    values = ", ".join("({}, {}, {}, {}, {})".format(s, float(w), *multipliers(s)) for s, w in p.shards)
    return f"""shard_table(s, w, a, b, c) as (values {values}),
shard_hash as (select k, ('0x' || substr(md5(coalesce(k::varchar, '')), 1, 15))::bigint % {PRIME} as x, ('0x' || substr(md5(coalesce(k::varchar, '')), 17, 15))::bigint % {PRIME} as y from (select distinct k from shard_keys)),
shard_of as (select k, arg_max(s::bigint, (-w / ln(((x * a::bigint + y * b::bigint + c) % {PRIME} + 0.5::double) / {PRIME}.0::double), -s)) as shard from shard_hash, shard_table group by k)"""


ORACLE = f"""with shard_keys as (select doc_id as k from documents),
{sql()}
select doc_id, shard from documents join shard_of on k is not distinct from doc_id"""
