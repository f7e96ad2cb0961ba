"""Mixing sources to target weights by thresholds on a hash, found from histograms.

Every record has a hash of its key, uniform and the same in every run. A source's budget admits the records of least
hash, as far as their tokens fit. The hash at which a budget ends is found without sorting:

1. Tokens are summed by source and by the hash's leading bits; running sums over these few buckets tell which bucket the
   budget ends in.
2. Only records of boundary buckets are summed again, by the next bits, until the hash's last bits.
3. What is left are records that share a source and the whole prefix; they are admitted in order of hash and key.

A record is then admitted by comparing its hash with the threshold of its source. Budgets are nested: each greater one
has its threshold further on, so a record's tier is the first budget that admits it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Workspace, read

#: Hexadecimal digits of the hash in each round, and rounds.
DIGITS, ROUNDS = 3, 5


@dataclass(frozen=True)
class Params:
    """budgets: rising shares of the corpus's tokens, in thousandths. weights: by source; others have default_weight.

    A source with fewer tokens than its share gives all of them, and the others share what it leaves.
    """

    budgets: tuple[int, ...] = (250, 500, 750)
    weights: dict[str, int] = field(default_factory=dict)
    default_weight: int = 1


def tokens(text: Column) -> Column:
    """Words, as white space separates them: the measure of a text where no tokenizer is given."""
    t = F.rtrim(F.coalesce(text, F.lit("")), F.lit(" \n\t\r"))
    return F.length(F.regexp_replace(t, "[ \n\t\r]*[^ \n\t\r]+", "x")).cast("long")


def key_hash(key: Column) -> Column:
    """The first DIGITS * ROUNDS hexadecimal digits of MD5 as a whole number; a null key counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, DIGITS * ROUNDS), 16, 10).cast("long")


def budgets(totals: DataFrame, p: Params) -> DataFrame:
    """(s, tier, most) from (s, total): the tokens that source s gives to each budget."""
    weight = F.lit(p.default_weight)
    for name, w in p.weights.items():
        weight = F.when(F.col("s") == name, F.lit(w)).otherwise(weight)
    tiers = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("tier"), F.lit(b).alias("share")) for i, b in enumerate(p.budgets)))).alias("x")
    rows = totals.select("s", "total", weight.cast("long").alias("w"), tiers).select("s", "total", "w", "x.tier", "x.share").where("w > 0")
    everything = F.broadcast(totals.agg(F.sum("total").alias("everything")))
    order = Window.partitionBy("tier").orderBy(F.col("total") / F.col("w"), "s")
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.crossJoin(everything).withColumn("goal", F.expr("everything * share div 1000"))
    rows = rows.withColumns({"used": F.coalesce(F.sum("total").over(before), F.lit(0)), "left_w": F.sum("w").over(on)})
    # The first source, in order of tokens by weight, that has as much as its share of what is left.
    rows = rows.withColumn("enough", F.col("total").cast("decimal(38,0)") * F.col("left_w") >= F.col("w").cast("decimal(38,0)") * (F.col("goal") - F.col("used")))
    first = F.min(F.when(F.col("enough"), F.struct(F.col("total") / F.col("w"), "s", (F.col("goal") - F.col("used")).alias("rest"), "left_w"))).over(Window.partitionBy("tier"))
    rows = rows.withColumn("first", first)
    share = F.expr("cast(cast(w as decimal(38,0)) * first.rest div first.left_w as long)")
    return rows.select("s", "tier", F.when(F.col("first").isNull(), F.col("total")).otherwise(F.least("total", share)).alias("most"))


def thresholds(ws: Workspace, rows: DataFrame, p: Params) -> DataFrame:
    """(s, tier, h, k) from rows (s, k, h, n): a budget admits every record whose (hash, key) is under (h, k)."""
    totals = ws.side(rows.groupBy("s").agg(F.sum("n").alias("total")))
    bits = 4 * DIGITS
    # A state row: budget `most` ends among the records whose hash begins with `prefix`; `used` tokens come before them.
    state = ws.side(budgets(totals, p).select("s", "tier", "most", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("used")))
    done = []
    for r in range(ROUNDS):
        rest = bits * (ROUNDS - 1 - r)
        bucket = F.shiftright("h", rest)
        wanted = ws.side(state.select(F.col("s").alias("ws"), F.col("prefix").alias("wp")).distinct())
        part = rows.join(wanted, rows.s.eqNullSafe(wanted.ws) & (F.shiftright(bucket, bits) == wanted.wp), "left_semi") if r else rows
        sums = part.groupBy(F.col("s").alias("bs"), bucket.alias("b")).agg(F.sum("n").alias("n"))
        joined = state.join(sums, state.s.eqNullSafe(sums.bs) & (F.shiftright(sums.b, bits) == state.prefix))
        run = F.sum("n").over(Window.partitionBy("s", "tier").orderBy("b"))
        over = joined.withColumn("upto", F.col("used") + run).where("upto > most")
        found = over.groupBy("s", "tier").agg(F.min(F.struct("b", (F.col("upto") - F.col("n")).alias("used"), "most")).alias("x"))
        # Budgets that no bucket exceeds admit the whole source.
        after = ws.side(found.select("s", "tier", "x.most", F.col("x.b").alias("prefix"), "x.used"))
        if not r:
            done.append(state.join(after.select(F.col("s").alias("s1"), F.col("tier").alias("t1")), F.col("s").eqNullSafe(F.col("s1")) & (F.col("tier") == F.col("t1")), "left_anti").select("s", "tier", F.lit(1 << 62).alias("h"), F.lit(None).cast("string").alias("k")))
        state = after
    same = rows.join(state.select(F.col("s").alias("s1"), "tier", "most", "prefix", "used"), F.col("s").eqNullSafe(F.col("s1")) & (F.col("h") == F.col("prefix")))
    order = Window.partitionBy("s1", "tier", "prefix").orderBy("k")
    ends = same.groupBy("s1", "tier", "prefix", "most", "used", "k").agg(F.sum("n").alias("n")).withColumn("upto", F.col("used") + F.sum("n").over(order)).where("upto > most")
    done.append(ends.groupBy("s1", "tier", "prefix").agg(F.min("k").alias("k")).select(F.col("s1").alias("s"), "tier", F.col("prefix").alias("h"), "k"))
    return done[0].unionByName(done[1])


def tiered(docs: DataFrame, p: Params, key: str, source: str, text: str, size: Column | None) -> tuple[DataFrame, DataFrame, Column]:
    """docs beside its thresholds (s, cuts), cuts being an array over the tiers and null for a source without weight, and the tier of a joined row."""
    name, id_, h = docs[source].cast("string"), F.coalesce(docs[key].cast("string"), F.lit("")), key_hash(docs[key])
    rows = docs.select(name.alias("s"), id_.alias("k"), h.alias("h"), (tokens(docs[text]) if size is None else size).alias("n"))
    with Workspace(docs.sparkSession) as ws:
        cuts = ws.side(thresholds(ws, ws.table(rows), p).groupBy(F.col("s").alias("mix_source")).agg(F.sort_array(F.collect_list(F.struct("tier", "h", "k"))).alias("mix_cuts")), keep=True)
    fits = F.filter(cuts["mix_cuts"], lambda c: (h < c["h"]) | ((h == c["h"]) & (id_ < c["k"])))
    return cuts, docs.join(cuts, name.eqNullSafe(cuts["mix_source"]), "left"), F.when(F.size(fits) > 0, F.array_min(F.transform(fits, lambda c: c["tier"])))


def mixture(docs: DataFrame, p: Params = Params(), key: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None) -> DataFrame:
    """(key, source, tokens, tier) for every row of docs; tier is the first budget that admits it, null where none does.

    size: a column of docs to sum instead of words. Nulls: rows of a null source make a source of their own; a null key
    counts as an empty one and a null text as one without tokens, which a threshold beyond its hash admits. Very long
    texts are counted whole. Repeated rows of one key are admitted together or not at all. An empty table gives no
    rows. Other columns of docs are not looked at, whatever their names.
    """
    cuts, joined, tier = tiered(docs, p, key, source, text, size)
    return joined.select(docs[key].alias("doc_id"), docs[source].alias("source"), (tokens(docs[text]) if size is None else size).alias("tokens"), tier.alias("tier"))


def mix(docs: DataFrame, p: Params = Params(), key: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None) -> DataFrame:
    """The rows of docs that the greatest budget admits, with their columns as they are.

    Nulls, very long texts and repeated rows are as in mixture(): rows of one key and source stay or go together, and a
    source of weight 0 gives none. An empty table gives no rows. Extra columns stay, whatever their names.
    """
    cuts, joined, tier = tiered(docs, p, key, source, text, size)
    return joined.where(tier.isNotNull()).select(*(docs[f"`{c}`"] for c in docs.columns))


#: What the query and the pipeline mix by: one source much more, some more, one less than the others.
TARGET = Params(weights={"src0": 2, "src1": 6, "src2": 3, "src3": 3}, default_weight=1)


#: The query's: as the pipeline's, and a source that is to give nothing.
QUERY = Params(weights={**TARGET.weights, "src19": 0})


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read(spark, sf_dir, "documents"), QUERY)


def sql(table: str = "documents", p: Params = TARGET) -> str:
    """WITH clauses that end in mixed: every row with its n (tokens) and tier."""
    tiers = ", ".join(f"({i + 1}, {b})" for i, b in enumerate(p.budgets))
    weight = f"coalesce(map_from_entries([{', '.join(f'({chr(39)}{k}{chr(39)}, {w})' for k, w in p.weights.items())}])[source], {p.default_weight})" if p.weights else str(p.default_weight)
    return rf"""mix_rows as (select *, coalesce(doc_id::varchar, '') as k, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, {DIGITS * ROUNDS}))::bigint as h, len(regexp_extract_all(coalesce(text, ''), '[^ \n\t\r]+')) as n from {table}),
mix_totals as (select source as s, sum(n)::hugeint as total, {weight}::hugeint as w from mix_rows group by source),
mix_order as (select s, total, w, tier, ((select sum(total) from mix_totals) * share) // 1000 as goal,
  coalesce(sum(total) over (partition by tier order by total::double / w, s nulls first rows between unbounded preceding and 1 preceding), 0) as used,
  sum(w) over (partition by tier order by total::double / w, s nulls first rows between current row and unbounded following) as left_w,
  row_number() over (partition by tier order by total::double / w, s nulls first) as place
  from mix_totals, (values {tiers}) v(tier, share) where w > 0),
mix_first as (select tier, arg_min(goal - used, place) as rest, arg_min(left_w, place) as rest_w from mix_order where total * left_w >= w * (goal - used) group by tier),
mix_most as (select s, o.tier, case when rest is null then total else least(total, w * rest // rest_w) end as most from mix_order o left join mix_first f on o.tier = f.tier),
mix_keys as (select source, k, h, sum(n)::hugeint as n from mix_rows group by source, k, h),
mix_runs as (select source, k, h, sum(n) over (partition by source order by h, k) as upto from mix_keys),
mix_cuts as (select s, tier, min((h, k)) filter (upto > most) as cut from mix_runs join mix_most on s is not distinct from source group by s, tier),
mixed as (select r.*, (select min(tier) from mix_cuts c where c.s is not distinct from r.source and (cut is null or (r.h, r.k) < cut)) as tier from mix_rows r)"""


ORACLE = f"with {sql(p=QUERY)}\nselect doc_id, source, n as tokens, tier from mixed"
