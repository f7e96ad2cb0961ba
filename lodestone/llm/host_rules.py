"""Quality rules whose strictness follows the host: failures by host, shrunk by an empirical beta prior, judged, joined back.

1. Every document is measured by built-in functions: shares of symbols, of capitals and of letters, repeated lines,
   words said twice in a row, length of words. A measure beyond its hard limit is a failure; one beyond its soft limit is a doubt.
2. Failing documents are counted by host. The hosts' rates give a beta prior by moments: its mean is the rate over all
   documents, its weight follows from how far hosts spread beyond what chance would make them. A host's rate is the mean
   of its posterior, so that a host with few documents is judged by the others.
3. A host is bad if its posterior leaves little chance that its rate isn't `worse` times the rate over all documents:
   the mean less `sure` standard deviations is beyond that. There, a doubt rejects; elsewhere, only a failure does.

Only the table of hosts is exchanged; texts stay where they are read, and are measured once for all verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Workspace, read
from .url_filter import key_parts

SYMBOLS = r"[#$%&*|{}<>^~=_\\]"
#: Of every script; the ranges before the classes are found sooner. Marks belong to their letters.
CAPITALS = r"[A-ZÀ-ÖØ-Þ\p{Lu}]"
LETTERS = r"[A-Za-zÀ-ÖØ-öø-ÿ\p{L}\p{M}]"
#: Characters of scripts that put no spaces between words; each counts as a word.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


@dataclass(frozen=True)
class Params:
    """(hard, soft) limits. Shares are of characters without white space, capitals of letters, repeats of lines.

    worse: a bad host's least rate, as a multiple of the rate over all. sure: posterior standard deviations by which it must be beyond that.
    """

    symbols: tuple[float, float] = (0.06, 0.04)
    shouts: tuple[float, float] = (0.05, 0.02)
    capitals: tuple[float, float] = (0.5, 0.3)
    letters: tuple[float, float] = (0.4, 0.6)
    repeats: tuple[float, float] = (0.5, 0.3)
    repeat_lines: int = 4
    stutter: tuple[float, float] = (0.3, 0.15)
    stutter_words: int = 20
    word_length: tuple[float, float] = (40.0, 25.0)
    worse: float = 1.5
    sure: float = 2.0


def without(text: Column, pattern: str) -> Column:
    """How many characters of the pattern a text has."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def flags(text: Column, p: Params) -> tuple[Column, Column]:
    """Comma-separated names of the rules that a text fails, and of those that it at least gives doubt on."""
    t = F.coalesce(text, F.lit(""))
    dense = F.length(F.regexp_replace(t, "[ \n\t\r]+", ""))
    letters, capitals = without(t, LETTERS), without(t, CAPITALS)
    words = F.length(F.regexp_replace(t, "[^ \n\t\r]+", "")) + 1
    lines, said = F.split(t, "\n"), F.split(t, "[ \n\t\r]+")
    pairs = F.size(said) - 1
    twice = F.size(F.filter(F.zip_with(F.slice(said, F.lit(1), pairs), F.slice(said, F.lit(2), pairs), lambda a, b: a == b), lambda x: x))
    low = lambda x, y: x / F.greatest(y, F.lit(1))
    # Only a text beyond the limit is searched for such scripts: more words can only bring it under it.
    length = low(dense, words)
    length = F.when(length > min(p.word_length), low(dense, words + without(t, UNSPACED))).otherwise(length)
    repeated = F.size(lines) - F.size(F.array_distinct(lines))
    measures = [
        ("symbols", low(without(t, SYMBOLS), dense), p.symbols, False, None),
        ("shouts", low(without(t, "[!?]"), dense), p.shouts, False, dense >= 20),
        ("capitals", low(capitals, letters), p.capitals, False, letters >= 20),
        ("letters", low(letters, dense), p.letters, True, None),
        ("repeats", low(repeated, F.size(lines)), p.repeats, False, F.size(lines) >= p.repeat_lines),
        ("stutter", low(twice, pairs), p.stutter, False, pairs >= p.stutter_words),
        ("word_length", length, p.word_length, False, None),
    ]
    out = []
    for k in (0, 1):
        found = [F.when((m < limit[k] if under else m > limit[k]) & (F.lit(True) if only is None else only), F.lit(name)) for name, m, limit, under, only in measures]
        out.append(F.concat_ws(",", *found))
    return out[0], out[1]


def hosts(checked: DataFrame, p: Params) -> DataFrame:
    """(h, docs, failing, rate, bad) by host, from rows (h, hard)."""
    by = checked.groupBy("h").agg(F.count("*").alias("docs"), F.sum((F.col("hard") != "").cast("long")).alias("failing"))
    n, k = F.col("n"), F.col("k")
    total = by.agg(F.sum("docs").alias("n"), F.sum("failing").alias("k"), F.count("*").alias("h0"), F.sum(F.col("failing") * F.col("failing") / F.col("docs")).alias("sq"))
    m = (k / n).alias("m")
    total = total.select("n", "h0", "sq", m).withColumn("spread", (F.col("sq") - n * F.col("m") * F.col("m") - (F.col("h0") - 1) * F.col("m") * (1 - F.col("m"))) / n)
    weight = F.when(F.col("spread") > 0, F.greatest(F.lit(1.0), F.least(n.cast("double"), F.col("m") * (1 - F.col("m")) / F.col("spread") - 1))).otherwise(n.cast("double"))
    prior = total.select("m", weight.alias("weight"))
    rate = (F.col("failing") + F.col("m") * F.col("weight")) / (F.col("docs") + F.col("weight"))
    low = rate - p.sure * F.sqrt(rate * (1 - rate) / (F.col("docs") + F.col("weight") + 1))
    return by.crossJoin(F.broadcast(prior)).select("h", "docs", "failing", F.round(rate, 6).alias("rate"), (F.round(low, 6) > F.round(p.worse * F.col("m"), 6)).alias("bad"))


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case and without a leading "www."; null where there is none."""
    return F.nullif(F.regexp_replace(key_parts(url)[0], "^www[.]", ""), F.lit(""))


def host_column(docs: DataFrame, host: str | Column) -> Column:
    return (docs[host] if isinstance(host, str) else host).cast("string")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it as far as docs has a column of that name."""
    have = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        out.append(n)
    return out


def verdicts(docs: DataFrame, p: Params = Params(), host: str | Column = "source", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, host, failed, doubted, host_docs, host_rate, bad_host, kept) for every row of docs.

    host: a column, by name or as an expression, such as host_of() of a URL.

    Nulls: a null text counts as empty, and an empty text fails the rule of letters; rows without a host make one
    host of their own, null. Very long texts are measured whole. Repeated rows count each and each gets its verdict.
    An empty table gives no rows. Other columns of docs are not looked at, whatever their names.
    """
    hard, soft = flags(docs[text], p)
    rows = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep)), host_column(docs, host).alias("g"), hard.alias("hard"), soft.alias("soft"))
    with Workspace(docs.sparkSession) as ws:
        rows = ws.table(rows)
        judged = ws.side(hosts(rows.select(F.col("g").alias("h"), "hard"), p))
        kept = F.when(F.col("bad"), F.col("soft") == "").otherwise(F.col("hard") == "")
        out = rows.join(judged, rows.g.eqNullSafe(judged.h))
        return ws.keep(out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("g").alias("host"), F.col("hard").alias("failed"), F.col("soft").alias("doubted"), F.col("docs").alias("host_docs"), F.col("rate").alias("host_rate"), F.col("bad").alias("bad_host"), kept.alias("kept")))


def drop_rejected(docs: DataFrame, p: Params = Params(), host: str | Column = "source", text: str = "text") -> DataFrame:
    """The rows of docs that verdicts() keeps, with their columns as they are. Texts are measured once, in the pass that writes them beside their verdicts.

    Nulls, empty and very long texts are judged as in verdicts(); repeated rows stay or go together. An empty table
    gives no rows. Extra columns stay, whatever their names.
    """
    hard, soft = flags(docs[text], p)
    g, h, s, bad = unused(docs, "host_key", "hard_flags", "soft_flags", "bad_host_key")
    with Workspace(docs.sparkSession) as ws:
        rows = ws.keep(docs.select("*", host_column(docs, host).alias(g), hard.alias(h), soft.alias(s)))
        judged = hosts(rows.select(F.col(g).alias("h"), F.col(h).alias("hard")), p).where("bad").select(F.col("h").alias(bad))
        # A clean row has no failure. Of those in doubt, only rows of bad hosts go.
        judged = ws.side(judged, keep=True)
    return rows.where(rows[h] == "").join(judged, rows[g].eqNullSafe(judged[bad]) & (rows[s] != ""), "left_anti").select(*(rows[f"`{c}`"] for c in docs.columns))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(read(spark, sf_dir, "documents"))


_SHARES = r"""
measured as (select *, greatest(length(regexp_replace(t, '[ \n\t\r]+', '', 'g')), 1) as dense, length(t) - length(regexp_replace(t, '[#$%&*|{}<>^~=_\\]', '', 'g')) as symbols,
  length(t) - length(regexp_replace(t, '[!?]', '', 'g')) as shouts, length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) as capitals,
  length(t) - length(regexp_replace(t, '[A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) as letters, length(regexp_replace(t, '[^ \n\t\r]+', '', 'g')) + 1 as words,
  len(string_split(t, chr(10))) as lines, len(list_distinct(string_split(t, chr(10)))) as kinds,
  len(said) - 1 as pairs, len(list_filter(range(1, len(said)), lambda i: said[i] = said[i + 1])) as twice
  from (select *, regexp_split_to_array(coalesce(text, ''), '[ \n\t\r]+') as said, coalesce(text, '') as t, source as g from {table})),
flagged as (select *,
  concat_ws(',', case when symbols / dense > 0.06 then 'symbols' end, case when shouts / dense > 0.05 and dense >= 20 then 'shouts' end,
    case when capitals / greatest(letters, 1) > 0.5 and letters >= 20 then 'capitals' end, case when letters / dense < 0.4 then 'letters' end,
    case when (lines - kinds) / lines > 0.5 and lines >= 4 then 'repeats' end, case when twice / greatest(pairs, 1) > 0.3 and pairs >= 20 then 'stutter' end, case when dense / words > 40 then 'word_length' end) as hard,
  concat_ws(',', case when symbols / dense > 0.04 then 'symbols' end, case when shouts / dense > 0.02 and dense >= 20 then 'shouts' end,
    case when capitals / greatest(letters, 1) > 0.3 and letters >= 20 then 'capitals' end, case when letters / dense < 0.6 then 'letters' end,
    case when (lines - kinds) / lines > 0.3 and lines >= 4 then 'repeats' end, case when twice / greatest(pairs, 1) > 0.15 and pairs >= 20 then 'stutter' end, case when dense / words > 25 then 'word_length' end) as soft
  from measured),
by_host as (select g as h, count(*) as docs, count(*) filter (hard <> '') as failing from flagged group by g),
total as (select sum(docs)::double as n, count(*) as h0, sum(failing * failing / docs) as sq, sum(failing) / sum(docs) as m from by_host),
prior as (select m, case when spread > 0 then greatest(1.0, least(n, m * (1 - m) / spread - 1)) else n end as weight
  from (select *, (sq - n * m * m - (h0 - 1) * m * (1 - m)) / n as spread from total)),
judged as (select h, docs, failing, round(rate, 6) as rate, round(rate - 2.0 * sqrt(rate * (1 - rate) / (docs + weight + 1)), 6) > round(1.5 * m, 6) as bad
  from (select *, (failing + m * weight) / (docs + weight) as rate from by_host, prior))
"""


def sql(table: str = "documents") -> str:
    """WITH clauses that end in flagged (every row, with g, hard and soft) and judged (h, docs, failing, rate, bad)."""
    return _SHARES.replace("{table}", table)


ORACLE = f"""with {sql()}
select doc_id, source as host, hard as failed, soft as doubted, docs as host_docs, rate as host_rate, bad as bad_host, case when bad then soft = '' else hard = '' end as kept
from flagged join judged on g is not distinct from h"""
