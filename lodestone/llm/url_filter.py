"""URL rules by a sort-merge range join: reversed-host keys make prefixes intervals, and a sweep keeps the nested rules.

1. A URL's key is its host's labels in reverse, each followed by a comma, then ")" and the path with its query:
   http://m.example.com/a?b is "com,example,m,)/a?b". All URLs under a domain, or under a path, are an interval of keys.
   An address (10.0.0.1, [::1]) has no labels and stays as it is. Escapes of unreserved characters are undone (%7E is ~),
   others are put in capitals. Names of other scripts count as they are written; no punycode is made or read.
2. Keys and rules are sorted together, range by range. Equal keys may fall into several ranges.
3. A rule that begins in an earlier range than a key is still active there if its prefix begins the range's first key, so
   the first keys' own prefixes, looked up among the rules by an equality join, give each range the rules to start with.
4. Each range is swept once in order. A stack has the rules that are active, each nested in the one below; its top, the
   longest prefix, decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Workspace, kind_of, read

#: (rule_id, prefix as a domain, host or host with path, action) for the query on pages.
RULES = (
    (1, ".casino-win.example.com", "block"),
    (2, ".casino-win.example.net", "block"),
    (3, ".casino-win.example.org", "block"),
    (4, ".free-bets.example.com", "block"),
    (5, ".free-bets.example.net", "block"),
    (6, ".free-bets.example.org", "block"),
    (7, ".ads-track.example.com", "block"),
    (8, ".ads-track.example.net", "block"),
    (9, ".ads-track.example.org", "block"),
    (10, ".spam-farm.example.com", "block"),
    (11, ".spam-farm.example.net", "block"),
    (12, ".spam-farm.example.org", "block"),
    (13, ".cheap-pills.example.com", "block"),
    (14, ".cheap-pills.example.net", "block"),
    (15, ".cheap-pills.example.org", "block"),
    (16, ".adult-x.example.com", "block"),
    (17, ".adult-x.example.net", "block"),
    (18, ".adult-x.example.org", "block"),
    (19, ".example.net", "allow"),
    (20, ".example.com", "allow"),
    (21, "tionble.example.org/de/", "block"),
    (22, "tionble.example.org/de/1", "allow"),
    (23, ".tiontion.example.net", "allow"),
    (24, "tiontion.example.net/en/7", "block"),
)


ADDRESS = r"^([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}|\[.*\])$"
#: Hexadecimal codes of the characters that need no escape.
UNRESERVED = "^(2D|2E|3[0-9]|4[1-9A-F]|5[0-9AF]|6[1-9A-F]|7[0-9AE])$"


def plain(path: Column) -> Column:
    """A path without needless escapes."""
    code = lambda x: F.upper(F.substring(x, 1, 2))
    rest = lambda x: F.substr(x, F.lit(3))
    one = lambda x: F.when(code(x).rlike(UNRESERVED), F.concat(F.char(F.conv(code(x), 16, 10).cast("int")), rest(x))).when(code(x).rlike("^[0-9A-F]{2}$"), F.concat(F.lit("%"), code(x), rest(x))).otherwise(F.concat(F.lit("%"), x))
    parts = F.split(path, "%")
    return F.when(F.instr(path, "%") > 0, F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, 1 << 30), one), ""))).otherwise(path)


def key_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path with query, of a URL; the scheme, user, port and fragment are dropped."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(u, "^([A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "[/?].*$", ""), "^.*@", ""), ":[0-9]*$", "")
    path = plain(F.regexp_extract(rest, "^[^/?]*([/?].*)?$", 1))
    return F.lower(F.regexp_replace(host, "[.]+$", "")), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def turned(host: Column) -> Column:
    return F.when(host.rlike(ADDRESS), host).otherwise(F.array_join(F.reverse(F.split(host, "[.]")), ","))


def url_key(url: Column) -> Column:
    host, path = key_parts(url)
    return F.concat(turned(host), F.lit(",)"), path)


def rule_key(pattern: Column) -> Column:
    """The prefix of keys that a pattern means: ".domain" for the domain and all under it, "host" for one host, "host/path" for what begins so."""
    domain = F.concat(turned(F.lower(F.substr(pattern, F.lit(2)))), F.lit(","))
    host = F.concat(turned(F.lower(F.substring_index(pattern, "/", 1))), F.lit(",)"))
    return F.when(pattern.startswith("."), domain).otherwise(F.concat(host, F.when(F.instr(pattern, "/") > 0, plain(F.substr(pattern, F.instr(pattern, "/")))).otherwise(F.lit(""))))


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, rule_id, nested) for the pages among rows (part, key, kind, rule_id, id) in order; kind 0 is a rule, 1 a page."""
    part, stack = None, []
    for rows in batches:
        pages, rule_ids, nested = [], [], []
        for n, (now, key, kind, rule) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("part", "key", "kind", "rule_id")))):
            if now != part:
                part, stack = now, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind:
                pages.append(n)
                rule_ids.append(stack[-1][1] if stack else None)
                nested.append(len(stack))
            elif not stack or stack[-1][0] != key:
                stack.append((key, rule))
        yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(pages, pa.int64())), pa.array(rule_ids, pa.int64()), pa.array(nested, pa.int64())], ["id", "rule_id", "nested"])


def match(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, rule_id, action, nested) for every page: the rule of the longest prefix, if any, its action, and how many rules are active.

    rules: (rule_id long, pattern string, action string); page_id may be of any type that sorts. Nulls: a page without
    an id or a URL gets no rule and keeps its row; rules with a null id or pattern, or an empty one, are left out. Of
    rules with one prefix the least id counts. Empty URLs match nothing; very long ones are compared whole. Repeated
    pages have a row each. Empty tables give no rows, or rows without rules. Other columns are not looked at, whatever
    their names.
    """
    kind = kind_of(pages, page_id)
    no_id, no_rule = F.lit(None).cast(kind).alias("id"), F.lit(None).cast("long").alias("rule_id")
    with Workspace(pages.sparkSession) as ws:
        chosen = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"))
        given = rules.where("rule_id is not null and pattern <> ''").select(rule_key(F.col("pattern")).alias("key"), F.col("rule_id").cast("long").alias("id"), F.col("action").alias("action"))
        given = ws.table(given.groupBy("key").agg(F.min(F.struct("id", "action")).alias("r")).select("key", F.col("r.id").alias("rule_id"), "r.action"))
        some = F.col("id").isNotNull() & (F.trim(F.coalesce("url", F.lit(""))) != "")
        events = given.select("key", F.lit(0).alias("kind"), "rule_id", no_id).union(chosen.where(some).select(url_key(F.col("url")).alias("key"), F.lit(1).alias("kind"), no_rule, "id"))
        ranges = ws.table(events.repartitionByRange("key", "kind", "id").withColumn("part", F.spark_partition_id()))
        # The sort within a range follows once; here only its least key is needed.
        first = ranges.groupBy("part").agg(F.min("key").alias("first"))
        starts = first.select("part", F.explode(F.transform(F.sequence(F.lit(1), F.length("first")), lambda n: F.substr(F.col("first"), F.lit(1), n))).alias("key"))
        carried = starts.join(given, "key").select("key", F.lit(0).alias("kind"), "rule_id", no_id, "part")
        swept = ranges.unionByName(carried).repartition("part").sortWithinPartitions("part", "key", "kind").select("part", "key", "kind", "rule_id", "id")
        found = swept.mapInArrow(sweep, f"id {kind}, rule_id long, nested long")
        found = found.join(given.select("rule_id", "action"), "rule_id", "left").select("id", "rule_id", "action", "nested")
        rest = chosen.where(~some).select("id", no_rule, F.lit(None).cast("string").alias("action"), F.lit(0).cast("long").alias("nested"))
        return ws.keep(found.union(rest).withColumnRenamed("id", "page_id"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule_id long, pattern string, action string"))


def rule_prefix(pattern: str) -> str:
    host, slash, path = pattern.lstrip(".").partition("/")
    turned = host if re.match(ADDRESS, host) else ",".join(reversed(host.split(".")))
    return turned + ("," if pattern.startswith(".") else ",)" + slash + path)


_PLAIN = f"""case when contains(raw, '%') then string_split(raw, '%')[1] || array_to_string(list_transform(string_split(raw, '%')[2:], lambda x:
  case when regexp_matches(upper(substr(x, 1, 2)), '{UNRESERVED}') then chr(('0x' || substr(x, 1, 2))::int) || substr(x, 3)
    when regexp_matches(upper(substr(x, 1, 2)), '^[0-9A-F]{{2}}$') then '%' || upper(substr(x, 1, 2)) || substr(x, 3) else '%' || x end), '') else raw end"""
ORACLE = rf"""with rules(rule_id, prefix, action) as (values {", ".join(f"({i}, '{rule_prefix(x)}', '{a}')" for i, x, a in RULES)}),
parts as (select page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*:)?//', '') as rest from pages),
hosts as (select page_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '[/?].*$', ''), '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '')) as host, regexp_extract(rest, '^[^/?]*([/?].*)?$', 1) as raw from parts),
paths as (select page_id, case when regexp_matches(host, '{ADDRESS}') then host else array_to_string(list_reverse(string_split(host, '.')), ',') end as host, {_PLAIN} as path from hosts),
keys as (select page_id, host || ',)' || case when path like '/%' then '' else '/' end || path as key from paths)
select page_id, arg_max(rule_id::bigint, length(prefix)) as rule_id, arg_max(action, length(prefix)) as action, count(rule_id)::bigint as nested
from keys left join rules on starts_with(key, prefix) group by page_id, key"""
