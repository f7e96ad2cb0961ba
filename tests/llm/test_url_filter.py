import random

from cases import lettered, rows
from pyspark.sql import functions as F

from lodestone.llm.url_filter import match, rule_prefix, url_key

RULES = "rule_id long, pattern string, action string"


def brute(pages, rules):
    """Rows (page, rule, action, nested) by comparing every key with every prefix."""
    best = {}
    for i, pattern, action in rules:
        if i is not None and pattern:
            key = rule_prefix(pattern)
            if key not in best or i < best[key][0]:
                best[key] = (i, action)
    out = []
    for p, host, path in pages:
        key = ",".join(reversed(host.split("."))) + ",)" + path
        on = sorted((len(k), r) for k, r in best.items() if key.startswith(k))
        out.append((p, *(on[-1][1] if on else (None, None)), len(on)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    r = random.Random(3)
    names = ["a", "b", "c", "d"]
    host = lambda: ".".join(r.choice(names) for _ in range(r.randrange(1, 4)))
    path = lambda: "/" + "/".join(r.choice(names) for _ in range(r.randrange(3)))
    rules = [(i, r.choice([".", ""]) + host() + r.choice(["", "", path()]), r.choice(["block", "allow"])) for i in range(60)]
    rules = [(i, p.replace("/", "") if p.startswith(".") else p, a) for i, p, a in rules]
    rules = [(i, p, a) for i, p, a in rules] + [(None, "a.b", "block"), (99, None, "block"), (98, "", "block")]
    pages = [(i, host(), path()) for i in range(500)]
    df = spark.createDataFrame([(i, f"https://user@{h.upper()}:443{p}#x") for i, h, p in pages], "page_id long, url string").repartition(5)
    got = rows(match(df, spark.createDataFrame(rules, RULES)))
    assert got == brute(pages, rules) and any(g[3] > 2 for g in got)


def test_one_hot_url(spark):
    df = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://x.com/same").alias("url"))
    rules = spark.createDataFrame([(1, ".com", "allow"), (2, "x.com/sa", "block"), (3, "x.com/z", "block")], RULES)
    assert match(df, rules).groupBy("rule_id", "nested").count().collect() == [(2, 2, 3000)]


def test_keys(spark):
    urls = ["http://M.Example.com./a?b#c", "example.com", "//example.com?q", "https://u:p@e.org:8080/x", "ftp://e.org/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(url_key(F.col("u"))).collect()]
    assert got == ["com,example,M,)/a?b".lower(), "com,example,)/", "com,example,)/?q", "org,e,)/x", "org,e,)/"]


def test_canonical_keys(spark):
    urls = ["http://10.0.0.1:80/x", "http://[2001:DB8::1]:8080/y", "http://a.b/%7euser/%2fq%41%zz%", "http://1.2.3.x/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(url_key(F.col("u"))).collect()]
    assert got == ["10.0.0.1,)/x", "[2001:db8::1],)/y", "b,a,)/~user/%2FqA%zz%", "x,3,2,1,)/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [(1, ".0.1", "block"), (2, "10.0.0.1", "allow"), (3, "a.b/~", "block"), (4, "[2001:db8::1]", "allow")]
    assert rows(match(pages, spark.createDataFrame(rules, RULES)).select("page_id", "rule_id")) == [(0, 2), (1, 4), (2, 3), (3, None)]
    assert rule_prefix("10.0.0.1/a") == "10.0.0.1,)/a" and rule_prefix(".e.org") == "org,e,"
    assert rows(match(lettered(pages, "page_id"), spark.createDataFrame(rules, RULES)).select("page_id", "rule_id")) == [("id-0", 2), ("id-1", 4), ("id-2", 3), ("id-3", None)]


def test_odd_rows(spark):
    pages = spark.createDataFrame([(None, "http://a.b/"), (1, None), (2, ""), (3, "  "), (4, "http://a.b/" + "x" * 5000), (4, "http://a.b/"), (5, "???")], "page_id long, url string")
    rules = spark.createDataFrame([(7, "a.b", "block"), (5, "a.b", "allow")], RULES)
    got = rows(match(pages.withColumns({c: F.lit(1) for c in ("key", "kind", "id", "part", "action", "rule_id")}), rules))
    assert got == sorted([(None, None, None, 0), (1, None, None, 0), (2, None, None, 0), (3, None, None, 0), (4, 5, "allow", 1), (4, 5, "allow", 1), (5, None, None, 0)], key=repr)
    assert rows(match(pages.limit(0), rules)) == [] and match(pages, rules.limit(0)).where("rule_id is not null").count() == 0
