from cases import ODD, SCHEMA, clashing, empty, odd, rows
from pyspark.sql import functions as F

from lodestone.llm.host_rules import drop_rejected, host_of, verdicts

CLEAN = "An ordinary sentence with words of usual length, and another one that follows it. "


def test_bad_hosts_are_judged_by_doubt(spark):
    junk, doubt = "| a | b | c | d " * 30, (CLEAN + "= # ~ ^ ") * 3
    docs = [(i, CLEAN * 2 if i % 2 else junk, "en", "good" if i % 2 else "bad", 0) for i in range(200)]
    docs += [(900, doubt, "en", "bad", 0), (901, doubt, "en", "good", 0), (902, CLEAN, "en", "bad", 0), (903, junk, "en", "tiny", 0)]
    got = {r.doc_id: r for r in verdicts(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got[900].doubted == "symbols" and not got[900].failed and got[900].bad_host and not got[900].kept
    assert got[901].kept and not got[901].bad_host and got[902].kept
    # One failure doesn't make a host of one document as bad as it looks.
    assert got[903].host_rate < 1 and not got[903].kept
    kept = {r.doc_id for r in drop_rejected(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_hosts_that_stand_out(spark):
    """A host turns bad by its posterior, against the rate over all: not by few documents, nor where hosts differ by chance only."""
    junk, doubt = "| a | b | c | d " * 30, (CLEAN + "= # ~ ^ ") * 3
    rates = {"plain1": (400, 40), "plain2": (400, 44), "plain3": (400, 36), "spammy": (300, 120), "tiny": (2, 1)}
    docs, i = [], 0
    for h, (n, bad) in rates.items():
        docs += [(i + k, junk if k < bad else CLEAN * 2, "en", f"https://www.{h}.example.com/{k}", 0) for k in range(n)]
        docs.append((i + n, doubt, "en", f"http://{h}.example.com/?doubt", 0))
        i += n + 1
    df = spark.createDataFrame(docs, SCHEMA)
    host = host_of(df["source"])
    got = verdicts(df, host=host, keep=("doc_id", "source")).collect()
    assert {r.host.split(".")[0] for r in got if r.bad_host} == {"spammy"} and all(0.05 < r.host_rate < 0.5 for r in got)
    changed = [r for r in got if not r.failed and not r.kept]
    assert [(r.doubted, r.source) for r in changed] == [("symbols", "http://spammy.example.com/?doubt")]
    assert sorted(r.doc_id for r in drop_rejected(df, host=host).collect()) == sorted(r.doc_id for r in got if r.kept)
    alike = df.where(~F.col("source").contains("spammy") & ~F.col("source").contains("tiny"))
    assert not any(r.bad_host for r in verdicts(alike, host=host_of(alike["source"])).collect())


def test_each_rule(spark):
    cases = {"symbols": "a # b $ c % d & " * 5, "shouts": "wow! yes! no! hey! oh! " * 4, "capitals": "SHOUTED WORDS ALL OVER THE PLACE", "letters": "123 456 789", "repeats": "same line\n" * 9, "stutter": "for for for for for to to to to to " * 4, "word_length": "x" * 90}
    docs = spark.createDataFrame([(i, t, "en", "h", 0) for i, t in enumerate(cases.values())], SCHEMA)
    got = {r.doc_id: r.failed.split(",") for r in verdicts(docs).collect()}
    assert all(name in got[i] for i, name in enumerate(cases))


def test_odd_rows(spark):
    docs = odd(spark)
    got = rows(verdicts(docs))
    assert len(got) == len(ODD) and rows(verdicts(clashing(docs))) == got
    assert {r[2] for r in got if r[0] in (1, 2, 3)} == {"letters"} and any(r[1] is None for r in got)
    assert drop_rejected(clashing(docs)).columns == clashing(docs).columns
    assert rows(drop_rejected(docs).select("doc_id")) == sorted(((r[0],) for r in got if r[7]), key=repr)
    assert rows(verdicts(empty(spark))) == [] and rows(drop_rejected(empty(spark))) == []


def test_letters_of_every_script(spark):
    texts = [
        "Обычное предложение из слов привычной длины, и ещё одно за ним.", "Μια συνηθισμένη πρόταση με λέξεις και άλλη μία μετά.",
        "جملة عادية من كلمات مألوفة الطول، وأخرى بعدها.", "सामान्य लंबाई के शब्दों का एक वाक्य और उसके बाद दूसरा।",
        "这是一个普通的句子，后面还有另一个句子，说的是同样平常的事情。" * 3, "これは普通の文で、そのあとにもう一つの文が続きます。" * 3,
        "นี่คือประโยคธรรมดาและมีอีกประโยคหนึ่งตามมา" * 3, "평범한 길이의 단어로 된 문장과 그 뒤의 다른 문장.",
    ]
    docs = spark.createDataFrame([(i, t, "x", "h", 0) for i, t in enumerate(texts)], SCHEMA)
    assert [(r.failed, r.doubted, r.kept) for r in verdicts(docs).collect()] == [("", "", True)] * len(texts)
    assert drop_rejected(docs).count() == len(texts)
    bad = spark.createDataFrame([(1, "ВСЕ СЛОВА ЗДЕСЬ НАПИСАНЫ ЗАГЛАВНЫМИ", "x", "h", 0), (2, "一二三 123 456 789 000 111", "x", "h", 0), (3, "я" * 90, "x", "h", 0)], SCHEMA)
    assert {r.doc_id: r.failed for r in verdicts(bad).collect()} == {1: "capitals", 2: "letters", 3: "word_length"}
