from cases import WORD, clashing, empty, lettered, odd, rows

from lodestone.llm.decontaminate import Params, contamination, drop_contaminated, normal_words

ITEM = "What is the Capital of France, and why did it become so? Answer: Paris - because the kings lived there."


def bench(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_offsets_of_whole_items(spark):
    text = "é 😀 before. WHAT is the capital\nof France and why did it become so -- answer paris: because the “kings” lived THERE! after"
    docs = spark.createDataFrame([(1, text), (2, "clean " * 50), (3, ITEM)], "doc_id long, text string")
    got = {r.doc_id: text[r.start : r.stop] if r.doc_id == 1 else (r.start, r.stop) for r in contamination(docs, bench(spark, ITEM)).collect()}
    assert got[1].startswith("WHAT") and got[1].endswith("THERE") and got[3] == (0, len(ITEM) - 1) and 2 not in got
    assert [r.doc_id for r in drop_contaminated(docs, bench(spark, ITEM)).collect()] == [2]


def test_passages_at_word_bounds(spark):
    words = [f"w{i}" for i in range(20)]
    item = " ".join(words)
    part = " ".join(words[3:16])
    docs = spark.createDataFrame([(1, f"x {part} y"), (2, f"x{part}"), (3, " ".join(words[3:15])), (4, part), (5, part + "0")], "doc_id long, text string")
    assert rows(contamination(docs, bench(spark, item)).select("doc_id")) == [(1,), (4,)]
    # The least number of words, and items of fewer.
    short = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "doc_id long, text string")
    assert rows(contamination(short, bench(spark, "two three four five six seven eight"))) == [(1, 0, 4, 39, True)]
    assert rows(contamination(short, bench(spark, "two three four five six seven eight nine"))) == [(1, 0, 4, 44, False)]


def test_short_items_are_of_a_class_of_their_own(spark):
    docs = spark.createDataFrame([(1, "All know that the capital of France is: Paris, of course."), (2, "comparison"), (3, "paris")], "doc_id long, text string")
    b = bench(spark, "the capital of france is paris", "Paris")
    assert rows(contamination(docs, b)) == [(1, 0, 14, 45, True), (1, 1, 40, 45, True), (3, 1, 0, 5, True)]
    assert drop_contaminated(docs, b).count() == 3 and rows(drop_contaminated(docs, b, shorts=True).select("doc_id")) == [(2,)]


def test_unspaced_scripts(spark):
    item = "請問法國的首都是哪一座城市？答案是巴黎，因為國王住在那裡。"
    docs = spark.createDataFrame([(1, "前文。" + item.replace("，", "、") + "後文"), (2, "前文沒有關係，後文也沒有。" * 5), (3, item[3:15])], "doc_id long, text string")
    assert rows(contamination(docs, bench(spark, item))) == [(1, 0, 3, 31, False)]
    assert rows(drop_contaminated(docs, bench(spark, item)).select("doc_id")) == [(2,), (3,)]


def test_ids_of_letters_and_ids_of_several_texts(spark):
    docs = spark.createDataFrame([(1, ITEM), (2, "clean")], "doc_id long, text string")
    got = rows(contamination(lettered(docs), lettered(bench(spark, ITEM), "item_id")))
    assert got == [("id-1", "id-0", 0, len(ITEM) - 1, False)]
    other = "some other item of nine words for the id"
    two = spark.createDataFrame([(0, ITEM), (0, other)], "item_id long, text string")
    assert rows(contamination(docs.union(spark.createDataFrame([(3, other)], docs.schema)), two)) == [(1, 0, 0, len(ITEM) - 1, False), (3, 0, 0, len(other), False)]


def test_several_automata(spark):
    items = [" ".join(f"i{k}w{j}" for j in range(30)) for k in range(6)]
    docs = spark.createDataFrame([(k, "pre " + t + " post") for k, t in enumerate(items)], "doc_id long, text string")
    want = rows(contamination(docs, bench(spark, *items)))
    assert len(want) == 6 and rows(contamination(docs, bench(spark, *items), Params(limit=500))) == want


def test_odd_rows(spark):
    b = bench(spark, ITEM, None, "", "the same row twice and a few words more to make it long enough")
    found = contamination(clashing(odd(spark)), b)
    assert rows(found) == [(5, 3, 0, 62, False), (5, 3, 0, 62, False)]
    kept = drop_contaminated(odd(spark), b)
    assert kept.count() == odd(spark).count() - 2 and kept.columns == odd(spark).columns
    assert rows(contamination(empty(spark), b)) == [] and rows(contamination(odd(spark), b.limit(0))) == []
    assert normal_words("Été, “naïve” 漢字!") == ["été", "naïve", "漢", "字"] == WORD.findall("été, “naïve” 漢字!")
