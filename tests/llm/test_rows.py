"""Stages of the pipeline on rows that share an id or have none."""

import random

import corpus_pipeline
from privaudit.llm import decontaminate, simhash, suffixes


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "to", "is", "house", "river", "walked", "small", "green", "morning", "letter", "found", "under"]) for _ in range(n)) + "."


def test_rows_without_id_or_with_one_id_are_rows_of_their_own(spark):
    texts = [prose(s, 80) for s in range(4)]
    rows = [(None, texts[0], 1), (None, texts[1], 2), (7, texts[2], 3), (7, texts[3], 4), (None, "!! ## $$", 5), (7, "!! ## $$", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    good = {r["n"] for r in corpus_pipeline.quality_rules(spark, df, "").collect()}
    assert good == {1, 2, 3, 4}
    whole = df.where("n < 5")
    for keep in (corpus_pipeline.near_duplicates(spark, whole, ""), simhash.keep_one(whole)):
        assert {r["n"] for r in keep.collect()} == {1, 2, 3, 4}
    item = spark.createDataFrame([(1, texts[0][:100]), (2, texts[2][:100])], "item_id long, text string")
    assert {r["n"] for r in decontaminate.without_leaks(whole, item).collect()} == {2, 4}


def test_each_row_gets_its_own_text_back(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(None, a, 1), (None, b, 2), (5, b + " end", 3), (5, b + " end", 4), (5, "short", 5), (None, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = {r["n"]: r["text"] for r in suffixes.without_repeats(df, 40).collect()}
    assert got[1] == a and got[5] == "short" and got[6] is None and 2 not in got
    assert [got[n] for n in (3, 4) if n in got] == [b + " end"]
