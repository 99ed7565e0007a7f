import random
import re

import pytest
from pyspark.sql import functions as F

from calyxa.llm import decontaminate as D
from calyxa.llm.scratch import Scratch

_LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOW))


def brute(docs, items):
    grams = set()
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        grams |= {(str(i), tuple(w[k : k + n])) for k in range(len(w) - n + 1)} if n else set()
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, g in grams:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    ids.add(i)
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def found(spark, docs, items):
    df = D.with_row(spark.createDataFrame(docs, "doc_id long, text string"))
    got = D.contamination(df, spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t"))
    rows = got.select("doc_id", "n_words", D.hit_words(F.col("spans")), "items").collect()
    return sorted(((r[0], r[1], r[2], list(r[3])) for r in rows), key=str)


@pytest.mark.parametrize("large", [False, True])
def test_equals_brute_force(spark, monkeypatch, large):
    if large:  # several sets, any word, windows joined by shuffle, blocks shorter than a window
        monkeypatch.setattr(D, "MAX_HASHES", 17)
        monkeypatch.setattr(D, "MAX_VOCABULARY", 0)
        monkeypatch.setattr(D, "MAX_VERIFIED", 0)
        monkeypatch.setattr(D, "BLOCK", 7)
    rng = random.Random(5)
    vocabulary = ["The", "of", "und", "é", "É", "it's", "x9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 9, 10, 11, 14]) if i % 3 else 12)) for i in range(12)] + [(50, None), (51, "..."), (52, "Only-this one"), (3, "again the same")]
    docs = [(i, text(rng.randrange(60))) for i in range(60)]
    docs += [(100 + i, f"start {t}, end") for i, t in items if t] + [(7, None), (7, ""), (None, "only THIS one"), (8, "only this one"), (8, "only this one")]
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert found(spark, [(1, "a b")], []) == [(1, 2, 0, [])]


def test_items_without_an_id(spark):
    assert found(spark, [(1, "a b c")], [(None, "b c"), (4, "c")]) == [(1, 3, 2, ["4"])]


def test_no_shuffle_of_windows(spark):
    """A large benchmark is looked up where texts are scanned: the plan has no exchange but the broadcast of hashes."""
    texts = D.with_row(spark.range(3).selectExpr("id doc_id", "'a b c d' text")).select("row", "doc_id", D.words(F.col("text")).alias("w"))
    hashes = spark.range(5_000_000).selectExpr("xxhash64(id) hash")
    plan = D._scan(texts, hashes, [3, 10], None, True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_long_text_and_clashing_columns(spark):
    long = "word " * 200_000 + "one two three four five six seven eight nine ten"
    assert found(spark, [(1, long)], [(9, "one two three four five six seven eight nine ten")]) == [(1, 200_010, 10, ["9"])]
    df = D.with_row(spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, w string, n_words int"))
    item = spark.createDataFrame([(1, "a b", "x")], "item_id long, text string, gram string")
    assert D.contamination(df, item, Scratch(spark, "t")).first()["items"] == ["1"]
