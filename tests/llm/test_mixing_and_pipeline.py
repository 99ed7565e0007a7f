import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from calyxa.llm import catalog, mixing
from calyxa.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_raking_meets_all_targets(spark):
    rng = random.Random(1)
    rows = [(s, g, t, rng.randrange(1, 500)) for s in "abcd" for g in "xyz" for t in "pq"] + [("none", "x", "p", 0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = [("source", v, s) for v, s in zip("abcd", (1.0, 1.0, 2.0, 4.0), strict=True)] + [("lang", v, 1.0) for v in "xyz"] + [("topic", "p", 3.0), ("topic", "q", 1.0), ("topic", "absent", 9.0)]
    got = mixing.rake(cells, spark.createDataFrame(targets, "dim string, value string, share double"), Scratch(spark, "m"), rounds=30).collect()
    total, sums = sum(r[3] for r in rows), {}
    for r in got:
        for k in (("source", r.source), ("lang", r.lang), ("topic", r.topic)):
            sums[k] = sums.get(k, 0) + r.tokens * r.weight / total
    assert len(got) == len(rows) and [r.weight for r in got if r.source == "none"] == [1.0]
    for d, v, s in targets:
        if v != "absent":
            whole = sum(x for e, w, x in targets if e == d and w != "absent")
            assert abs(sums[d, v] - s / whole) < 1e-6


def _off(rows, targets, got):
    """The largest relative error of a margin."""
    total = sum(r[3] for r in rows)
    off = 0.0
    for d in mixing.DIMS:
        whole = sum(s for e, _, s in targets if e == d)
        for e, v, s in targets:
            if e == d:
                off = max(off, abs(sum(r.tokens * r.weight for r in got if r[d] == v) / total * whole / s - 1))
    return off


def test_raking_of_skewed_cells_goes_on_until_targets_are_met(spark):
    rows = [(f"s{i}", g, t, (9000 if g == "wxyz"[i % 4] else 60) * (1 + i % 3)) for i in range(8) for g in "wxyz" for t in "pq"]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = [("source", f"s{i}", 1.0 + i) for i in range(8)] + [("lang", g, s) for g, s in zip("wxyz", (5.0, 2.0, 2.0, 3.0), strict=True)] + [("topic", "p", 2.0), ("topic", "q", 1.0)]
    got = mixing.rake(cells, spark.createDataFrame(targets, "dim string, value string, share double"), Scratch(spark, "m")).collect()
    assert _off(rows, targets, got) < 1.01e-4


def test_raking_ends_when_targets_cannot_be_met(spark, caplog):
    rows = [("a", "x", "p", 10), ("b", "y", "p", 10)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = [("source", "a", 1.0), ("source", "b", 3.0), ("lang", "x", 1.0), ("lang", "y", 1.0), ("topic", "p", 1.0)]
    got = mixing.rake(cells, spark.createDataFrame(targets, "dim string, value string, share double"), Scratch(spark, "m")).collect()
    assert len(got) == 2 and "can't be met" in caplog.text


def test_sampling_follows_the_probabilities(spark):
    rows = [(i, "one two three", "en" if i % 3 else "de", "s" if i % 10 else None, 1) for i in range(4000)]
    df = mixing.mix(spark.createDataFrame(rows, DOCS).withColumn("k_source", F.lit(1)), Scratch(spark, "m"))
    got = df.groupBy("lang", "source").agg(F.avg("mix_probability").alias("p"), F.avg(F.col("mix_sampled").cast("int")).alias("q"), F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == 4 and all(abs(r.p - r.q) < 4 * (r.p * (1 - r.p) / r.n) ** 0.5 + 1e-9 for r in got)
    assert df.where("abs(mix_copies - mix_weight) >= 1 or mix_probability > 1 or mix_sampled != (mix_copies > 0)").isEmpty() and "k_source" in df.columns
    assert mixing.sampled(df).count() == df.agg(F.sum("mix_copies")).first()[0]


def test_sample_meets_its_targets(spark):
    """Shares of the sample's tokens, copies counted, lie within sampling error of the targets, also where weights are far above 1."""
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), rng.choice(["en", "en", "en", "de"]), "big" if i % 10 else f"s{i % 3}", 1) for i in range(6000)]
    targets = [("source", "big", 1.0), ("source", "s0", 2.0), ("source", "s1", 1.0), ("source", "s2", 1.0), ("lang", "en", 1.0), ("lang", "de", 1.0), ("topic", "brief", 1.0)]
    made = mixing.mix(spark.createDataFrame(rows, DOCS), Scratch(spark, "m"), targets=spark.createDataFrame(targets, "dim string, value string, share double"))
    got = {(r.dim, r.value): r for r in mixing.reached(made).collect()}
    assert made.agg(F.max("mix_weight")).first()[0] > 5
    for d, v, s in targets:
        goal = s / sum(x for e, _, x in targets if e == d)
        assert abs(got[d, v].target - goal) < 2e-4 and abs(got[d, v].share - goal) < 0.02, (d, v)


def test_cells_may_be_many(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELLS", 3)
    rows = [(i, "a b c", "en", f"s{i % 7}", 1) for i in range(50)]
    made = mixing.mix(spark.createDataFrame(rows, DOCS), Scratch(spark, "m"))
    assert made.count() == 50 and max(abs(r.target - r.share) for r in mixing.reached(made).collect()) < 0.15


def test_mixing_edges(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a  b\n", "en", "s", 3), (3, "x " * 300_000, "de", "t", 1)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), Scratch(spark, "m")).collect()
    assert sorted(r.mix_tokens for r in got) == [0, 0, 0, 2, 300_000] and all(0 <= r.mix_probability <= 1 for r in got)
    assert mixing.mix(spark.createDataFrame([], DOCS), Scratch(spark, "m")).count() == 0
    blank = mixing.mix(spark.createDataFrame(rows[:2], DOCS), Scratch(spark, "m")).collect()
    assert [r.mix_weight for r in blank] == [1.0, 1.0]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("the", "rea", "sto", "min", "lo") for b in ("ne", "ding", "ver", "t", "s")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    leak = text(12)
    docs = [(i, text(rng.randrange(40, 90)), "en", f"s{i % 3}", 1) for i in range(80)]
    docs += [(100 + i, " ".join(f"{w}%%%" for w in text(40).split()), "en", "s0", 1) for i in range(20)]
    docs += [(200 + i, docs[i][1] + " tail", "en", "s1", 1) for i in range(5)] + [docs[7], docs[7]]
    docs += [(300, f"{text(30)} {leak} {text(30)}", "en", "s2", 1), (301, f"{text(50)} und.34@mail7.example.com", "en", "s2", 1), (302, None, None, None, None), (None, text(60), "de", "s0", 1)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(not 100 <= i < 120), 0) for i, *_ in docs if i is not None and i < 120]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs


def test_stages(spark, sf):
    d, docs = sf
    at = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("clash")).withColumn("Row", F.lit(3))
    columns = at.columns
    seen = []
    for name, stage in C.STAGES[:-1]:
        at = Scratch(spark, "s").table(stage(spark, at, d), "x")
        assert at.columns == columns, name
        seen.append([r.asDict() for r in at.collect()])
    ids = [sorted(str(r["doc_id"]) for r in rows) for rows in seen]
    assert not any(str(i) in ids[0] for i in range(100, 120)) and set(map(str, range(80))) <= set(ids[0])
    assert not any(str(i) in ids[1] for i in range(200, 205)) and ids[1].count("7") == 1 and {"None", "302"} <= set(ids[1])
    assert set(ids[1]) - set(ids[2]) == {"300"} and len(ids[2]) == len(ids[1]) - 1
    before, after = ({r["doc_id"]: r["text"] for r in rows} for rows in seen[2:])
    assert {i for i in before if before[i] != after[i]} == {301} and "und.34@" not in after[301]
    assert all(r["score"] == "clash" and r["Row"] == 3 for r in seen[3])


def test_run(spark, sf):
    d, _ = sf
    out = C.run(spark, d)
    assert out.count() > 0 and {"doc_id", "text", "mix_weight", "mix_probability", "mix_copy"} <= set(out.columns)
    assert out.select("doc_id", "text").distinct().count() <= 82 and out.where("mix_copy < 1 or mix_copy > mix_copies").isEmpty()


def test_ids_with_several_texts(spark):
    """Rows are dropped by id and text: no text without a near duplicate is lost, and of each group one row stays."""
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(3, a), (5, b), (5, a), (6, c), (7, c + " tail"), (7, d), (7, d), (8, e), (8, e + " tail"), (9, e), (5, None), (None, a), (None, a), (10, ""), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumn("group", F.lit(1)).withColumn("text_hash", F.lit("x"))
    out = C.one_of_each_group(spark, docs, "")
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert out.columns == docs.columns
    kept_e = [r for r in got if r[0] == 8]
    assert len(kept_e) == 1 and kept_e[0][1] in (e, e + " tail")
    assert [r for r in got if r[0] != 8] == sorted([(3, a), (5, b), (6, c), (7, d), (5, None), (None, a), (None, a), (10, ""), (10, "")], key=str)


def test_stages_on_very_long_texts(spark, sf):
    d, docs = sf
    long = " ".join(f"w{i}" for i in range(60_000))
    at = spark.createDataFrame([(1, long, "en", "s", 1), (2, long + " end", "en", "s", 1), (3, long[::-1] + " " + docs[-4][1], "en", "s", 1)], DOCS)
    assert [r.doc_id for r in C.one_of_each_group(spark, at, d).orderBy("doc_id").collect()] == [1, 3]
    assert sorted(r.doc_id for r in C.decontaminated(spark, at, d).collect()) == [1, 2] and C.keep_quality(spark, at, d).count() <= 3


def test_key_of_pseudonyms(spark):
    assert C.pseudonym_key(spark) != C.pseudonym_key(spark) and len(C.pseudonym_key(spark)) == 32
    spark.conf.set(C.KEY_SETTING, "00ff")
    try:
        assert C.pseudonym_key(spark) == b"\x00\xff"
    finally:
        spark.conf.unset(C.KEY_SETTING)


def test_run_on_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert C.run(spark, d).count() == 0


def test_catalogue():
    assert sorted(int(k[2:].split("_")[0]) for k in catalog.queries()) == list(range(1, 11))
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
