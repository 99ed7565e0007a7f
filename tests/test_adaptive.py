import numpy as np
import pytest
from pyspark.sql import functions as F

from calyxa import config
from calyxa.adaptive import policies, regret_tree, strategies
from calyxa.adaptive.manager import METRICS, Decision, StrategyManager


def test_best_single_and_split():
    x, y = np.array([[0.0], [0.0], [0.0]]), np.array([[1, 2], [1, 3], [90, 5]])
    assert regret_tree.best_single(y) == (1, 3.0)
    assert regret_tree.is_stub(regret_tree.fit(x, y, 3))
    x = np.array([[0.0], [1.0], [10.0], [11.0]])
    y = np.array([[1, 5], [1, 4], [9, 2], [8, 2]])
    t = regret_tree.fit(x, y, 3)
    assert (t.feature, t.threshold, regret_tree.depth(t)) == (0, 5.5, 1) and regret_tree.regret(t, x, y) == 0
    assert regret_tree.fit(x, y, 1, midpoint=False).threshold == 10.0
    assert regret_tree.is_stub(regret_tree.fit(x, y, 0))
    again, note = regret_tree.from_json(regret_tree.to_json(t, "here"))
    assert again == t and note == "here"


def test_tree_as_column(spark):
    t = regret_tree.Split(0, 5.0, regret_tree.Leaf(1), regret_tree.Split(1, 2.0, regret_tree.Leaf(0), regret_tree.Leaf(2)))
    rows = [(1.0, 0.0), (7.0, 1.0), (7.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double").select(regret_tree.to_column(t, [F.col("a"), F.col("b")]).alias("p"))
    assert [r.p for r in df.collect()] == [regret_tree.predict(t, r) for r in rows] == [1, 0, 2]


def test_simple_policies():
    assert policies.Heuristic(lambda f: int(f[0] > 1)).choose((2,)) == 1
    assert policies.Single(1, 2).choose(()) == 1
    with pytest.raises(ValueError):
        policies.Single(2, 2)
    r = policies.Replay.parse("0 1\n1 2\n0 0\n", "filter")
    assert [r.choose(()), r.choose(())] == [1, 0]
    with pytest.raises(IndexError):
        r.choose(())
    r.end_of_epoch()
    assert r.choose(()) == 1


def test_lower_bound_settles_on_the_cheaper():
    p, rng = policies.LowerBound(2), np.random.default_rng(0)
    picks = []
    for _ in range(300):
        k = p.choose(())
        picks.append(k)
        p.learn((), k, rng.normal((10, 1)[k], 0.1))
    assert picks[:2] == [0, 1] and sum(picks[-100:]) > 90


@pytest.mark.parametrize("kind", [policies.KernelPolicy, policies.BootstrapPolicy])
def test_kernel_policies_learn_by_feature(kind):
    p, rng = kind(2, alpha=0.1, bandwidth=0.2), np.random.default_rng(1)
    assert p.choose((0.5,)) is None
    for x in rng.random(80):
        best = int(x > 0.5)
        costs = rng.normal(5, 0.1, 2)
        costs[best] -= 3
        if p.learn((x,), 0, costs[0]):
            p.learn_all((x,), costs)
    assert p.choose((0.1,)) == 0 and p.sure and p.choose((0.9,)) == 1


def test_freezing_makes_a_tree():
    p = policies.KernelPolicy(2, 0.5, 0.1, freeze_after=10)
    for i in range(11):
        p.learn_all((i / 10,), (0.0, 1.0) if i < 5 else (1.0, 0.0))
    assert p.tree is not None and [p.choose((0.1,)), p.choose((0.9,))] == [0, 1] and not p.learn((0.1,), 0, 1.0)


def test_manager_learns_from_injected_costs(spark):
    frames = [spark.range(1), spark.range(2)]
    cost = {id(frames[0]): 5.0, id(frames[1]): 1.0}
    m = StrategyManager({"filter": policies.KernelPolicy(2, 0.5, 1.0)}, learning=True, measure=lambda df: cost[id(df)])
    for _ in range(8):
        m.run(Decision("filter", (0.5,), [lambda: frames[0], lambda: frames[1]]))
    assert m.log[-1] == ("filter", 1)
    lazy = StrategyManager(measure=lambda df: pytest.fail("measured"))
    assert lazy.run(Decision("sort", (0.0, 1.0), [lambda: frames[0], lambda: frames[1]])) is frames[0]


def test_strategies_give_the_same_rows(spark):
    df = spark.range(1000).select("id", F.concat(F.lit("t"), (F.col("id") % 37).cast("string")).alias("s"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"))
    for d in (
        strategies.filter_strategies(df, F.col("n") < 500, 0.5),
        strategies.needle_strategies(df, F.col("n") < 500, F.col("s").contains("3"), 0.5, 0.5),
        strategies.sort_strategies(df, [F.col("s").asc(), F.col("id").desc()], 0.1, 0.9),
    ):
        a, b = ([tuple(r) for r in s().collect()] for s in d.strategies)
        assert a == b if d.operation == "sort" else sorted(a, key=str) == sorted(b, key=str)


def test_features(spark):
    df = spark.createDataFrame(list(enumerate([3, 1, 2, 2])), "p long, v int")
    assert tuple(strategies.order_features(df, "p", "v").first()) == (3, 3)
    for seed in range(5):
        v = np.random.default_rng(seed).integers(0, 30, 60)
        assert strategies.count_inversions(v) == sum(v[i] > v[j] for i in range(60) for j in range(i + 1, 60))
    assert strategies.count_inversions(np.array([], int)) == 0
    a, b = (spark.createDataFrame([(i,) for i in x], "idx long") for x in ([1, 2, 3, 50], [2, 3, 9]))
    assert tuple(strategies.intersection_features(a, b).first()) == (0.75, 0.5)


def test_subsample_keeps_its_step(spark):
    df = spark.range(10_100_000).withColumnRenamed("id", "p")
    assert strategies.subsample(df, "p", 100).count() == 101_000


def test_order_features_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(strategies, "BLOCK_ROWS", 16)
    v = np.random.default_rng(3).integers(0, 60, 700)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)] + [(9999, None)], "p long, v int")
    want = (int(np.triu(v[:, None] > v[None, :], 1).sum()), len(np.unique(v)))
    assert tuple(strategies.order_features(df, "p", "v").first()) == want
    assert tuple(strategies.order_features(df.limit(0), "p", "v").first()) == (0, 0)


def test_config(tmp_path):
    raw = {"policy": "cake", "parquet_cache_memory_budget_gb": 2, "filter": {"cake": {"alpha": 0.4, "bandwidth": 0.2}}, "single_policy_config": {"sort_policy": 1}}
    c = config.parse(raw)
    assert c.cache_bytes == 2 * 2**30 and c.operations["filter"].alpha == 0.4 and c.single == {"filter": 0, "query_plan": 1, "sort": 1}
    assert isinstance(c.manager().policies["filter"], policies.KernelPolicy)
    assert isinstance(config.parse({"policy": "single_policy"}).manager().policies["plan"], policies.Single)
    made = config.parse({"policy": "cake", "string_contains_feature_sample_ratio": 0.5, "filter": {"metric_type": "cpu"}}).manager()
    assert made.samples["plan"] == 0.5 and made.measure is METRICS["cpu"]
    (tmp_path / "r").write_text("1 0\n")
    assert config.parse({"policy": "oracle_machine", "oracle_policies_path": str(tmp_path / "r")}).manager().policies["sort"].choose(()) == 0
    for bad in ({"policy": "nope"}, {"policy": "oracle_machine"}, {"filter": {"metric_type": "cycles"}}, {"sort": {"num_features": 1}}):
        with pytest.raises(ValueError):
            config.parse(bad)
    (tmp_path / "c.yml").write_text("policy: non_contextual_ucb\n")
    assert isinstance(config.load(tmp_path / "c.yml").manager().policies["sort"], policies.LowerBound)


def test_intersections(spark):
    from calyxa.adaptive import intersect

    a, b = (spark.createDataFrame([(i,) for i in x], "idx long") for x in (range(1, 7), range(4, 10)))
    for s in intersect.STRATEGIES:
        assert sorted(r.idx for r in s(a, b).collect()) == [4, 5, 6] and s(a.limit(0), b).count() == 0
    costs = iter([3.0, 1.0, 2.0] * 2)
    text = intersect.train(spark, sizes=(5, 50), whole=100, repeats=1, measure=lambda df: next(costs))
    chosen, again = intersect.load_or_train(spark, text)
    assert again == text and chosen.tree == regret_tree.Leaf(1) and chosen.intersect(a, b).count() == 3
    assert intersect.Intersector(regret_tree.Split(0, 0.5, regret_tree.Leaf(2), regret_tree.Leaf(0))).intersect(a, b).count() == 3


def test_queries_with_a_manager_give_the_same_rows(spark, tmp_path):
    from calyxa.plans import query as Q

    spark.range(500).select("id", F.concat(F.lit("x"), (F.col("id") % 10).cast("string")).alias("s")).coalesce(1).write.parquet(str(tmp_path / "t"))
    q = Q.Query("q", (Q.LoadParquet("t"), Q.LessThan("id", 400), Q.SmartStringOnTop("s", "3", "id", 200), Q.SortBy("id")))
    m = StrategyManager({"filter": policies.LowerBound(2), "plan": policies.LowerBound(2)}, learning=True)
    want = Q.compile_query(spark, str(tmp_path), q).collect()
    for _ in range(3):
        assert Q.compile_query(spark, str(tmp_path), q, manager=m, sample=0.5).collect() == want
    assert [op for op, _ in m.log] == ["filter", "plan", "sort"] * 3 and len({k for _, k in m.log}) == 2
    plan = Q.compile_query(spark, str(tmp_path), q, manager=StrategyManager())._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "LessThan(id,200)" in plan


def test_cpu_is_measured(spark):
    df = spark.range(2_000_000).selectExpr("count_if(sha2(cast(id as string), 256) like '00%') n")
    assert METRICS["cpu"](df) > 0.05


def test_chunks(spark):
    assert [strategies.chunk_count(n, 10) for n in (0, 19, 20, 21)] == [1, 1, 2, 3]
    df = spark.range(35).withColumnRenamed("id", "p")
    got = strategies.chunked(df, "p", 35, 10)
    assert {r["chunk"]: r["count"] for r in got.groupBy("chunk").count().collect()} == {0: 10, 1: 10, 2: 10, 3: 5}
    assert {r.chunk for r in strategies.chunked(df, "p", 35, 20).collect()} == {0}
