import struct
import pytest
from pyspark.sql import functions as F

from calyxa.functions import scalar
from calyxa.operators import aggregates, joins, ranks, selection, tables
from calyxa.operators.aggregates import Agg, UserAgg
from calyxa.plans import predicates as P
from calyxa.plans import query as Q
from calyxa.sources.parquet import POS


def positioned(spark, rows, schema):
    names = [f"`{x.split()[0]}`" for x in schema.split(", ")]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{POS} long, {schema}").select(*names, POS)


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_aggregates(spark):
    df = spark.createDataFrame([(7, 40), (8, 11), (9, 5), (7, -40), (8, -6), (9, 25), (70, 2), (None, None)], "k int, v int")
    aggs = [Agg("count", None, "n"), Agg("min", "v", "mn"), Agg("max", 1, "mx"), Agg("sum", "v", "s"), Agg("mean", "v", "m")]
    got = {r.k: tuple(r)[1:] for r in aggregates.aggregate(df, ["k"], aggs).collect()}
    assert got[7] == (2, -40, 40, 0, 0.0) and got[9] == (2, 5, 25, 30, 15.0) and got[None] == (1, None, None, None, None)
    with pytest.raises(ValueError):
        aggregates.aggregate(df, ["k"], [Agg("median", "v", "x")])
    assert aggregates.group_count(df, ["k"]).first()[0] == 5


def test_tickets_are_dense_and_first_seen(spark):
    df = positioned(spark, [(x,) for x in (6, 4, 4, 9, 9, 6, 4, -70, None)], "a int")
    got = {r[POS]: r.ticket for r in aggregates.tickets(df, "a").collect()}
    assert [got[i] for i in range(9)] == [0, 1, 1, 2, 2, 0, 1, 3, 4]
    order = [r.a for r in aggregates.aggregate(df, ["a"], [Agg("count", None, "n")], first_seen=True).collect()]
    assert order == [6, 4, 9, -70, None]


def test_aggregates_of_ones_own(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, 4.0, 3.0), (2, 5.0, 2.0), (2, None, 1.0)], "k int, v double, w double")
    mean = UserAgg("m", ("v", "w"), {"s": lambda v, w: F.sum(v * w), "n": lambda v, w: F.sum(F.when(v.isNotNull(), w))}, lambda st: st["s"] / st["n"])
    assert {r.k: r.m for r in aggregates.aggregate(df, ["k"], [mean]).collect()} == {1: 3.5, 2: 5.0}
    assert "partial_sum" in aggregates.aggregate(df, ["k"], [mean])._jdf.queryExecution().executedPlan().toString()


def test_ranks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = ranks.with_rank(df, ["x"]).collect()
    assert all(r["rank"] == r["x"] for r in got) and len(got) == 1000
    assert ranks.with_rank(df.limit(0), ["x"]).count() == 0


def test_join_names_keys_and_nulls(spark):
    build = spark.createDataFrame([(x,) for x in (4, 5, 5, 8, 8, 4, 5, 90, 4, 5, None)], "a int")
    probe = spark.createDataFrame([(4,), (5,), (8,), (None,)], "b int")
    df = joins.hash_join(build, probe, [0], build_name="t", probe_name="u")
    assert df.columns == ["t_a", "u_b"] and df.count() == 9 and df.where("t_a != u_b").count() == 0
    with pytest.raises(ValueError):
        joins.hash_join(build, build, [0])
    with pytest.raises(ValueError):
        joins.hash_join(build, probe, [])


def test_join_keys_at_any_place(spark):
    a = spark.createDataFrame([(10, 20, 1), (11, 21, 2), (12, 22, 3)], "x int, y int, k int")
    b = spark.createDataFrame([(5, 1, 7), (6, 2, 8), (7, 3, 9), (8, 4, 10)], "d int, k int, e int")
    df = joins.hash_join(a, b, [2], [1], "a", "b")
    assert df.columns == ["a_x", "a_y", "a_k", "b_d", "b_k", "b_e"] and df.where("a_k = b_k").count() == 3


def test_multi_join(spark):
    emp = spark.createDataFrame([(1, 10, 5), (2, 10, 6), (3, 20, 7), (4, 30, 8)], "id int, dept int, pay int")
    dept = spark.createDataFrame([(10, 100), (20, 200), (30, 300)], "id int, budget int")
    proj = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30)], "id int, dept int")
    steps = [joins.JoinStep("dept", ("emp_dept",), ("id",)), joins.JoinStep("proj", ("dept_id",), ("dept",))]
    df = joins.multi_join({"emp": emp, "dept": dept, "proj": proj}, "emp", steps)
    assert df.columns == ["proj_id", "proj_dept", "dept_id", "dept_budget", "emp_id", "emp_dept", "emp_pay"]
    assert {r.dept_id: r["count"] for r in df.groupBy("dept_id").count().collect()} == {10: 4, 20: 1, 30: 1}
    assert joins.multi_join({"emp": emp}, "emp", [joins.JoinStep("nope", ("emp_id",), ("id",))]).count() == 0


def test_membership_is_exact(spark):
    keys = spark.createDataFrame([(x,) for x in (3, 8, 14, 77, 8, None)], "k int")
    df = spark.createDataFrame([(x,) for x in (3, 8, 15, -3, 77, None)], "a int")
    assert values(joins.member_of(df, "a", keys), "a") == [(3,), (8,), (77,)]


def test_chain_lengths_of_any_key(spark):
    df = spark.range(1000).selectExpr("id", "concat('k', id % 50) s", "id / 3.0D f")
    for key in ("id", "s", "f"):
        assert joins.chain_lengths(df, key, 16).agg(F.sum("chain_len")).first()[0] == 1000


def test_stacking_and_slices(spark):
    a = positioned(spark, [(1, "x"), (2, "y"), (3, "z")], "a int, s string")
    b = positioned(spark, [(4, "p"), (5, "q"), (6, "r")], "b int, s string")
    df = tables.side_by_side(a, b)
    assert df.columns == [POS, "a", "L_s", "b", "R_s"] and values(df, "a", "L_s", "b", "R_s") == [(1, "x", 4, "p"), (2, "y", 5, "q"), (3, "z", 6, "r")]
    assert values(tables.slice_rows(a, 1, 3), POS, "a") == [(0, 2), (1, 3)]
    joined = tables.concat(a.select("a", "s"), a.select("s", "a"))
    assert joined.columns == ["a", "s"] and joined.count() == 6
    assert tables.literal_table(spark, [[1, 2], [3, 4]]).columns == ["$0", "$1"]
    with pytest.raises(ValueError):
        tables.rename(a, ["x", "x", "y"])


def test_take_and_interleave(spark):
    a = positioned(spark, [("a0",), ("a1",)], "v string")
    b = positioned(spark, [("b0",), ("b1",)], "v string")
    idx = spark.createDataFrame([(0, 1), (1, None), (2, 1), (3, 7)], "j int, i int")
    assert {r.j: r.v for r in tables.take(a, idx, "i").collect()} == {0: "a1", 1: None, 2: "a1", 3: None}
    pairs = spark.createDataFrame([(0, 0, 1), (1, 1, 0), (2, 1, 1)], "j int, t int, i int")
    assert values(tables.interleave([a, b], pairs, "t", "i"), "j", "v") == [(0, "a1"), (1, "b0"), (2, "b1")]


@pytest.mark.parametrize("n", [0, 1, 3, -1, -4, 10, -10])
def test_shift(spark, n):
    xs = [5, 1, None, 3, 7, 2]
    got = {r[POS]: r.v for r in tables.shift(positioned(spark, [(x,) for x in xs], "a int"), "a", n, "v").collect()}
    assert [got[i] for i in range(6)] == [xs[i - n] if 0 <= i - n < 6 else None for i in range(6)]


def test_runs(spark):
    flags = [True, True, False, True, None, True, True]
    df = positioned(spark, [(x,) for x in flags], "f boolean")
    assert tables.runs_ended(df, F.col("f")).first().runs == 2
    xs = [1, 1, None, None, 2, 1, 1, 1]
    df = positioned(spark, [(x,) for x in xs], "a int")
    runs = tables.run_lengths(df, "a")
    assert sorted((r.run_id, r.v, r.run_end) for r in runs.collect()) == [(1, 1, 2), (2, None, 4), (3, 2, 5), (4, 1, 8)]
    back = {r[POS]: r.v for r in tables.run_decode(runs).collect()}
    assert [back[i] for i in range(8)] == xs


def test_own_columns_clash_with_none(spark):
    names = ["__at", "__table", "__member", "__k", "__first", "__id", "__part", "__before", "__key0"]
    df = spark.createDataFrame([(i,) + (i % 3,) * len(names) for i in range(6)], ", ".join(f"`{c}` long" for c in [POS, *names]))
    indices = df.select(*names, F.col("__at").alias("i"), F.lit(0).alias("t"))
    values = df.select(POS, (F.col(POS) * 10).alias("v"))
    assert sorted(r.v for r in tables.take(values, indices, "i").collect()) == [0, 0, 10, 10, 20, 20]
    assert set(tables.interleave([values], indices, "t", "i").columns) == {*names, "i", "t", "v"}
    assert joins.member_of(df, "__member", values.where("v = 10").select((F.col("v") / 10).cast("long"))).count() == 2
    assert [r.n for r in aggregates.tickets(df, "__k", "n").orderBy(POS).collect()] == [0, 1, 2, 0, 1, 2]
    assert aggregates.aggregate(df, ["__first"], [Agg("count", None, "n")], first_seen=True).collect() == [(0, 2), (1, 2), (2, 2)]
    assert {r[POS]: r.r for r in ranks.with_rank(df, [F.col(POS).desc()], "r").collect()} == {i: 5 - i for i in range(6)}
    query = Q.Query("q", (Q.LoadParquet("t"), Q.SortBy("__key0"), Q.FilterTop(3)))
    assert Q.compile_query(spark, "", query, loader=lambda path, positions, first: df).columns == names


def test_argsort_is_stable(spark):
    xs = [5, 1, 9, 3, 7, 0, 2, 5, 0]
    df = positioned(spark, [(x,) for x in xs], "a int")
    for down in (False, True):
        got = {r.rank_pos: r[POS] for r in tables.argsort(df, "a", down).collect()}
        assert [got[i] for i in range(9)] == sorted(range(9), key=lambda i: (-xs[i] if down else xs[i], i))


def test_equality(spark):
    a = spark.createDataFrame([(1, None), (2, 2), (None, None)], "x int, y int")
    assert tables.differing_rows(a, "x", "y").first().n_diff == 1
    assert tables.same_rows(a, a) and not tables.same_rows(a, a.union(a)) and not tables.same_rows(a, a.select("x"))


def test_selection_algebra(spark):
    df = positioned(spark, [(i,) for i in range(30)], "a int")
    s = selection.select_where(df, P.In("a", (4, 10, 12, 15, 22, 25)))
    assert values(selection.slice_selection(s, 11, 21), "idx") == [(1,), (4,)]
    assert values(selection.slice_selection(s, 1, 25), "idx") == [(3,), (9,), (11,), (14,), (21,)]
    t = selection.select_where(df, P.GreaterThan("a", 11))
    assert values(selection.intersect(s, t), "idx") == [(12,), (15,), (22,), (25,)]
    assert selection.union(s, t).count() == 20 and selection.invert(df, t).count() == 12
    assert selection.contains(s, 4) and not selection.contains(s, 5)
    assert selection.is_none(s.limit(0)) and not selection.is_all(df, s) and selection.is_all(df, selection.select_where(df, P.All()))
    assert values(selection.filter_selected(df, s, lambda c: c % 2 == 1, "a"), "idx") == [(15,), (25,)]
    assert values(selection.map_selected(df, s, lambda c: c * 2, "a", "d"), "d")[:2] == [(8,), (20,)]
    assert selection.bitmap(s).count() == 1 and values(selection.positions(selection.bitmap(s)), "idx") == values(s, "idx")
    far = spark.createDataFrame([(i,) for i in (0, 32_767, 32_768, 100_000)], "idx long")
    assert values(selection.positions(selection.bitmap(far)), "idx") == values(far, "idx")


def mixed(v):
    """The hash in plain Python."""
    m = 2**64 - 1
    v &= m
    for k in (scalar.MIX_1, scalar.MIX_2):
        v ^= v >> 33
        v = (v & 0xFFFFFFFF) * k & m
    v ^= v >> 33
    return v - 2**64 if v >> 63 else v


def test_hash(spark):
    xs = [*range(-1000, 1000), 2**31, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(x,) for x in xs], "v long").select("v", scalar.mix_hash(F.col("v")).alias("h"))
    assert all(r.h == mixed(r.v) for r in df.collect()) and mixed(1) == 1771841920360893980
    xs = [0.0, -0.0, 1.5, -2.25e300, float("inf"), None]
    df = spark.createDataFrame([(x,) for x in xs], "v double").select("v", scalar.mix_hash(F.col("v"), "double").alias("h"))
    assert [r.h for r in df.collect()] == [None if x is None else mixed(struct.unpack("<q", struct.pack("<d", x))[0]) for x in xs]


def test_masks_and_sizes(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "a int, m boolean")
    assert [r[0] for r in df.select(scalar.null_if(F.col("a"), F.col("m"))).collect()] == [None, 2, 3]
    assert [r[0] for r in df.select(scalar.if_else(F.col("m"), F.lit(1), F.lit(0))).collect()] == [1, 0, 0]
    t = spark.createDataFrame([("abc", [1, 2])], "s string, x array<int>")
    assert tuple(t.select(scalar.value_bytes(F.col("s"), "string"), scalar.value_bytes(F.col("x"), "array<int>")).first()) == (7, 12)
    t = spark.sql("select named_struct('a', 1, 'b', 'xy') s, map('k', 2L, 'll', 3L) m")
    assert tuple(t.select(*[scalar.value_bytes(F.col(c), t.schema[c].dataType) for c in "sm"]).first()) == (10, 4 + 5 + 6 + 16)
    texts = [r[0] for r in spark.range(400).select(scalar.random_text(F.col("id"), ["a", "b"], "P", 0.5)).collect()]
    assert 150 < sum("P" in t for t in texts) < 250 and all(t.split()[0] in "ab" for t in texts) and len(set(texts)) > 100
