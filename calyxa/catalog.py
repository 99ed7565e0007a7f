"""The registered queries of the engine: one for each operator, over the driver's tables."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyxa.adaptive import policies, regret_tree, strategies
from calyxa.adaptive.intersect import STRATEGIES, Intersector
from calyxa.adaptive.manager import DEFAULT_RULES, StrategyManager
from calyxa.functions import scalar
from calyxa.operators import aggregates, joins, selection, tables
from calyxa.operators.aggregates import Agg, UserAgg
from calyxa.plans import predicates as P
from calyxa.plans import query as Q
from calyxa.runner import run_query
from calyxa.sources import parquet as sources
from calyxa.sources.parquet import POS, load, load_with_position
from calyxa.sources.scratch import materialized

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def registered(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return load(spark, f"{d}/{name}.parquet")


def _p(spark: SparkSession, d: str, name: str) -> DataFrame:
    return load_with_position(spark, f"{d}/{name}.parquet")


def _dsl(name: str, table: str, *ops: Q.Op, columns: tuple[str, ...]) -> None:
    """A query of the pipeline language: load, ops, projection."""
    query = Q.Query(name, (Q.LoadParquet(f"{table}.parquet"), *ops, Q.SelectColumns(columns)))
    QUERIES[name] = lambda spark, d: Q.compile_query(spark, d, query)


def _where(df: DataFrame, p: P.Predicate) -> DataFrame:
    return df.where(p.column(df))


_OC = ("o_orderkey", "o_custkey")
_LL = ("l_orderkey", "l_linenumber")

# scans, projections, predicates, sorts

QUERIES["scan_parquet"] = lambda s, d: tables.select(_t(s, d, "nation"), ["n_nationkey", "n_name", 2])
_dsl("select_columns", "orders", columns=("o_totalprice", "o_orderkey"))
_dsl("filter_lt", "orders", Q.LessThan("o_custkey", 100), columns=_OC)
_dsl("filter_le", "orders", Q.LessThanOrEqual("o_custkey", 100), columns=_OC)
_dsl("filter_gt", "orders", Q.GreaterThan("o_custkey", 1400), columns=_OC)
_dsl("filter_ge", "orders", Q.GreaterThanOrEqual("o_custkey", 1400), columns=_OC)
_dsl("filter_eq", "lineitem", Q.Equals("l_linenumber", 3), columns=_LL)
_dsl("filter_ne", "lineitem", Q.NotEquals("l_linenumber", 3), columns=_LL)
_dsl("filter_between_exclusive", "part", Q.Between("p_size", 10, 20), columns=("p_partkey", "p_size"))
_dsl("filter_in", "lineitem", Q.In("l_suppkey", (1, 5, 9)), columns=("l_orderkey", "l_suppkey"))
_dsl("filter_or", "part", Q.LessThan("p_size", 5), Q.Or(), Q.GreaterThan("p_size", 45), columns=("p_partkey", "p_size"))
_dsl("string_contains", "part", Q.StringContains("p_name", "ring"), columns=("p_partkey", "p_name"))
_dsl("smart_string_on_top", "documents", Q.SmartStringOnTop("text", "the", "n_chars", 2000), columns=("doc_id", "n_chars"))
_dsl("sort_asc_topk", "orders", Q.SortBy("o_custkey"), Q.FilterTop(100), columns=_OC)
_dsl("topk_desc", "orders", Q.SortBy("o_custkey", "Descending"), Q.FilterTop(100), columns=_OC)
_dsl("filter_top_file_order", "orders", Q.FilterTop(250), columns=("o_orderkey", "o_totalprice"))
_dsl("set_selection", "orders", Q.SetSelection((0, 3, 9, 2000, 14999)), columns=_OC)
_dsl(
    "dsl_pipeline",
    "orders",
    Q.GreaterThan("o_orderkey", 100),
    Q.And(),
    Q.LessThan("o_custkey", 700),
    Q.StringContains("o_orderpriority", "URGENT"),
    Q.SortBy("o_orderkey", "Descending"),
    Q.FilterTop(50),
    columns=_OC,
)


def _sized(s: SparkSession, d: str, gone: int = 10) -> DataFrame:
    """part with the size `gone` turned to null."""
    return _t(s, d, "part").select("p_partkey", scalar.null_if(F.col("p_size"), F.col("p_size") == gone).alias("s"))


@registered
def filter_is_null(s, d):
    return _where(_sized(s, d), P.IsNull("s")).select("p_partkey")


@registered
def filter_not_null(s, d):
    return _where(_sized(s, d), P.NotNull("s"))


@registered
def filter_not_complement(s, d):
    return _where(_sized(s, d), P.Not(P.LessThan("s", 20)))


@registered
def filter_col_eq(s, d):
    df = _t(s, d, "lineitem")
    return _where(df, P.ColumnsEqual("l_suppkey", "l_linenumber")).select("l_orderkey", "l_suppkey", "l_linenumber")


@registered
def filter_and(s, d):
    p = [P.LessThan("l_suppkey", 50), P.GreaterThan("l_linenumber", 2), P.GreaterOrEqual("l_partkey", 100), P.LessOrEqual("l_orderkey", 9000)]
    return _where(_t(s, d, "lineitem"), P.multi_and(p)).select("l_orderkey")


@registered
def filter_partial_lt(s, d):
    return _where(_t(s, d, "lineitem"), P.Then(P.LessThan("l_suppkey", 50), P.LessThan("l_linenumber", 3))).select(*_LL)


@registered
def string_contains_partial(s, d):
    return _where(_t(s, d, "part"), P.Then(P.LessThan("p_size", 10), P.Contains("p_name", "ed"))).select("p_partkey", "p_name")


@registered
def string_like(s, d):
    return _where(_t(s, d, "part"), P.Like("p_name", "red%g_t") | P.Like("p_name", "%bolt")).select("p_partkey", "p_name")


@registered
def sort_null_as_zero(s, d):
    sized = _p(s, d, "part").select("p_partkey", scalar.null_if(F.col("p_size"), F.col("p_size") == 50).alias("s"), POS)
    query = Q.Query("q", (Q.LoadParquet("part.parquet"), Q.SortBy("s"), Q.FilterTop(80)))
    return Q.compile_query(s, d, query, loader=lambda path, positions, first: sized)


@registered
def argsort_indices(s, d):
    df = tables.argsort(_p(s, d, "supplier"), "s_nationkey")
    return df.select(F.col("s_suppkey").alias("idx"), "rank_pos")


@registered
def redundant_bound_elimination(s, d):
    df = _t(s, d, "orders")
    p = P.tightest_bounds(P.LessThan("o_custkey", 300) & P.LessThan("o_custkey", 200) & P.NotNull("o_custkey"))
    return _where(df, p).select("o_orderkey")


# joins


@registered
def join_inner(s, d):
    build = _t(s, d, "customer").select("c_custkey", "c_nationkey")
    probe = _t(s, d, "orders").select(*_OC)
    return joins.hash_join(build, probe, ["c_custkey"], ["o_custkey"], "customer", "orders")


@registered
def join_multi_key(s, d):
    a = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber")
    b = _t(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 7 + 1).cast("int").alias("ln"), "o_custkey")
    return joins.hash_join(a, b, [0, 1], [0, 1], "a", "b").select("a_l_orderkey", "a_l_linenumber", "b_o_custkey")


@registered
def join_multi_table(s, d):
    named = {"s": _t(s, d, "supplier"), "n": _t(s, d, "nation"), "r": _t(s, d, "region")}
    steps = [joins.JoinStep("n", ("s_s_nationkey",), ("n_nationkey",)), joins.JoinStep("r", ("n_n_regionkey",), ("r_regionkey",))]
    df = joins.multi_join(named, "s", steps)
    return df.select(F.col("r_r_name").alias("r_name"), F.col("n_n_name").alias("n_name"), F.col("s_s_suppkey").alias("s_suppkey"))


def _nation_customers(s: SparkSession, d: str) -> DataFrame:
    return _where(_t(s, d, "customer"), P.Equals("c_nationkey", 3)).select("c_custkey")


@registered
def xor_filter_semi(s, d):
    return joins.member_of(_t(s, d, "orders"), "o_custkey", _nation_customers(s, d)).select(*_OC)


@registered
def xor_filter_partial(s, d):
    some = _where(_t(s, d, "orders"), P.LessThan("o_orderkey", 5000))
    return joins.member_of(some, "o_custkey", _nation_customers(s, d)).select(*_OC)


@registered
def join_chain_lengths(s, d):
    return joins.chain_lengths(_t(s, d, "orders"), "o_custkey", 32)


# aggregates

_AGGREGATES = {
    "agg_count": ("lineitem", "l_linenumber", [Agg("count", None, "cnt")]),
    "agg_min_max": ("lineitem", "l_suppkey", [Agg("min", "l_partkey", "min_part"), Agg("max", "l_partkey", "max_part")]),
    "agg_sum": ("lineitem", "l_suppkey", [Agg("sum", "l_partkey", "sum_part")]),
    "agg_min_string": ("part", "p_size", [Agg("min", "p_name", "min_name")]),
}
for _name, (_table, _key, _aggs) in _AGGREGATES.items():
    QUERIES[_name] = lambda s, d, t=_table, k=_key, a=_aggs: aggregates.aggregate(_t(s, d, t), [k], a)


@registered
def agg_mean(s, d):
    df = aggregates.aggregate(_t(s, d, "lineitem"), ["l_suppkey"], [Agg("mean", "l_partkey", "mean_part")])
    return df.withColumn("mean_part", F.round("mean_part", 6))


@registered
def agg_multi(s, d):
    some = _where(_t(s, d, "orders"), P.LessThan("o_orderkey", 6000))
    aggs = [Agg("count", None, "cnt"), Agg("min", "o_orderkey", "mn"), Agg("max", "o_orderkey", "mx")]
    return aggregates.aggregate(some, ["o_custkey"], aggs)


@registered
def ticket_ids(s, d):
    return aggregates.tickets(_p(s, d, "orders").select("o_orderkey", "o_custkey", POS), "o_custkey").select("o_orderkey", "ticket")


@registered
def ticket_keys_distinct(s, d):
    return aggregates.distinct_keys(_t(s, d, "orders"), ["o_custkey"])


@registered
def ticket_len(s, d):
    return aggregates.group_count(_t(s, d, "orders"), ["o_custkey"])


# tables, selections, array kernels


@registered
def concat(s, d):
    a = tables.rename(_t(s, d, "supplier").select("s_suppkey", "s_name"), ["k", "name"])
    return tables.concat(a, tables.rename(_t(s, d, "customer").select("c_custkey", "c_name"), ["k", "name"]))


@registered
def horizontal_stack(s, d):
    a = _p(s, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"), POS)
    b = _p(s, d, "customer").select(F.col("c_name").alias("name"), POS)
    return tables.side_by_side(a, b).select("s_suppkey", "L_name", "R_name")


@registered
def rename_cols(s, d):
    return tables.rename(_t(s, d, "region"), ["a", "b"])


@registered
def slice(s, d):  # noqa: A001
    return tables.slice_rows(_p(s, d, "orders").select(*_OC, POS), 1000, 1500).select(*_OC)


def _selected(s: SparkSession, d: str, p: P.Predicate) -> DataFrame:
    return selection.select_where(_p(s, d, "orders").select("o_custkey", "o_orderstatus", POS), p)


@registered
def slice_selection(s, d):
    return selection.slice_selection(_selected(s, d, P.LessThan("o_custkey", 300)), 1000, 1500)


@registered
def sel_intersect(s, d):
    return selection.intersect(_selected(s, d, P.LessThan("o_custkey", 700)), _selected(s, d, P.Equals("o_orderstatus", "F")))


@registered
def sel_union(s, d):
    return selection.union(_selected(s, d, P.LessThan("o_custkey", 100)), _selected(s, d, P.Equals("o_orderstatus", "P")))


@registered
def sel_invert(s, d):
    return selection.invert(_p(s, d, "orders").select(POS), _selected(s, d, P.LessThan("o_custkey", 700)))


@registered
def take(s, d):
    j = F.col("o_orderkey")
    indices = _where(_t(s, d, "orders"), P.LessThan("o_orderkey", 500)).select(j.alias("j"), (j * 7919 % 1500).alias("i"))
    return tables.take(_p(s, d, "customer").select("c_name", POS), indices, "i").select("j", "c_name")


@registered
def interleave(s, d):
    j = F.col("o_orderkey")
    indices = _where(_t(s, d, "orders"), P.LessThan("o_orderkey", 400)).select(j.alias("j"), (j % 2).alias("a"), (j % 100).alias("i"))
    a = _p(s, d, "supplier").select(F.col("s_name").alias("name"), POS)
    b = _p(s, d, "customer").select(F.col("c_name").alias("name"), POS)
    return tables.interleave([a, b], indices, "a", "i").select("j", "name")


@registered
def nullif_mask(s, d):
    return _t(s, d, "part").select("p_partkey", scalar.null_if(F.col("p_size"), F.col("p_size") > 25).alias("v"))


@registered
def zip_if_else(s, d):
    return _t(s, d, "part").select("p_partkey", scalar.if_else(F.col("p_size") > 25, F.col("p_name"), F.col("p_type")).alias("v"))


@registered
def shift_right(s, d):
    return tables.shift(_p(s, d, "orders").select(*_OC, POS), "o_custkey", 2, "v").select("o_orderkey", "v")


@registered
def shift_left(s, d):
    return tables.shift(_p(s, d, "orders").select(*_OC, POS), "o_custkey", -1, "v").select("o_orderkey", "v")


@registered
def compute_runs(s, d):
    return tables.runs_ended(_p(s, d, "orders").select("o_custkey", POS), F.col("o_custkey") < 700)


@registered
def run_length_encode(s, d):
    return tables.run_lengths(_p(s, d, "orders").select("o_orderstatus", POS), "o_orderstatus")


@registered
def row_chunk_stats(s, d):
    return tables.chunk_stats(_p(s, d, "orders").select("o_custkey", POS), "o_custkey", 1000)


@registered
def array_equal(s, d):
    return tables.differing_rows(_t(s, d, "lineitem"), "l_suppkey", "l_linenumber")


# hash, statistics of the adaptive layer


@registered
def mix_hash(s, d):
    return _t(s, d, "orders").select("o_custkey", scalar.mix_hash(F.col("o_custkey")).alias("h"))


@registered
def filter_selectivity_features(s, d):
    df = strategies.chunk_selectivity(_p(s, d, "orders").select("o_custkey", POS), POS, F.col("o_custkey") < 700, 4096)
    return df.withColumn("selectivity", F.round("selectivity", 9))


@registered
def needle_feature(s, d):
    df = strategies.needle_feature(_p(s, d, "documents").select("text", POS), POS, F.col("text"), "the", 256)
    return df.withColumn("needle_feature", F.round("needle_feature", 9))


@registered
def inversions_unique(s, d):
    sample = strategies.subsample(_p(s, d, "orders").select("o_custkey", POS), POS, 100)
    return strategies.order_features(sample, POS, "o_custkey")


def _costs() -> list:
    return [F.col("l_partkey"), F.col("l_suppkey") * 20, F.floor(F.col("l_orderkey") / 7)]


@registered
def regret_best_single(s, d):
    df = regret_tree.total_regrets(_t(s, d, "lineitem"), _costs())
    return df.select(*[F.col(c).cast("long").alias(c) for c in df.columns])


@registered
def rbf_weighted_means(s, d):
    df = policies.weighted_means(_t(s, d, "lineitem"), [F.col("l_discount")], [0.05], 0.1, [F.col("l_partkey"), F.col("l_suppkey")])
    return df.select(F.round("mean0", 6).alias("mean0"), F.round("mean1", 6).alias("mean1"), F.round("neff", 4).alias("neff"))


def _arms(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_partkey").alias("mean"))


@registered
def ucb_lcb(s, d):
    return policies.lower_bounds(_arms(s, d)).withColumn("lcb", F.round("lcb", 6))


@registered
def ucb_choice(s, d):
    arms = _arms(s, d).orderBy("arm").collect()
    p = policies.LowerBound(len(arms))
    for i, r in enumerate(arms):
        p.n[i], p.total[i] = r["n"], r["n"] * r["mean"]
    return s.createDataFrame([(int(arms[p.choose(())]["arm"]),)], "arm int")


def _measured(s: SparkSession, d: str) -> list:
    """Size, and two costs, of the first parts."""
    df = _where(_t(s, d, "part"), P.LessThan("p_partkey", 150)).select("p_partkey", F.col("p_size") / 50, F.col("p_size") * 1.0, 60.0 - F.col("p_size"))
    return [tuple(r)[1:] for r in df.orderBy("p_partkey").collect()]


@registered
def kernel_policy_choices(s, d):
    policy = policies.KernelPolicy(2, alpha=0.5, bandwidth=0.1, n_min=1)
    for x, *costs in _measured(s, d):
        policy.learn_all((x,), costs)
    return s.createDataFrame([(i, policy.choose((i / 10,))) for i in range(11)], "tenth int, choice int")


def _tree(s: SparkSession, d: str) -> regret_tree.Tree:
    """Which of two costs is less changes between the sizes 30 and 31."""
    rows = [(x, a, b) for x, a, b in _measured(s, d) if a != b]
    return regret_tree.fit(np.array([r[:1] for r in rows]), np.array([r[1:] for r in rows]), 3, midpoint=False)


@registered
def regret_tree_choices(s, d):
    choice = regret_tree.to_column(_tree(s, d), [F.col("p_size") / 50])
    return _t(s, d, "part").select("p_partkey", choice.cast("int").alias("choice"))


@registered
def simple_policy_choices(s, d):
    rule, single = policies.Heuristic(DEFAULT_RULES["plan"]), policies.Single(0, 2)
    replay = policies.Replay.parse("0 1\n1 0\n0 0\n0 1\n", "filter")
    return s.createDataFrame([(i, rule.choose((0.5, 0.5)), single.choose(()), replay.choose(())) for i in range(3)], "i int, rule int, single int, replay int")


# pipeline operations, sources and runs that have no query above

_dsl("pipeline_not_null", "orders", Q.NotNull("o_custkey"), Q.LessThan("o_custkey", 50), columns=_OC)
_dsl("pipeline_is_null", "orders", Q.IsNull("o_custkey"), columns=_OC)


@registered
def filter_all(s, d):
    return _where(_t(s, d, "region"), P.All()).select("r_regionkey")


@registered
def filter_hints(s, d):
    p = P.Hint("bitmap", P.LessThan("l_suppkey", 20)) & P.Hint("vector", P.GreaterThan("l_linenumber", 5))
    return _where(_t(s, d, "lineitem"), p).select(*_LL)


@registered
def filter_wide_literal(s, d):
    p = P.LessThan("l_linenumber", 5_000_000_000) & P.GreaterThan("l_linenumber", 5.5)
    return _where(_t(s, d, "lineitem"), p).select(*_LL)


@registered
def predicate_depth(s, d):
    p = P.Hint("vector", P.Not(P.LessThan("a", 1) & (P.IsNull("b") | P.NotNull("c"))))
    return s.createDataFrame([(p.max_depth(),)], "depth int")


@registered
def join_default_keys(s, d):
    probe = _t(s, d, "orders").select("o_custkey", "o_orderkey")
    return joins.hash_join(_t(s, d, "customer").select("c_custkey", "c_name"), probe, [0])


@registered
def agg_user_defined(s, d):
    spread = UserAgg(
        "spread",
        ("l_partkey",),
        {"n": lambda x: F.count(x), "s": lambda x: F.sum(x.cast("double")), "q": lambda x: F.sum(x.cast("double") * x)},
        lambda st: F.round(st["q"] / st["n"] - st["s"] / st["n"] * st["s"] / st["n"], 3),
    )
    return aggregates.aggregate(_t(s, d, "lineitem"), ["l_linenumber"], [spread, Agg("count", None, "cnt")])


@registered
def run_decode(s, d):
    runs = tables.run_lengths(_p(s, d, "orders").select("o_orderstatus", POS), "o_orderstatus")
    return tables.run_decode(runs).select(F.col(POS).alias("at"), "v")


@registered
def sel_check(s, d):
    chosen = _selected(s, d, P.LessThan("o_custkey", 700))
    return s.createDataFrame([(i, selection.contains(chosen, i)) for i in (0, 1, 2, 3, 10_000_000)], "i long, chosen boolean")


@registered
def sel_all_none(s, d):
    every, some = _p(s, d, "orders").select(POS), _selected(s, d, P.LessThan("o_custkey", 0))
    whole = _selected(s, d, P.GreaterOrEqual("o_custkey", 0))
    return s.createDataFrame([(selection.is_all(every, whole), selection.is_none(some), selection.is_all(every, some))], "whole boolean, none boolean, some boolean")


def _some_orders(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = _p(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", POS)
    return df, selection.select_where(df, P.LessThan("o_custkey", 300))


@registered
def sel_filter_values(s, d):
    return selection.filter_selected(*_some_orders(s, d), lambda c: c % 7 == 3, "o_custkey")


@registered
def sel_filter_strings(s, d):
    return selection.filter_selected(*_some_orders(s, d), lambda c: c.contains("URGENT"), "o_orderpriority")


@registered
def sel_map_values(s, d):
    return selection.map_selected(*_some_orders(s, d), lambda c: c * 2 + 1, "o_custkey", "v").select(F.col(POS).alias("at"), "v")


@registered
def sel_gather(s, d):
    return selection.apply_selection(*_some_orders(s, d)).select("o_orderkey", "o_custkey")


@registered
def sel_bitmap_round_trip(s, d):
    return selection.positions(selection.bitmap(_some_orders(s, d)[1]))


@registered
def sel_intersect_strategies(s, d):
    a, b = _selected(s, d, P.LessThan("o_custkey", 700)), _selected(s, d, P.Equals("o_orderstatus", "F"))
    done = None
    for k in range(len(STRATEGIES)):
        one = selection.intersect(a, b, Intersector(regret_tree.Leaf(k))).withColumn("strategy", F.lit(k))
        done = one if done is None else done.union(one)
    return done


@registered
def intersection_features(s, d):
    a, b = _selected(s, d, P.LessThan("o_custkey", 300)), _selected(s, d, P.Equals("o_orderstatus", "F"))
    both = strategies.intersection_features(a, b).crossJoin(strategies.sample_hits(a, b))
    return both.select(F.round("len_ratio", 9).alias("len_ratio"), F.round("overlap", 9).alias("overlap"), "hits")


@registered
def value_sizes(s, d):
    made = F.struct("p_name", "p_size", F.array("p_brand", "p_type").alias("both"), F.create_map(F.lit("k"), "p_partkey").alias("m")).alias("x")
    df = _t(s, d, "part").select("p_partkey", made)
    return df.select("p_partkey", scalar.value_bytes(F.col("x"), df.schema["x"].dataType).cast("long").alias("size"))


@registered
def mix_hash_double(s, d):
    return _t(s, d, "part").select("p_partkey", scalar.mix_hash(F.col("p_retailprice"), "double").alias("h"))


@registered
def random_strings(s, d):
    text = scalar.random_text(F.col("c_custkey"), ["oak", "elm", "ash", "fir", "yew"], "PATTERN", 0.6)
    return _t(s, d, "customer").select("c_custkey", text.alias("s"))


@registered
def filter_features(s, d):
    df = _t(s, d, "orders").select("o_custkey", "o_orderpriority")
    size = scalar.value_bytes(F.col("o_custkey"), "bigint") + scalar.value_bytes(F.col("o_orderpriority"), "string")
    return strategies.filter_features(df, F.col("o_custkey") < 700, size).withColumn("selectivity", F.round("selectivity", 9))


@registered
def chunked_counts(s, d):
    df = _p(s, d, "orders").select("o_custkey", POS)
    return strategies.chunked(df, POS, df.count(), 500).groupBy("chunk").agg(F.count(F.lit(1)).alias("num_rows"))


def _by_strategy(strategy: int, *ops: Q.Op):
    def run(s: SparkSession, d: str) -> DataFrame:
        made = {op: policies.Single(strategy, 2) for op in ("filter", "plan", "sort")}
        return Q.compile_query(s, d, Q.Query("q", ops), manager=StrategyManager(made), sample=0.1)

    return run


for _k in range(2):
    QUERIES[f"strategy_filter_{_k}"] = _by_strategy(_k, Q.LoadParquet("orders.parquet"), Q.LessThan("o_custkey", 100), Q.SelectColumns(_OC))
    QUERIES[f"strategy_needle_{_k}"] = _by_strategy(
        _k, Q.LoadParquet("part.parquet"), Q.SmartStringOnTop("p_name", "ed", "p_size", 10), Q.SelectColumns(("p_partkey", "p_name"))
    )
    QUERIES[f"strategy_sort_{_k}"] = _by_strategy(_k, Q.LoadParquet("orders.parquet"), Q.LessThan("o_custkey", 50), Q.SortBy("o_custkey"), Q.SelectColumns(_OC))


@registered
def json_round_trip(s, d):
    query = Q.Query("q", (Q.LoadParquet("orders.parquet"), Q.In("o_custkey", (1, 2, 3)), Q.Or(), Q.Between("o_custkey", 10, 13), Q.SelectColumns(_OC)))
    text = io.StringIO()
    Q.write_query(text, query)
    [again] = Q.read_queries(["# a comment", "", *text.getvalue().splitlines()])
    if again != query:
        raise ValueError("a query changed on its way through JSON")
    return Q.compile_query(s, d, again)


@registered
def from_arrow(s, d):
    return sources.from_arrow(s, _t(s, d, "nation").toArrow())


@registered
def stream_rows(s, d):
    df = _t(s, d, "nation")
    return s.createDataFrame(list(sources.stream_rows(df)), df.schema)


@registered
def spooled(s, d):
    return sources.spool(_t(s, d, "region"))


@registered
def cached_load(s, d):
    cache = sources.TableCache(s, 1 << 26)
    query = Q.Query("q", (Q.LoadParquet("supplier.parquet"), Q.LessThan("s_nationkey", 9), Q.SortBy("s_nationkey"), Q.FilterTop(20), Q.SelectColumns(("s_suppkey",))))
    Q.compile_query(s, d, query, loader=cache.load)
    return Q.compile_query(s, d, query, loader=cache.load)


@registered
def footer_statistics(s, d):
    groups = sources.footer_frame(s, f"{d}/orders.parquet", "o_custkey")
    ends = [F.min(F.col("min").cast("long")).alias("mn"), F.max(F.col("max").cast("long")).alias("mx")]
    return groups.agg(F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"), *ends)


@registered
def literal_columns(s, d):
    return tables.literal_table(s, [[1, 5, 9], [4, -2, 0]], ["a", "b"])


@registered
def materialized_table(s, d):
    return materialized(_t(s, d, "nation").select("n_nationkey", "n_name"))


@registered
def table_columns(s, d):
    df = _t(s, d, "nation")
    return s.createDataFrame([(i, P.resolve(df, i), kind) for i, (_, kind) in enumerate(df.dtypes)], "place int, name string, kind string")


@registered
def runner_result(s, d):
    query = Q.Query("q", (Q.LoadParquet("orders.parquet"), Q.LessThan("o_custkey", 20), Q.SelectColumns(_OC)))
    return run_query(s, d, query, partitions=4)[0]
