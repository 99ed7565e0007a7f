"""Grouped aggregation, dense group numbers, distinct keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calyxa.operators.ranks import with_rank
from calyxa.plans.predicates import Ref, resolve
from calyxa.sources.parquet import POS
from calyxa.sources.scratch import free_name


@dataclass(frozen=True)
class Agg:
    """One aggregate: count takes no input; min, max, sum and mean skip nulls."""

    kind: str
    col: Ref | None
    name: str

    def column(self, df: DataFrame) -> Column:
        if self.kind == "count":
            return F.count(F.lit(1)).alias(self.name)
        make = {"min": F.min, "max": F.max, "sum": F.sum, "mean": F.avg}.get(self.kind)
        if make is None:
            raise ValueError(f"unknown aggregate {self.kind!r}")
        return make(F.col(f"`{resolve(df, self.col)}`")).alias(self.name)


@dataclass(frozen=True)
class UserAgg:
    """An aggregate of one's own: a state of built-in aggregates, and what it comes to.

    state: for each part of it, a function from the input columns to an aggregate, which Spark
    sums up before the shuffle and merges behind it; result: a function from the parts, by name.
    """

    name: str
    cols: tuple[Ref, ...]
    state: dict[str, Callable[..., Column]]
    result: Callable[[dict[str, Column]], Column]

    def column(self, df: DataFrame) -> Column:
        inputs = [F.col(f"`{resolve(df, c)}`") for c in self.cols]
        return self.result({k: f(*inputs) for k, f in self.state.items()}).alias(self.name)


def aggregate(df: DataFrame, keys: Sequence[Ref], aggs: Sequence[Agg | UserAgg], first_seen: bool = False) -> DataFrame:
    """Keys, then aggregates; partial aggregation runs before the only shuffle.

    first_seen orders groups by their first position (df must have POS then).
    """
    names = [resolve(df, k) for k in keys]
    columns = [a.column(df) for a in aggs]
    if not first_seen:
        return df.groupBy(*[f"`{k}`" for k in names]).agg(*columns)
    seen = "__first"
    while seen in {*names, *(a.name for a in aggs)}:
        seen = f"_{seen}"
    out = df.groupBy(*[f"`{k}`" for k in names]).agg(*columns, F.min(POS).alias(seen))
    return out.orderBy(seen).drop(seen)


def distinct_keys(df: DataFrame, keys: Sequence[Ref]) -> DataFrame:
    return df.select(*[f"`{resolve(df, k)}`" for k in keys]).distinct()


def group_count(df: DataFrame, keys: Sequence[Ref], name: str = "n_groups") -> DataFrame:
    """Number of groups, a group of nulls included; counted from partial sums."""
    return distinct_keys(df, keys).agg(F.count(F.lit(1)).alias(name))


def tickets(df: DataFrame, key: Ref, name: str = "ticket") -> DataFrame:
    """df with dense group numbers in order of first position; df must have POS."""
    k = resolve(df, key)
    of = free_name("__k", df)
    first = df.groupBy(F.col(f"`{k}`").alias(of)).agg(F.min(POS).alias("__first"))
    numbered = with_rank(first, ["__first"], name).select(of, name)
    return df.join(numbered, F.col(f"`{k}`").eqNullSafe(F.col(of))).drop(of)
