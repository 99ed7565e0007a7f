"""Sets of row positions: the algebra of selections.

A selection is a DataFrame with one column, idx, of distinct positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calyxa.plans.predicates import Predicate
from calyxa.sources.parquet import POS

IDX = "idx"


def select_where(df: DataFrame, p: Predicate | Column) -> DataFrame:
    """Positions of the rows that a predicate selects."""
    condition = p.column(df) if isinstance(p, Predicate) else p
    return df.where(condition).select(F.col(POS).alias(IDX))


def intersect(a: DataFrame, b: DataFrame, chooser=None) -> DataFrame:
    """Positions in both; a chooser (an Intersector) says in which way."""
    return a.join(b, IDX, "left_semi") if chooser is None else chooser.intersect(a, b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def invert(all_rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Positions of all_rows(POS) that are not selected."""
    return all_rows.select(F.col(POS).alias(IDX)).join(selected, IDX, "left_anti")


def slice_selection(selected: DataFrame, start: int, end: int) -> DataFrame:
    """Positions in start to end - 1, counted from start."""
    return selected.where((F.col(IDX) >= start) & (F.col(IDX) < end)).select((F.col(IDX) - start).alias(IDX))


def contains(selected: DataFrame, i: int) -> bool:
    return not selected.where(F.col(IDX) == i).isEmpty()


def is_none(selected: DataFrame) -> bool:
    return selected.isEmpty()


def is_all(all_rows: DataFrame, selected: DataFrame) -> bool:
    return invert(all_rows, selected).isEmpty()


def apply_selection(df: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected rows."""
    return df.join(selected.withColumnRenamed(IDX, POS), POS, "left_semi")


def filter_selected(df: DataFrame, selected: DataFrame, test: Callable[[Column], Column], col: str) -> DataFrame:
    """Selected positions whose value passes the test; the test gets and returns a Column and nulls fail."""
    return apply_selection(df, selected).where(test(F.col(f"`{col}`"))).select(F.col(POS).alias(IDX))


def map_selected(df: DataFrame, selected: DataFrame, f: Callable[[Column], Column], col: str, name: str) -> DataFrame:
    """f of the value of each selected row, with its position."""
    return apply_selection(df, selected).select(POS, f(F.col(f"`{col}`")).alias(name))


def bitmap(selected: DataFrame) -> DataFrame:
    """bucket, bits: the selection as bitmaps of 32,768 positions each."""
    return selected.groupBy(F.bitmap_bucket_number(F.col(IDX) + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col(IDX) + 1)).alias("bits")
    )


def positions(bitmaps: DataFrame) -> DataFrame:
    """The selection that `bitmap` was made of."""
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("i") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    each = bitmaps.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.length("bits") * 8 - 1)).alias("i"))
    hit = byte.bitwiseAND(F.pow(F.lit(2), F.col("i") % 8).cast("int")) != 0
    return each.where(hit).select(((F.col("bucket") - 1) * 32_768 + F.col("i")).cast("long").alias(IDX))
