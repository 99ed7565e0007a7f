"""Operations on whole tables: columns, stacking, rows by position, runs, equality.

Positions are the column POS of `load_with_position`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calyxa.operators.ranks import with_rank
from calyxa.plans.predicates import Ref, resolve
from calyxa.sources.parquet import POS
from calyxa.sources.scratch import free_name


def literal_table(spark: SparkSession, columns: Sequence[Sequence[int]], names: Sequence[str] | None = None) -> DataFrame:
    """Columns of 32-bit integers; unnamed ones are $0, $1 and so on."""
    names = [f"${i}" for i in range(len(columns))] if names is None else list(names)
    if len(set(names)) != len(names):
        raise ValueError("column names must be unique")
    schema = ", ".join(f"`{n}` int" for n in names)
    return spark.createDataFrame(list(zip(*columns, strict=True)), schema)


def rename(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if len(set(names)) != len(names):
        raise ValueError("column names must be unique")
    return df.toDF(*names)


def select(df: DataFrame, refs: Sequence[Ref]) -> DataFrame:
    return df.select(*[f"`{resolve(df, r)}`" for r in refs])


def concat(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all tables, columns by name in the order of the first."""
    for other in others:
        first = first.unionByName(other.select(*[f"`{c}`" for c in first.columns]))
    return first


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of equal position next to each other; names that clash become L_name and R_name."""
    a, b = ([c for c in x.columns if c != POS] for x in (left, right))
    clash = set(a) & set(b)
    named = [
        x.select(POS, *[F.col(f"`{c}`").alias(f"{mark}_{c}" if c in clash else c) for c in columns])
        for x, columns, mark in ((left, a, "L"), (right, b, "R"))
    ]
    return named[0].join(named[1], POS)


def slice_rows(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows at start to end - 1, positions counted from start."""
    return df.where((F.col(POS) >= start) & (F.col(POS) < end)).withColumn(POS, F.col(POS) - start)


def take(df: DataFrame, indices: DataFrame, index: str) -> DataFrame:
    """For each row of indices the row at its index; nulls and places beyond the end give nulls."""
    at = free_name("__at", df, indices)
    rows = df.withColumnRenamed(POS, at)
    return indices.join(rows, F.col(f"`{index}`") == F.col(at), "left").drop(at)


def interleave(tables: Sequence[DataFrame], indices: DataFrame, table: str, index: str) -> DataFrame:
    """For each row of indices the row at `index` of the table numbered `table`."""
    at, of = (free_name(name, indices, *tables) for name in ("__at", "__table"))
    tagged = None
    for i, df in enumerate(tables):
        one = df.withColumnRenamed(POS, at).withColumn(of, F.lit(i))
        tagged = one if tagged is None else tagged.unionByName(one)
    on = [F.col(f"`{table}`") == F.col(of), F.col(f"`{index}`") == F.col(at)]
    return indices.join(tagged, on).drop(of, at)


def shift(df: DataFrame, col: Ref, n: int, name: str) -> DataFrame:
    """df with `name`: the value n rows before (n > 0) or behind (n < 0); null where there is none."""
    moved = df.select((F.col(POS) + n).alias(POS), F.col(f"`{resolve(df, col)}`").alias(name))
    return df.join(moved, POS, "left")


def runs_ended(df: DataFrame, flag: Column) -> DataFrame:
    """runs: how often the flag is true and the next row's is not; a run at the end is not counted."""
    flags = df.select(POS, F.coalesce(flag, F.lit(False)).alias("f"))
    before = flags.select((F.col(POS) + 1).alias(POS), F.col("f").alias("p"))
    both = flags.join(before, POS, "left")
    return both.agg(F.coalesce(F.sum(F.when(F.col("p") & ~F.col("f"), 1).otherwise(0)), F.lit(0)).cast("long").alias("runs"))


def run_lengths(df: DataFrame, col: Ref) -> DataFrame:
    """run_id (from 1), v, run_end (position behind the run) of each run of equal values."""
    values = df.select(POS, F.col(f"`{resolve(df, col)}`").alias("v"))
    before = values.select((F.col(POS) + 1).alias(POS), F.col("v").alias("p"), F.lit(True).alias("there"))
    starts = values.join(before, POS, "left").where(F.col("there").isNull() | ~F.col("v").eqNullSafe(F.col("p")))
    numbered = with_rank(starts.select(POS, "v"), [POS], "r")
    behind = numbered.select((F.col("r") - 1).alias("r"), F.col(POS).alias("run_end"))
    size = values.agg((F.max(POS) + 1).alias("size"))
    ended = numbered.join(behind, "r", "left").join(F.broadcast(size))
    return ended.select((F.col("r") + 1).alias("run_id"), "v", F.coalesce("run_end", "size").alias("run_end"))


def run_decode(runs: DataFrame) -> DataFrame:
    """Rows of runs(run_id, v, run_end) again, with POS."""
    before = runs.select((F.col("run_id") + 1).alias("run_id"), F.col("run_end").alias("s"))
    spans = runs.join(before, "run_id", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    return spans.select(F.explode(F.sequence(F.col("s"), F.col("run_end") - 1)).alias(POS), "v")


def chunk_stats(df: DataFrame, col: Ref, size: int) -> DataFrame:
    """rg, row_count, null_count, mn, mx of every `size` rows by position."""
    c = F.col(f"`{resolve(df, col)}`")
    return df.groupBy(F.floor(F.col(POS) / size).cast("long").alias("rg")).agg(
        F.count(F.lit(1)).alias("row_count"),
        (F.count(F.lit(1)) - F.count(c)).alias("null_count"),
        F.min(c).alias("mn"),
        F.max(c).alias("mx"),
    )


def differing_rows(df: DataFrame, a: Ref, b: Ref) -> DataFrame:
    """n_diff: rows where the columns differ; nulls equal each other."""
    differ = ~F.col(f"`{resolve(df, a)}`").eqNullSafe(F.col(f"`{resolve(df, b)}`"))
    return df.where(differ).agg(F.count(F.lit(1)).alias("n_diff"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal schemas and, with repetitions, equal rows in any order."""
    if a.dtypes != b.dtypes:
        return False
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def argsort(df: DataFrame, col: Ref, descending: bool = False, name: str = "rank_pos") -> DataFrame:
    """df with each row's place in the stable order of a column."""
    c = F.col(f"`{resolve(df, col)}`")
    return with_rank(df, [c.desc() if descending else c.asc(), F.col(POS).asc()], name)
