"""Result-equivalent ways to filter, to test a needle and a bound, and to sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calyxa.adaptive.manager import Decision
from calyxa.operators.ranks import with_rank


def filter_strategies(df: DataFrame, condition: Column, selectivity: float) -> Decision:
    """0: a filter in the plan; 1: the condition as a column, applied to Arrow batches."""

    def batches() -> DataFrame:
        def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                mask = b.column(b.num_columns - 1)
                yield b.drop_columns([b.schema.names[-1]]).filter(pc.fill_null(mask, False))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.withColumn("__keep", condition).mapInArrow(keep, schema)

    return Decision("filter", (selectivity,), [lambda: df.where(condition), batches])


def needle_strategies(df: DataFrame, number: Column, needle: Column, selectivity: float, needle_share: float) -> Decision:
    """0: the needle is tested first; 1: the number is."""
    return Decision("plan", (selectivity, needle_share), [lambda: df.where(needle & number), lambda: df.where(number & needle)])


def sort_strategies(df: DataFrame, order: list[Column], inversions: float, unique: float) -> Decision:
    """0: a global sort; 1: range partitions, each sorted on its own."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = lambda: df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return Decision("sort", (inversions, unique), [lambda: df.orderBy(*order), ranged])


def sorted_by(df: DataFrame, order: list[Column], key: str, pos: str, manager, most: int = 10_000) -> DataFrame:
    """The sort by the strategy that the manager chooses, from the order of at most `most` sampled rows."""
    some = df.sample(fraction=manager.samples["sort"], seed=1).select(pos, key).where(F.col(key).isNotNull()).limit(most).toArrow().sort_by(pos)
    values = np.array(some[key])
    n = len(values)
    inversions = 2 * count_inversions(values) / (n * (n - 1)) if n > 1 else 0.0
    return manager.run(sort_strategies(df, order, inversions, len(np.unique(values)) / max(1, n)))


def chunk_count(rows: int, size: int) -> int:
    """One chunk for fewer than two full ones, else as many as hold `size` rows each."""
    return 1 if rows < 2 * size else -(-rows // size)


def chunked(df: DataFrame, pos: str, rows: int, size: int) -> DataFrame:
    """df with `chunk`, numbers of runs of `size` rows by position, one partition or more of its own each."""
    numbered = df.withColumn("chunk", F.lit(0).cast("long") if chunk_count(rows, size) == 1 else F.floor(F.col(pos) / size).cast("long"))
    return numbered.repartitionByRange(chunk_count(rows, size), "chunk")


def filter_features(df: DataFrame, condition: Column, size: Column) -> DataFrame:
    """num_rows, selectivity, bytes of a filter's input; size: the bytes of a row."""
    hit = F.when(condition, 1.0).otherwise(0.0)
    return df.agg(F.count(F.lit(1)).alias("num_rows"), F.avg(hit).alias("selectivity"), F.sum(size).cast("long").alias("bytes"))


def sample_hits(a: DataFrame, b: DataFrame, idx: str = "idx", first: int = 10) -> DataFrame:
    """hits: how many of the first positions of a are in b."""
    return a.orderBy(idx).limit(first).join(b, idx, "left_semi").agg(F.count(F.lit(1)).alias("hits"))


def chunk_selectivity(df: DataFrame, pos: str, condition: Column, size: int) -> DataFrame:
    """chunk, num_rows, selectivity of every `size` rows by position."""
    hit = F.when(condition, 1.0).otherwise(0.0)
    return df.groupBy(F.floor(F.col(pos) / size).cast("long").alias("chunk")).agg(
        F.count(F.lit(1)).alias("num_rows"), F.avg(hit).alias("selectivity")
    )


def needle_feature(df: DataFrame, pos: str, text: Column, needle: str, size: int) -> DataFrame:
    """chunk, needle_feature: 1 / (1 + needle length / mean text length), in bytes."""
    mean = F.avg(F.octet_length(text))
    feature = 1.0 / (1.0 + len(needle.encode()) / mean)
    return df.groupBy(F.floor(F.col(pos) / size).cast("long").alias("chunk")).agg(feature.alias("needle_feature"))


def subsample(df: DataFrame, pos: str, step: int) -> DataFrame:
    """Every step-th row, the second one first."""
    return df.where(F.col(pos) % step == 1 % step)


def count_inversions(values: np.ndarray) -> int:
    """Pairs whose earlier value is the larger, bit by bit of the values' ranks."""
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(values, kind="stable")] = np.arange(len(values))
    total = 0
    for bit in range(max(1, len(values)).bit_length()):
        group = rank >> (bit + 1)
        order = np.argsort(group, kind="stable")
        one, start = (rank[order] >> bit) & 1, np.flatnonzero(np.diff(group[order], prepend=-1))
        before = np.cumsum(one) - one
        before -= np.repeat(before[start], np.diff(np.append(start, len(order))))
        total += int(before[one == 0].sum())
    return total


#: Rows of a block of positions or values at least, and blocks at most (their table of counts has the square).
BLOCK_ROWS, BLOCKS = 4096, 1024


def order_features(sample: DataFrame, pos: str, col: str) -> DataFrame:
    """inversions, uniq of a sample: pairs out of order, and distinct values; nulls are left out.

    Places p by position and r by value are cut into blocks.  Pairs within a block of p are
    counted there, those of two blocks of p within a block of r there, and all others from
    the number of rows of each (block of p, block of r).
    """
    rows = sample.where(F.col(col).isNotNull()).select(F.col(pos).alias("i"), F.col(col).alias("v"))
    placed = with_rank(with_rank(rows, ["i", "v"], "p"), ["v", "p"], "r")
    size = max(BLOCK_ROWS, -(-placed.count() // BLOCKS))
    placed = placed.select("p", "r", F.floor(F.col("p") / size).alias("pb"), F.floor(F.col("r") / size).alias("rb"))

    def within(group: pa.Table, *order: str) -> pa.Table:
        values = np.array(group.sort_by([(c, "ascending") for c in order])["r"])
        return pa.table({"inversions": pa.array([count_inversions(values)])})

    by_place = placed.groupBy("pb").applyInArrow(lambda g: within(g, "p"), "inversions long")
    by_value = placed.groupBy("rb").applyInArrow(lambda g: within(g, "pb", "r"), "inversions long")
    # at most BLOCKS ** 2 numbers
    counts = placed.groupBy("pb", "rb").agg(F.count(F.lit(1)).alias("n")).toArrow()
    table = np.zeros((BLOCKS + 1, BLOCKS + 1), np.int64)
    table[np.array(counts["pb"], np.int64), np.array(counts["rb"], np.int64)] = np.array(counts["n"], np.int64)
    earlier = np.cumsum(table, axis=0) - table
    larger = np.cumsum(earlier[:, ::-1], axis=1)[:, ::-1] - earlier
    across = int((table * larger).sum())
    found = by_place.union(by_value).agg((F.coalesce(F.sum("inversions"), F.lit(0)) + F.lit(across)).cast("long").alias("inversions"))
    return found.crossJoin(rows.agg(F.countDistinct("v").alias("uniq")))


def intersection_features(a: DataFrame, b: DataFrame, idx: str = "idx") -> DataFrame:
    """len_ratio, overlap of two selections: their sizes' ratio and the share of a within b's range."""
    x = a.agg(F.count(F.lit(1)).alias("na"))
    y = b.agg(F.count(F.lit(1)).alias("nb"), F.min(idx).alias("lo"), F.max(idx).alias("hi"))
    inside = a.join(F.broadcast(y), F.col(idx).between(F.col("lo"), F.col("hi"))).agg(F.count(F.lit(1)).alias("inside"))
    return x.join(F.broadcast(y), F.lit(True)).join(F.broadcast(inside), F.lit(True)).select(
        (F.col("nb") / F.col("na")).alias("len_ratio"), (F.col("inside") / F.col("na")).alias("overlap")
    )
