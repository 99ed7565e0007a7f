"""Dense global numbers for ordered rows, without a window over all of them.

Rows are range-partitioned and sorted once, written, and numbered by the number of rows in earlier
partitions plus their place in their own; only one count per partition reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calyxa.sources.scratch import free_name, materialized

_BITS = 33


def with_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """df with `name`: 0-based numbers in the given order, which must be total for a fixed result."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    row, own, before = (free_name(n, df) for n in ("__id", "__part", "__before"))
    placed = materialized(ordered.withColumn(row, F.monotonically_increasing_id()))
    part = F.shiftright(row, _BITS)
    starts, total = [], 0
    for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((r["part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(starts, f"{own} long, {before} long")
    place = F.col(row).bitwiseAND(F.lit((1 << _BITS) - 1))
    return (
        placed.withColumn(own, part)
        .join(F.broadcast(offsets), own)  # a row for each partition
        .withColumn(name, F.col(before) + place)
        .drop(own, before, row)
    )
