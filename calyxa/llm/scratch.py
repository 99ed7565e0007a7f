"""Tables of one operator's run in the folder that the whole cluster shares, to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from calyxa.sources.scratch import remove, remove_at_exit, shared_folder


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Scratch:
    """A folder for one run of one operator; every table in it is written once and read back."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/calyxa-{name}-{uuid.uuid4().hex[:12]}"
        remove_at_exit(spark, self.root)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` and return the table read back (known size, no lineage)."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.root}/{name}")

    def folder(self, name: str) -> str:
        """A folder below the scratch root for files that are not tables."""
        return f"{self.root}/{name}"
