"""Tables written once to the folder that the cluster shares, where a plan must not be computed twice."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def free_name(name: str, *tables: DataFrame) -> str:
    """`name`, with underscores in front until no column of the tables has it (in any case)."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; where that is unset, a folder of our own.

    On a cluster our own is below the warehouse, which is shared; in local mode it is a temporary one.
    """
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.calyxa"
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="calyxa-"))
    return f"file://{_LOCAL[0]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    def end() -> None:
        try:
            remove(spark, path)
        except Exception:  # the JVM may already be gone; nothing depends on this clean-up
            pass

    atexit.register(end)


def materialized(df: DataFrame) -> DataFrame:
    """`df` written as Parquet and read back; its plan is gone and its size known."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/calyxa-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
