"""Parquet tables: reading with row positions, footers, a cache of loaded tables.

Spark does column pruning and pushes predicates to the scan, so loading is lazy and no
column is read that the query does not use.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The hidden column with the 0-based position of a row in its table.
POS = "__pos"
#: Signs of which patterns of paths are made.
_GLOB = re.compile(r"[\[\]{}*?\\]")


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_with_position(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """The table with POS; files follow each other in order of their paths.

    With `first`, rows at that position and behind it may be missing: files that hold only such are not read.
    """
    df = spark.read.parquet(path)
    files = sorted(df.inputFiles())
    if len(files) <= 1:
        return df.select("*", F.col("_metadata.row_index").alias(POS))
    # one row per file: file_path and the number of rows before it
    counts = df.select(F.col("_metadata.file_path").alias("file")).groupBy("file").count().orderBy("file").collect()
    before, starts = 0, []
    for r in counts:
        if first is None or before < first:
            starts.append((r["file"], before))
        before += r["count"]
    used = df
    if len(starts) < len(counts):
        wanted = {_plain(f) for f, _ in starts}
        reader = spark.read.schema(df.schema)
        # values of partition columns are told by the folders below the table's own
        reader = reader if _GLOB.search(path) else reader.option("basePath", path)
        used = reader.parquet(*[_GLOB.sub(r"\\\g<0>", unquote(f)) for f in files if _plain(f) in wanted])
    offsets = spark.createDataFrame(starts, "`calyxa file` string, `calyxa start` long")
    # a row for each file: broadcast only while Spark's own limit says so
    placed = used.select("*", F.col("_metadata.file_path").alias("calyxa path"), F.col("_metadata.row_index").alias("calyxa row"))
    joined = placed.join(offsets, F.col("calyxa path") == F.col("calyxa file"))
    return joined.withColumn(POS, F.col("calyxa start") + F.col("calyxa row")).select(*[f"`{c}`" for c in df.columns], POS)


def _plain(file: str) -> str:
    """A file's URI, with one way to write an empty authority."""
    return file.replace(":///", ":/")


def from_arrow(spark: SparkSession, table: pa.Table | pa.RecordBatch) -> DataFrame:
    """A DataFrame of an Arrow table; column names must be unique."""
    if isinstance(table, pa.RecordBatch):
        table = pa.Table.from_batches([table])
    if len(set(table.column_names)) != len(table.column_names):
        raise ValueError("column names must be unique")
    return spark.createDataFrame(table)


def size_estimate(df: DataFrame) -> int:
    """Bytes that the optimizer expects the DataFrame to have."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class TableCache:
    """Loaded tables by path, persisted within a budget of bytes; the least recently used go first.

    A table larger than the whole budget is never kept; a budget of zero or less keeps nothing.
    """

    def __init__(self, spark: SparkSession, budget: int):
        self.spark, self.budget = spark, budget
        self.kept: OrderedDict[tuple[str, bool], tuple[DataFrame, int]] = OrderedDict()

    def load(self, path: str, positions: bool = False, first: int | None = None) -> DataFrame:
        """The table; with positions always whole, so that `first` needs no entry of its own."""
        key = (path, positions)
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key][0]
        df = load_with_position(self.spark, path) if positions else load(self.spark, path)
        size = size_estimate(df)
        if size > self.budget:
            return df
        while self.kept and self.used + size > self.budget:
            _, (old, _) = self.kept.popitem(last=False)
            old.unpersist()
        self.kept[key] = (df.persist(StorageLevel.MEMORY_AND_DISK), size)
        return self.kept[key][0]

    @property
    def used(self) -> int:
        return sum(size for _, size in self.kept.values())

    def clear(self) -> None:
        for df, _ in self.kept.values():
            df.unpersist()
        self.kept.clear()


def stream_rows(df: DataFrame) -> Iterator:
    """Rows one partition after the other, the next one fetched ahead; bounded memory on the driver."""
    return df.toLocalIterator(prefetchPartitions=True)


def spool(df: DataFrame) -> DataFrame:
    """Keep a result for several uses."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


class Footer:
    """What the footers of a Parquet file, or of all files in a folder, say, without reading data.

    Paths are any that Spark's file systems know.  Row groups are in order of their files' paths.
    """

    def __init__(self, spark: SparkSession, path: str):
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.schema = spark.read.parquet(path).schema
        root = jvm.org.apache.hadoop.fs.Path(path)
        system = root.getFileSystem(conf)
        files = [s.getPath() for s in system.listStatus(root)] if system.getFileStatus(root).isDirectory() else [root]
        self.groups = []
        for file in sorted((f for f in files if not f.getName().startswith(("_", "."))), key=str):
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(file, conf))
            try:
                self.groups += list(reader.getFooter().getBlocks())
            finally:
                reader.close()

    def column(self, at: str | int) -> str:
        return self.schema.names[at] if isinstance(at, int) else at

    def _statistics(self, at: str | int):
        name = self.column(at)
        for g in self.groups:
            yield next(c.getStatistics() for c in g.getColumns() if c.getPath().toDotString() == name)

    def row_counts(self) -> list[int]:
        return [g.getRowCount() for g in self.groups]

    def null_counts(self, at: str | int) -> list[int | None]:
        return [s.getNumNulls() if s is not None and s.isNumNullsSet() else None for s in self._statistics(at)]

    def _ends(self, at: str | int, least: bool) -> list:
        """Numbers and booleans as they are stored, others as text."""
        out = []
        for s in self._statistics(at):
            if s is None or not s.hasNonNullValue():
                out.append(None)
                continue
            value = s.genericGetMin() if least else s.genericGetMax()
            text = s.minAsString() if least else s.maxAsString()
            out.append(value if isinstance(value, bool | int | float) else text)
        return out

    def mins(self, at: str | int) -> list:
        return self._ends(at, True)

    def maxs(self, at: str | int) -> list:
        return self._ends(at, False)


def footer_frame(spark: SparkSession, path: str, column: str | int) -> DataFrame:
    """One row per row group: group, row_count, null_count, min, max (as text)."""
    f = Footer(spark, path)
    text = [[None if x is None else str(x) for x in xs] for xs in (f.mins(column), f.maxs(column))]
    rows = list(zip(range(len(f.row_counts())), f.row_counts(), f.null_counts(column), *text, strict=True))
    return spark.createDataFrame(rows, "group long, row_count long, null_count long, min string, max string")
