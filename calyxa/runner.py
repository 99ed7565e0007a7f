"""Runs pipeline queries and reports their times.

python -m calyxa.runner --queries FILE.jsonl [--job-path DIR] [--query N | --run-all]
    [--n-times N] [--n-epochs N] [--shuffle] [--partitions N] [--max-chunk ROWS] [--config FILE.yml]
"""

from __future__ import annotations

import argparse
import json
import random
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from calyxa import config
from calyxa.plans.query import Query, compile_query, read_queries
from calyxa.sources.parquet import TableCache


def run_query(spark: SparkSession, job_path: str, query: Query, loader=None, manager=None, partitions: int | None = None) -> tuple[DataFrame, int]:
    """The result, computed, and the nanoseconds that took."""
    df = compile_query(spark, job_path, query, loader=loader, manager=manager, partitions=partitions)
    start = time.perf_counter_ns()
    df.write.format("noop").mode("overwrite").save()
    return df, time.perf_counter_ns() - start


def run_all(
    spark: SparkSession, job_path: str, queries: Sequence[Query], n_times: int = 1, n_epochs: int = 1, shuffle: bool = False, manager=None,
    loader=None, partitions: int | None = None
) -> dict:
    """{"times": [[{"order_id", "time"}, ...], ...]}: a list for each epoch."""
    order, times = list(range(len(queries))), []
    for _ in range(n_times):
        if shuffle:
            random.shuffle(order)
        for _ in range(n_epochs):
            times.append([{"order_id": i, "time": run_query(spark, job_path, queries[i], loader, manager, partitions)[1]} for i in order])
            if manager is not None:
                manager.end_of_epoch()
    return {"times": times}


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Run pipeline queries over Parquet tables.")
    p.add_argument("--job-path")
    p.add_argument("--queries", required=True)
    p.add_argument("--query", type=int, default=0)
    p.add_argument("--run-all", action="store_true")
    p.add_argument("--n-times", type=int, default=1)
    p.add_argument("--n-epochs", type=int, default=1)
    p.add_argument("--shuffle", action="store_true")
    p.add_argument("--partitions", type=int, help="tasks that rows are dealt to after loading")
    p.add_argument("--max-chunk", type=int, help="rows of an Arrow batch at most")
    p.add_argument("--config")
    a = p.parse_args(argv)
    settings = config.load(a.config) if a.config else config.Config()
    job_path = a.job_path or settings.job_path
    queries = list(read_queries(a.queries))
    spark = SparkSession.builder.appName("calyxa").getOrCreate()
    manager = settings.manager(learning=True) if settings.policy != "heuristic" else None
    loader = TableCache(spark, settings.cache_bytes).load if settings.cache_bytes > 0 else None
    if a.max_chunk:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", a.max_chunk)
    if a.run_all:
        report = run_all(spark, job_path, queries, a.n_times, a.n_epochs, a.shuffle, manager, loader, a.partitions)
        print("Total time:", sum(r["time"] for epoch in report["times"] for r in epoch))
        print(json.dumps(report))
        return
    if not 0 <= a.query < len(queries):
        raise SystemExit(f"no query {a.query}; there are {len(queries)}")
    df, nanos = run_query(spark, job_path, queries[a.query], loader, manager, a.partitions)
    print(f"{df.count()} rows in {nanos} ns")


if __name__ == "__main__":
    main()
