"""Pipeline queries over streams: the same filters and projections, run as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame

from calyxa.plans import predicates as P
from calyxa.plans.query import LoadParquet, Query, SelectColumns, _folded


def apply_to_stream(stream: DataFrame, query: Query) -> DataFrame:
    """Filters and projections of a query on a streaming DataFrame; its LoadParquet is the stream.

    Sorting, top rows and selections need an end of the data and are refused.
    """
    df, shown = stream, list(stream.columns)
    for op in _folded(query.ops):
        if isinstance(op, LoadParquet):
            continue
        if isinstance(op, P.Predicate):
            df = df.where(op.column(df.select(*[f"`{c}`" for c in shown])))
        elif isinstance(op, SelectColumns):
            shown = [P.resolve(df, c) for c in op.cols]
        else:
            raise NotImplementedError(f"{type(op).__name__} on a stream")
    return df.select(*[f"`{c}`" for c in shown])
