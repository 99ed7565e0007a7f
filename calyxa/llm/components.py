"""Connected components of a graph of links, without collecting any of it.

Every round each node points to the smallest of itself and its neighbours, pointers
are followed twice, and the links are contracted to the nodes pointed at.  Stars and
cliques end in one or two rounds; chains shrink by a factor per round.  Hot nodes are
met by partial aggregation (minimum per node) and by joins that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calyxa.llm.scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """links(a, b) of longs -> (node, label): label is the smallest node reachable.

    Self-loops and repeated links do no harm, null ends are dropped; a node without
    links to another does not occur.  An empty input gives an empty table.
    """
    edges = scratch.table(
        links.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        f"{name}-edges-0",
    )
    labels, k = None, 0
    while not edges.isEmpty():
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("to")).union(
            edges.select(F.col("a").alias("node"), F.col("a").alias("to"))
        )
        ptr = both.groupBy("node").agg(F.min("to").alias("label"))
        ptr = scratch.table(_followed(ptr, ptr), f"{name}-ptr-{k}")
        if labels is None:
            new = ptr
        else:
            moved = ptr.select(F.col("node").alias("label"), F.col("label").alias("to"))
            new = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        new = scratch.table(new, f"{name}-labels-{k}")
        ends = ptr.select(F.col("node").alias("a"), F.col("label").alias("la"))
        other = ptr.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        kept = scratch.table(
            edges.join(ends, "a")
            .join(other, "b")
            .where("la != lb")
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
            .distinct(),
            f"{name}-edges-{k + 1}",
        )
        scratch.drop(f"{name}-edges-{k}", f"{name}-ptr-{k}", *([f"{name}-labels-{k - 1}"] if k else []))
        edges, labels, k = kept, new, k + 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def _followed(ptr: DataFrame, to: DataFrame) -> DataFrame:
    """ptr with every label replaced by what it points at."""
    step = to.select(F.col("node").alias("label"), F.col("label").alias("next"))
    return ptr.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
