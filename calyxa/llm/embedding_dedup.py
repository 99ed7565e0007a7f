"""Near-duplicate embeddings by sorted projection passes.

1. Equal vectors are one node with a number of copies; vectors that are null, empty, zero
   or hold null or non-finite components take no part and link with nothing.
2. Each pass gives a node a key of 63 concatenated one-bit random-projection hashes,
   orders the nodes by it, and compares every node with its next WINDOW neighbours by
   cosine in double precision.  Where more nodes than a window holds agree on the first
   bits of their keys (a crowd), all of them are compared, block against block in cells of
   RUN_CELL nodes, so every pair that agrees on those bits meets, however dense its
   neighbourhood is.  A pair at the threshold is missed by all passes with a probability of MISS:
   that gives the number of passes for each number of bits.  How many nodes agree on so many
   bits is measured on a sample of SAMPLE nodes, with hashes of the vectors as they are and of
   vectors less the sample's mean (which tells vectors apart that all point one way, but a pair at the
   threshold agrees on fewer of these bits), and the bits with the fewest comparisons are taken.
   The sample decides what is fast, and of centred hashes the distance from the mean beyond which
   MISS holds (that of 99 of 100 sampled nodes).
   A block of the order or a cell returns a spanning forest of its links, never all of them.
3. The links of all passes are united to components.
4. The window bounds partners, so components are completed exactly: their members are
   compared block against block (cells of bounded size), and only counts per vector
   leave a cell.  A hot group is dealt to many cells.

Edge cases: rows with a null vec_id link with nothing (component null, kept); vectors of
different lengths never link; very long vectors are one row; repeated rows, and rows of one vec_id,
count as vectors of their own; of nodes with equal keys (ties) those of smaller hash come first; an empty table gives an
empty result; labels and other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyxa.llm.components import connected_components
from calyxa.llm.scratch import Scratch

WINDOW = 64
MISS = 1e-3
BITS = 63
#: Ranks of a block of the order, nodes of a cell, passes of one job.
BLOCK, CELL, AT_ONCE = 512, 512, 6
#: Nodes of each side of a cell of a crowd.
RUN_CELL = 1024
#: Nodes that the plan is made from, and numbers of them at most.
SAMPLE, SAMPLE_NUMBERS = 1000, 4_000_000


def passes_for(agree: float, depth: int, miss: float = MISS) -> int:
    """Passes after which a pair whose bits agree with probability `agree` has never agreed on the first `depth` with probability `miss`."""
    p = max(agree**depth, 1e-12)  # rarer ones are never the cheapest
    return 1 if p >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-p)))


@dataclass(frozen=True)
class Plan:
    """Bits of a crowd, number of passes, and by length the point that hashes are taken around."""

    depth: int
    passes: int
    centre: dict[int, np.ndarray]


def plan_for(n: int, threshold: float, sample: np.ndarray, window: int = WINDOW) -> Plan:
    """The plan with the fewest comparisons for n unit vectors, judged by a sample of them."""
    least = None
    for centre in (None, sample.mean(axis=0)):
        x = sample if centre is None else sample - centre
        radius = np.sqrt((x * x).sum(axis=1))
        near = max(1e-9, float(np.quantile(radius, 0.01)))
        agree = 1 - math.acos(max(-1.0, 1 - (1 - threshold) / near**2)) / math.pi
        cosine = np.clip((x @ x.T) / np.maximum(np.outer(radius, radius), 1e-18), -1, 1)
        others = 1 - np.arccos(cosine[np.triu_indices(len(x), 1)]) / math.pi
        for depth in range(41):
            passes = passes_for(agree, depth)
            together = float((others**depth).mean()) if len(others) else 1.0
            cost = passes * (window + n * together)
            if least is None or cost < least[0]:
                least = cost, Plan(depth, passes, {} if centre is None else {len(centre): centre})
    return least[1]


def _unit(raw: list[bytes]) -> np.ndarray:
    """Rows of float64 bytes, all of one length, as unit vectors."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, embedding) -> v: float64 bytes, null for vectors that take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                v = np.array(x, np.float64) if x and None not in x else np.zeros(0)
                good = len(v) and np.isfinite(v).all() and v.any()
                out.append((v + 0.0).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(
        run, "vec_id long, v binary"
    )


def _sampled(nodes: DataFrame) -> np.ndarray:
    """Unit vectors of some nodes, those of the commonest length; nodes are named by hashes, so the first ones are any."""
    lengths = nodes.groupBy(F.length("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    size = lengths.orderBy(F.desc("n"), "size").first()["size"]
    rows = max(2, min(SAMPLE, SAMPLE_NUMBERS * 8 // size))
    return _unit([bytes(r["v"]) for r in nodes.where(F.length("v") == size).orderBy("node").limit(rows).collect()])


def _keys(nodes: DataFrame, first: int, last: int, seed: int, centre: dict[int, np.ndarray]) -> DataFrame:
    """(node, v) -> (pass, key, node) for passes first to last - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            raw = batch.column(1).to_pylist()
            node = np.array(batch.column(0))
            by: dict[int, list[int]] = {}
            for i, v in enumerate(raw):
                by.setdefault(len(v), []).append(i)
            for size, at in by.items():
                dim = size // 8
                if dim not in planes:
                    planes[dim] = np.concatenate(
                        [np.random.default_rng([seed, k, dim]).standard_normal((dim, BITS)) for k in range(first, last)], axis=1
                    )
                signs = (_unit([raw[i] for i in at]) @ planes[dim] > centre.get(dim, np.zeros(dim)) @ planes[dim]).reshape(len(at), last - first, BITS)
                keys = (signs * weights).sum(axis=2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(first, last, dtype=np.int32), len(at))),
                        pa.array(keys.reshape(-1)),
                        pa.array(np.repeat(node[at], last - first)),
                    ],
                    names=["pass", "key", "node"],
                )

    return nodes.select("node", "v").mapInArrow(run, "pass int, key long, node long")


def _numbered(ordered: DataFrame) -> DataFrame:
    """The rows of each partition with the partition's number and their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.arange(at, at + n, dtype=np.int64)),
                ],
                names=["pass", "key", "node", "part", "at"],
            )
            at += n

    return ordered.mapInArrow(run, "pass int, key long, node long, part int, at long")


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join what the ones before left apart."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs.tolist():
        ra, rb = find(a), find(b)
        if ra != rb:
            root[rb] = ra
            out.append((a, b))
    return out


def _window_links(threshold: float, window: int, block: int):
    def links(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        rank, turn = np.array(group["rank"]), np.array(group["pass"])
        node, raw = np.array(group["node"]), group["v"].to_pylist()
        own = rank // block == rank[0] // block if len(rank) else rank > 0
        out: list[tuple[int, int]] = []
        sizes = np.array([len(v) for v in raw])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            x = _unit([raw[i] for i in at])
            near = np.triu(x @ x.T >= threshold, 1)
            near &= own[at][:, None] & (rank[at][None, :] - rank[at][:, None] <= window) & (turn[at][None, :] == turn[at][:, None])
            out += [(at[a], at[b]) for a, b in _forest(len(at), np.argwhere(near))]
        a, b = (np.array([p[i] for p in out], np.int64) for i in (0, 1))
        return pa.table({"a": pa.array(node[a]), "b": pa.array(node[b])})

    return links


def _tree(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links, with each row looked at once."""
    free, out = near.any(axis=1), []
    for start in range(len(near)):
        if not free[start]:
            continue
        free[start] = False
        reached = [start]
        while reached:
            a = reached.pop()
            new = np.flatnonzero(near[a] & free)
            free[new] = False
            out += [(a, b) for b in new.tolist()]
            reached += new.tolist()
    return out


def _run_links(threshold: float):
    def links(group: pa.Table) -> pa.Table:
        side, node, raw = np.array(group["side"]), np.array(group["node"]), group["v"].to_pylist()
        one = group["i"][0].as_py() == group["j"][0].as_py()
        out: list[tuple[int, int]] = []
        sizes = np.array([len(v) for v in raw])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            x = _unit([raw[i] for i in at])
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if not one:
                near &= side[at][:, None] != side[at][None, :]
            out += [(at[a], at[b]) for a, b in _tree(near | near.T)]
        a, b = (np.array([p[i] for p in out], np.int64) for i in (0, 1))
        return pa.table({"a": pa.array(node[a]), "b": pa.array(node[b])})

    return links


def _crowd_links(ranked: DataFrame, nodes: DataFrame, depth: int, threshold: float, scratch: Scratch, name: str) -> DataFrame | None:
    """Links of all nodes that agree on the first bits of a key, where a window doesn't hold them; None if it always does."""
    prefixed = ranked.withColumn("prefix", F.shiftright("key", BITS - depth))
    runs = prefixed.groupBy("pass", "prefix").agg(F.min("rank").alias("head"), F.count(F.lit(1)).alias("size"))
    crowds = scratch.table(runs.where(F.col("size") > WINDOW + 1), name)
    if crowds.isEmpty():
        return None
    cells = (
        prefixed.join(crowds, ["pass", "prefix"])
        .withColumn("side", F.floor((F.col("rank") - F.col("head")) / RUN_CELL).cast("long"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / RUN_CELL).cast("long"))))
        .select("pass", "head", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node")
    )
    return (
        cells.join(nodes.select("node", "v"), "node")
        .groupBy("pass", "head", "i", "j")
        .applyInArrow(_run_links(threshold), "a long, b long")
    )


def _pass_links(nodes: DataFrame, first: int, last: int, plan: Plan, threshold: float, scratch: Scratch, seed: int) -> DataFrame:
    spark = scratch.spark
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = _keys(nodes, first, last, seed, plan.centre)
    ordered = keyed.repartitionByRange(parts, "pass", "key", "node").sortWithinPartitions("pass", "key", "node")
    placed = scratch.table(_numbered(ordered), f"order-{first}")
    # one count per partition of the order: bounded by the number of partitions
    total, starts = 0, []
    for r in placed.groupBy("part").count().orderBy("part").collect():
        starts.append((r["part"], total))
        total += r["count"]
    offsets = spark.createDataFrame(starts, "part int, start long")
    ranked = placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("start") + F.col("at"))
    block = F.floor(F.col("rank") / BLOCK).cast("long")
    tail = (F.col("rank") % BLOCK < WINDOW) & (block > 0)
    dealt = ranked.select(
        "pass", "node", "rank", F.explode(F.when(tail, F.array(block, block - 1)).otherwise(F.array(block))).alias("block")
    )
    links = (
        dealt.join(nodes.select("node", "v"), "node")
        .groupBy("block")
        .applyInArrow(_window_links(threshold, WINDOW, BLOCK), "a long, b long")
    )
    crowded = _crowd_links(ranked, nodes, plan.depth, threshold, scratch, f"crowds-{first}")
    return (links if crowded is None else links.union(crowded)).distinct()


def _cell_counts(threshold: float):
    def counts(group: pa.Table) -> pa.Table:
        label, side = np.array(group["label"]), np.array(group["side"])
        node, copies, raw = np.array(group["node"]), np.array(group["copies"]), group["v"].to_pylist()
        one = group["i"][0].as_py() == group["j"][0].as_py()
        links = np.zeros(len(node), np.int64)
        order = np.lexsort((np.array([len(v) for v in raw]), label))
        cut = [0]
        for k in range(1, len(order)):
            p, q = order[k - 1], order[k]
            if label[p] != label[q] or len(raw[p]) != len(raw[q]):
                cut.append(k)
        for s, e in zip(cut, [*cut[1:], len(order)], strict=True):
            at = order[s:e]
            near = (x := _unit([raw[i] for i in at])) @ x.T >= threshold
            np.fill_diagonal(near, False)
            if not one:
                near &= side[at][:, None] != side[at][None, :]
            links[at] = near @ copies[at]
        return pa.table({"node": pa.array(node), "links": pa.array(links)})

    return counts


def embedding_links(vectors: DataFrame, threshold: float, scratch: Scratch, seed: int = 5) -> DataFrame:
    """One row per row of vectors(vec_id, embedding): vec_id, n_links, component_id, kept."""
    packed = _packed(vectors).withColumn("k", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(seed), "v"))
    packed = scratch.table(packed, "packed")
    used = packed.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    classes = used.groupBy("k", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    nodes = scratch.table(
        used.join(classes, ["k", "k2"]).where(F.col("vec_id") == F.col("rep")).dropDuplicates(["k"])
        .select(F.col("k").alias("node"), "k2", "rep", "copies", "v"),
        "nodes",
    )
    n = nodes.count()
    plan, found = plan_for(n, threshold, _sampled(nodes)) if n > 1 else Plan(0, 0, {}), []
    total = plan.passes
    for first in range(0, total, AT_ONCE):
        links = _pass_links(nodes, first, min(total, first + AT_ONCE), plan, threshold, scratch, seed)
        found.append(scratch.table(links, f"links-{first}"))
        scratch.drop(f"order-{first}", f"crowds-{first}")
    links = found[0] if found else nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("a != b")
    for more in found[1:]:
        links = links.union(more)
    labels = connected_components(links, scratch, "cc")

    sized = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    members = scratch.table(
        labels.join(sized, "label").join(nodes, "node").select("label", "node", "rep", "copies", "v", F.ceil(F.col("size") / CELL).alias("blocks")),
        "members",
    )
    packs = max(1, members.count() // CELL)
    blk = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long")
    cells = (
        members.withColumn("side", blk)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            F.when(F.col("blocks") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(packs))).alias("home"),
            F.col("blocks").alias("kind"),
            F.least("side", "other").alias("i"),
            F.greatest("side", "other").alias("j"),
            "label", "side", "node", "copies", "v",
        )
    )
    counted = cells.groupBy("home", "kind", "i", "j").applyInArrow(_cell_counts(threshold), "node long, links long")
    summed = counted.groupBy("node").agg(F.sum("links").alias("links"))
    smallest = members.groupBy("label").agg(F.min("rep").alias("component"))
    linked = members.select("node", "label").join(smallest, "label").join(summed, "node").select("node", "links", "component")
    of_class = scratch.table(
        nodes.select("node", "k2", "rep", "copies").join(linked, "node", "left").select(
            F.col("node").alias("k"),
            "k2",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
        ),
        "classes",
    )
    scratch.drop("members", *(f"links-{k}" for k in range(0, total, AT_ONCE)))
    rows = packed.select("vec_id", F.when(F.col("v").isNotNull() & F.col("vec_id").isNotNull(), F.col("k")).alias("k"), "k2")
    return (
        rows.join(of_class, ["k", "k2"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return embedding_links(vectors, 0.95, Scratch(spark, "op10"))


QUERIES = {"op10_embedding_near_dedup": op10_embedding_near_dedup}
#: Components of a similarity graph are not expressed in SQL; tests hold the query against brute force.
ORACLE_SQL: dict[str, str] = {}
