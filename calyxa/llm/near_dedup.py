"""Near-duplicate documents by MinHash, with every link between different texts.

1. One pass over the whole texts: the set of word shingles, a one-permutation hash of
   it with optimal densification (an empty bin copies the first non-empty bin in its
   own fixed random order of bins), banded into bucket keys.
2. Equal sets are one node (their copies are never expanded).
3. Star-shaped candidates: in every bucket all nodes are paired with one centre only,
   the node with most copies.  Pairs are confirmed on the full sets.
4. Stars alone may miss a link between two nodes u, v of a bucket that are in different
   components, so one of them is not linked to the centre c.  Such a link is found exactly:
   either u and v share shingles that c lacks, and they are joined on the rarest of those
   (prefix filtering); or all they share is in c, so that both |u & c| and |v & c|, which are known, must reach
   the overlap that a link needs, which for u leaves few sizes of v.  Only pairs found by
   either are confirmed.  After that no two nodes of a bucket are left undecided.
5. Connected components over the confirmed links.

Hot groups: buckets are reduced by partial aggregation; pairs are confirmed in cells of
bounded numbers of nodes (salted by the group's size), so no task sees a whole group.

Edge cases: null or blank text has no set, links with nothing and is kept; fewer words
than a shingle form one shingle; very long texts are one set of 8 bytes per shingle; of rows
equally good as a centre the one of smallest fingerprint is it; a null doc_id is never linked
(component null, kept); repeated rows are answered row by row; rows of one doc_id with different texts
are told apart by text_hash and group; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calyxa.llm.components import connected_components
from calyxa.llm.scratch import Scratch, free_name
from calyxa.llm.words import WordHashes, column_bytes, mix, released, shingle_set, signed, slices, split_words

#: Nodes of a cell on either side.
CELL = 256
#: Pairs of a cell, about.
PAIRS = 1024
#: Shingles by which repeated candidates are told; more of them may repeat a pair, never lose it.
HEAD = 64
#: Families of more than one cell that are still broadcast.
MAX_BROADCAST_FAMILIES = 50_000


#: Columns of the keys of dropped rows; a clash with columns of docs would need these very names.
_ID, _HASH = "calyxa near_dedup id", "calyxa near_dedup hash"


@dataclass(frozen=True)
class NearDedup:
    """Shingles of `words` words; linked from a Jaccard similarity of num/den.

    `bands` of `rows` bins: a pair at the threshold s meets in a bucket with
    probability 1 - (1 - s**rows)**bands, over 0.999999 for both uses here.
    """

    words: int = 5
    num: int = 80
    den: int = 100
    rows: int = 4
    bands: int = 32
    seed: int = 20_011

    @property
    def bins(self) -> int:
        return self.rows * self.bands


#: The fixed contract of op1: three words, 85 of 100.
CONTRACT = NearDedup(words=3, num=85, den=100, rows=5, bands=26)


class _Signer:
    """Signatures of shingle sets; made once for each task."""

    def __init__(self, p: NearDedup):
        self.p = p
        k = p.bins
        rng = np.random.default_rng(p.seed)
        self.bounds = np.array([(i << 64) // k for i in range(k)], np.uint64)
        self.order = np.argsort(rng.random((k, k)), axis=1).argsort(axis=1).astype(np.int32)
        self.band = rng.integers(1, 2**63, p.bands, np.uint64)

    def bins(self, s: np.ndarray) -> np.ndarray:
        """One value per bin of the sorted, non-empty set s."""
        at = np.searchsorted(s, self.bounds)
        end = np.append(at[1:], len(s))
        full = at < end
        values = s[np.minimum(at, len(s) - 1)]
        empty = np.flatnonzero(~full)
        if len(empty):
            there = np.flatnonzero(full)
            values[empty] = values[there[self.order[np.ix_(empty, there)].argmin(1)]]
        return values

    def buckets(self, s: np.ndarray) -> np.ndarray:
        """One key per band."""
        key = self.band.copy()
        for column in mix(self.bins(s)).reshape(self.p.bands, self.p.rows).T:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
        return key


def fingerprint(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two 64-bit values of a set; they stand for the set as a whole."""
    return np.add.reduce(mix(s), dtype=np.uint64), np.bitwise_xor.reduce(mix(s + np.uint64(1)))


def text_hash(text: Column) -> Column:
    """With doc_id, what tells rows of different texts apart; the same in every scan."""
    return F.xxhash64(text)


def signatures(docs: DataFrame, p: NearDedup) -> DataFrame:
    """doc_id, text_hash, set size n, set fingerprint (k1, k2) and bucket keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, signer = WordHashes(), _Signer(p)
        for batch in batches:
            n, k1, k2, keys = [], [], [], []
            for text in column_bytes(batch, "text"):
                s = shingle_set(words.of(split_words(text)), p.words)
                one, two = fingerprint(s)
                n.append(len(s)), k1.append(one), k2.append(two)
                keys.append(signed(signer.buckets(s)) if len(s) else np.zeros(0, np.int64))
            lengths = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    batch.column(batch.schema.get_field_index("text_hash")),
                    pa.array(np.array(n, np.int64)),
                    pa.array(signed(np.array(k1, np.uint64))),
                    pa.array(signed(np.array(k2, np.uint64))),
                    pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(keys or [np.zeros(0, np.int64)]))),
                ],
                names=["doc_id", "text_hash", "n", "k1", "k2", "bands"],
            )
        released()

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), text_hash(text).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n long, k1 long, k2 long, bands array<long>")


def _shingle_sets(rows: DataFrame, p: NearDedup) -> DataFrame:
    """(node, text) -> (node, set): the sorted 64-bit shingles as bytes.

    A row whose text does not have the node's fingerprint (another text under the same
    doc_id) is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in (part for b in batches for part in slices(b)):
            nodes, sets = [], []
            for node, text in zip(batch.column("node").to_pylist(), column_bytes(batch, "text"), strict=True):
                s = shingle_set(words.of(split_words(text)), p.words)
                if int(signed(fingerprint(s)[0])) == node:
                    nodes.append(node), sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])
        released()

    return rows.select("node", "text").mapInArrow(run, "node long, set binary")


def _sets_of(nodes: pa.Table) -> dict[int, np.ndarray]:
    return {k: np.frombuffer(x, np.uint64) for k, x in zip(nodes["node"].to_pylist(), nodes["set"].to_pylist(), strict=True)}


def _in(own: np.ndarray, values: np.ndarray) -> np.ndarray:
    return own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values


def _overlaps(pairs: pa.Table, nodes: pa.Table) -> pa.Table:
    """Sizes of the pairs of one cell and of their intersections; every set is there once."""
    sets = _sets_of(nodes)
    a, b = pairs["a"].to_pylist(), pairs["b"].to_pylist()
    by: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        by.setdefault(x, []).append(i)
    both = np.zeros(len(a), np.int64)
    for x, mine in by.items():
        for i in range(0, len(mine), 64):
            some = mine[i : i + 64]
            others = [sets[b[j]] for j in some]
            found = _in(sets[x], np.concatenate(others))
            both[some] = np.add.reduceat(found, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)
    sizes = [pa.array([len(sets[x]) for x in side], pa.int64()) for side in (a, b)]
    return pa.table({"a": pairs["a"], "b": pairs["b"], "na": sizes[0], "nb": sizes[1], "both": pa.array(both)})


def _added(pairs: pa.Table, nodes: pa.Table) -> pa.Table:
    """(a, b, shingle): what b has and a lacks."""
    sets = _sets_of(nodes)
    a, b = pairs["a"].to_pylist(), pairs["b"].to_pylist()
    new = [sets[y][~_in(sets[x], sets[y])] for x, y in zip(a, b, strict=True)]
    times = [len(x) for x in new]
    ends = [np.repeat(np.array(side, np.int64), times) for side in (a, b)]
    return pa.table({"a": ends[0], "b": ends[1], "shingle": pa.array(signed(np.concatenate(new)))})


def _by_cells(pairs: DataFrame, sets: DataFrame, f, schema: str, scratch: Scratch, name: str) -> DataFrame:
    """f on the pairs(a, b, family) and the sets of their nodes, cell by cell.

    A family is dealt to cells of about CELL x CELL nodes at most, and of about PAIRS pairs; a cell
    gets each of its sets once.
    """
    pairs = scratch.table(pairs, f"{name}-pairs")
    sizes = (
        pairs.groupBy("family")
        .agg(F.approx_count_distinct("a").alias("da"), F.approx_count_distinct("b").alias("db"), F.count(F.lit(1)).alias("n"))
        .withColumn("sa", F.ceil(F.col("da") / CELL).cast("int"))
        .select("family", "sa", F.least("db", F.greatest(F.ceil(F.col("db") / CELL), F.ceil(F.col("n") / F.col("sa") / PAIRS))).cast("int").alias("sb"))
    )
    large = scratch.table(sizes.where("sa > 1 or sb > 1"), f"{name}-large")
    few = large.count() <= MAX_BROADCAST_FAMILIES
    one = F.lit(1)
    dealt = pairs.join(F.broadcast(large) if few else large, "family", "left").select(
        "a",
        "b",
        F.xxhash64(
            "family", F.pmod(F.xxhash64("a"), F.coalesce("sa", one)), F.pmod(F.xxhash64("b"), F.coalesce("sb", one))
        ).alias("cell"),
    )
    members = dealt.select("cell", F.col("a").alias("node")).union(dealt.select("cell", F.col("b").alias("node"))).distinct()
    with_sets = members.join(sets, "node").select(F.col("cell").alias("in_cell"), "node", "set")
    return dealt.groupBy("cell").cogroup(with_sets.groupBy("in_cell")).applyInArrow(f, schema)


_PAIR = "a long, b long, na long, nb long, both long"


def _undecided(tested: DataFrame, labels: DataFrame, sets: DataFrame, p: NearDedup, scratch: Scratch) -> DataFrame:
    """Pairs (a, b, family) of a bucket in different components that may be linked."""
    families = scratch.table(
        tested.select("a", "b", "nb", "both")
        .join(labels.toDF("a", "la"), "a", "left")
        .join(labels.toDF("b", "lb"), "b", "left")
        .select("a", "b", "nb", "both", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")),
        "families",
    )
    apart = families.where("la != lb").select("a").distinct()
    mixed = scratch.table(families.join(apart, "a", "left_semi"), "mixed")
    u = mixed.where("la != lb").select("a", F.col("b").alias("u"), F.col("lb").alias("lu"), F.col("nb").alias("nu"), F.col("both").alias("bu"))
    v = mixed.select("a", F.col("b").alias("v"), F.col("lb").alias("lv"), F.col("nb").alias("nv"), F.col("both").alias("bv"))
    num, den = p.num, p.den

    # all that u and v share is in the centre: the sizes of v that u's overlap with it allows
    low = F.ceil(F.col("nu") * num / den - 1e-9).cast("long")
    high = F.floor((F.col("bu") * (num + den) - F.col("nu") * num) / num + 1e-9).cast("long")
    sized = u.withColumn("low", low).withColumn("high", high).where("low <= high")
    sized = sized.withColumn("nv", F.explode(F.sequence("low", "high")))
    inside = sized.join(v, ["a", "nv"]).where(
        (F.col("lu") != F.col("lv")) & (F.col("bv") * (num + den) >= (F.col("nu") + F.col("nv")) * num)
    )

    # they share shingles that the centre lacks: r at least, as they share no more of the centre than
    # u does; so, by rarity in the family, one of the first m - r + 1 of u's m such shingles that others have
    pairs = mixed.select("a", "b", F.col("a").alias("family"))
    added = scratch.table(_by_cells(pairs, sets, _added, "a long, b long, shingle long", scratch, "added"), "added")
    common = added.groupBy("a", "shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    listed = (
        added.join(common, ["a", "shingle"])
        .groupBy("a", "b")
        .agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
        .withColumn("m", F.size("s"))
        .join(mixed.select("a", "b", "lb", "nb", "both"), ["a", "b"])
    )
    needed = F.greatest(F.lit(1), F.ceil(F.col("nb") * num / den - 1e-9).cast("int") - F.col("both").cast("int"))
    prefix = listed.withColumn("k", F.col("m") - needed + 1).where("k > 0").withColumn("s", F.slice("s", F.lit(1), F.greatest("k", F.lit(0)))["shingle"])
    most = (F.col("both") + F.col("m")).alias("most")
    met = scratch.table(
        prefix.select("a", "b", "lb", "nb", most, F.slice("s", 1, HEAD).alias("head"), F.explode("s").alias("shingle")), "met"
    )
    several = met.groupBy("a", "shingle").agg(F.min("lb").alias("l0"), F.max("lb").alias("l1")).where("l0 != l1")
    met = met.join(several.select("a", "shingle"), ["a", "shingle"], "left_semi")
    names = ("a", "shingle", "b", "lb", "nb", "most", "head")
    x, y = (met.select(*names).toDF("a", "shingle", *new) for new in (("u", "lu", "nu", "mu", "hu"), ("v", "lv", "nv", "mv", "hv")))
    near = F.least("mu", "mv") * (num + den) >= (F.col("nu") + F.col("nv")) * num
    # of several shingles that both have in their heads, one makes the pair
    once = F.coalesce(F.array_min(F.array_intersect("hu", "hv")) == F.col("shingle"), F.lit(True))
    outside = x.join(y, ["a", "shingle"]).where((F.col("lu") != F.col("lv")) & (F.col("u") < F.col("v")) & near & once)

    found = inside.select("a", "u", "v").union(outside.select("a", "u", "v"))
    return found.groupBy(F.least("u", "v").alias("low"), F.greatest("u", "v").alias("high")).agg(F.min("a").alias("family")).toDF("a", "b", "family")


def near_duplicates(docs: DataFrame, p: NearDedup, scratch: Scratch) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept, text_hash, group.

    group names the row's component by content (rows without a set or doc_id have none): where a
    doc_id occurs with different texts, it tells components apart that have a component_id in common.
    """
    signed_rows = scratch.table(signatures(docs, p), "signed")
    sized = signed_rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = scratch.table(
        sized.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    # one exemplar row of each class; its fingerprint k1 names the node
    nodes = (
        sized.join(classes.withColumnRenamed("rep", "doc_id"), ["k1", "k2", "n", "doc_id"])
        .dropDuplicates(["k1"])
        .select(F.col("k1").alias("node"), "copies", "bands")
    )
    rows = scratch.table(
        nodes.select(
            F.explode("bands").alias("bucket"),
            (-F.col("copies")).alias("rank"),
            "node",
        ),
        "buckets",
    )
    centre = F.min(F.struct("rank", "node"))["node"].alias("centre")
    centres = rows.groupBy("bucket").agg(centre, F.count(F.lit(1)).alias("size")).where("size > 1")
    star = scratch.table(
        rows.join(centres, "bucket").where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(),
        "star",
    )
    scratch.drop("buckets")

    wanted = star.select(F.col("a").alias("node")).union(star.select(F.col("b").alias("node"))).distinct()
    exemplars = classes.select(F.col("k1").alias("node"), F.col("rep").alias("doc_id")).join(wanted, "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _shingle_sets(texts.join(exemplars, "doc_id"), p)
    sets = scratch.table(found.dropDuplicates(["node"]), "sets")

    linked = F.col("both") * p.den >= (F.col("na") + F.col("nb") - F.col("both")) * p.num
    first = _by_cells(star.select("a", "b", F.col("a").alias("family")), sets, _overlaps, _PAIR, scratch, "star")
    tested = scratch.table(first.withColumn("linked", linked), "tested")
    labels = connected_components(tested.where("linked").select("a", "b"), scratch, "cc")

    rest = _undecided(tested, labels, sets, p, scratch)
    second = _by_cells(rest, sets, _overlaps, _PAIR, scratch, "rest")
    again = scratch.table(second.where(linked).select("a", "b"), "tested-rest")
    if not again.isEmpty():
        labels = connected_components(tested.where("linked").select("a", "b").union(again), scratch, "cc-rest")

    member = classes.select(F.col("k1").alias("node"), "rep").join(labels, "node")
    smallest = member.groupBy("label").agg(F.min("rep").alias("component"))
    of_class = scratch.table(
        classes.join(
            member.join(smallest, "label").select(F.col("node").alias("k1"), "component", "label"), "k1", "left"
        ).select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"), F.coalesce("label", "k1").alias("group")),
        "components",
    )
    scratch.drop("star", "sets", "star-pairs", "added-pairs", "rest-pairs", "tested", "tested-rest", "families", "mixed", "added", "met")
    return (
        signed_rows.select("doc_id", "text_hash", "k1", "k2", "n")
        .join(of_class, ["k1", "k2", "n"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
            "text_hash",
            F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame, p: NearDedup, scratch: Scratch) -> DataFrame:
    """The rows of docs that stay when one row of each component does: that of smallest doc_id, then text_hash.

    Rows are dropped by doc_id and text, so a row stays if its text has no near duplicate, whatever
    other texts its doc_id has.  Of rows equal in doc_id and text one stays; all rows without a
    set or with a null doc_id stay.
    """
    found = scratch.table(near_duplicates(docs, p, scratch).select("doc_id", "text_hash", "group", "kept"), "found")
    grouped = found.where(F.col("group").isNotNull())
    # of the rows of smallest doc_id, few components have several
    several = (
        grouped.where("kept")
        .groupBy("group")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("text_hash").alias("first"), F.max("text_hash").alias("last"))
        .where("rows > 1")
    )
    several = scratch.table(several, "several")
    gone = grouped.where(~F.col("kept")).select("doc_id", "text_hash")
    if several.isEmpty():
        return _without(docs, gone.distinct())
    also = grouped.where("kept").join(several.where("first != last"), "group").where(F.col("text_hash") != F.col("first"))
    gone = gone.union(also.select("doc_id", "text_hash")).distinct()
    stays = _without(docs, gone)
    # rows that occur more than once, of which one stays
    twice = grouped.where("kept").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    key, hashed = free_name(docs, "text_hash"), text_hash(F.col("text").cast("string"))
    repeated = stays.withColumn(key, hashed).join(
        twice.select(F.col("doc_id").alias(_ID), F.col("text_hash").alias(_HASH)),
        (F.col("doc_id").cast("long") == F.col(_ID)) & (F.col(key) == F.col(_HASH)),
        "left_semi",
    )
    once = repeated.dropDuplicates(["doc_id", key]).select(*[f"`{c}`" for c in docs.columns])
    return _without(stays, twice).union(once)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of (doc_id, text_hash)."""
    gone = gone.select(F.col("doc_id").alias(_ID), F.col("text_hash").alias(_HASH))
    same = (F.col("doc_id").cast("long") == F.col(_ID)) & (text_hash(F.col("text").cast("string")) == F.col(_HASH))
    return docs.join(gone, same, "left_anti")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, CONTRACT, Scratch(spark, "op1"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op1_minhash_near_dedup": op1_minhash_near_dedup}
#: Components of a similarity graph are not expressed in SQL; tests hold the query against brute force.
ORACLE_SQL: dict[str, str] = {}
