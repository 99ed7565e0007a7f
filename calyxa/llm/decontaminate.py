"""Benchmark decontamination with DataFrame functions only.

The windows of all benchmark items (10 consecutive words; an item of fewer is one
window) are a set of 64-bit hashes that is broadcast.  One scan over the whole texts makes the
words of a document, cuts them into blocks of BLOCK words (so a very long text is never put together as windows
at once), and looks up the hash of every window; what is not in the set ends there, within
the same stage.  The few hits are verified on their words against the windows, so a hash
collision never counts, and folded per document.

The benchmark is the only thing that is broadcast.  Its windows are counted first: one set holds
MAX_HASHES at most, of more there are several sets, each with a scan of its own, so any number of
windows has the same result.  Where the benchmark has at most MAX_VOCABULARY different words,
windows with any other word are left out before they are put together.

Edge cases: null or blank text has no words (n_words 0, not contaminated); null or
blank items are no windows; an item whose id is null makes its words hits, but is neither
listed nor counted; rows are told apart by position, so repeated rows and
repeated or null doc_ids are answered row by row; items that share a window are all named;
empty tables give empty results; columns other than doc_id, text, item_id are not looked at.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calyxa.llm.scratch import Scratch

WINDOW = 10
#: Hashes of one broadcast set, different words that positions are told by, windows with their items that are broadcast for verification.
MAX_HASHES, MAX_VOCABULARY, MAX_VERIFIED = 4_000_000, 20_000, 50_000
#: What the one row of a text that is no window is looked up by.
HEAD = 0
#: Words of a document whose windows are put together at a time.
BLOCK = 2048
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z is lower-cased: ASCII other than digits and lower-case letters.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; empty for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _GAP), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, len, gram (its words joined by blanks): every distinct window of every item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    return (
        items.select("item_id", "len", "w", F.explode(starts).alias("at"))
        .select("item_id", "len", F.array_join(F.slice("w", F.col("at"), F.col("len")), " ").alias("gram"))
        .distinct()
    )


def _windows(length: int, told: bool) -> Column:
    """at, len, gram of the windows of a block(before, w); if told, of those all of whose words are `known`."""
    last = F.least(F.lit(BLOCK), F.size("w") - length + 1)
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    if told:
        starts = F.filter(starts, lambda i: reduce(and_, [F.get("known", i + k) for k in range(-1, length - 1)]))
    gram = lambda i: F.array_join(F.slice("w", i, F.lit(length)), " ")
    return F.transform(starts, lambda i: F.struct((F.col("before") + i).alias("at"), F.lit(length).alias("len"), gram(i).alias("gram")))


def _scan(texts: DataFrame, hashes: DataFrame, lengths: list[int], vocabulary: list[str] | None, heads: bool) -> DataFrame:
    """row, doc_id, n_words, at, len, gram of every window of texts(row, doc_id, w) whose hash is in the set.

    lengths: those of windows; vocabulary: all words of windows, or None if they are too many to tell
    by.  With heads, every text has one more row, at 0.
    """
    longest = max(lengths, default=1)
    n = F.size("w")
    cuts = F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / BLOCK).cast("int"))
    block = F.explode(F.transform(cuts, lambda k: F.struct((k * BLOCK).alias("before"), F.slice("w", k * BLOCK + 1, F.lit(BLOCK + longest - 1)).alias("w"))))
    blocks = texts.select("row", "doc_id", n.cast("long").alias("n_words"), block.alias("b")).select("row", "doc_id", "n_words", "b.before", "b.w")
    if vocabulary is not None:
        blocks = blocks.withColumn("known", F.transform("w", lambda x: x.isin(vocabulary)))
    found = [
        F.filter(
            F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("len"), F.lit(None).cast("string").alias("gram"))),
            lambda _: F.lit(heads) & (F.col("before") == 0),
        )
    ]
    found += [_windows(length, vocabulary is not None) for length in lengths]
    windows = blocks.select("row", "doc_id", "n_words", F.explode(F.concat(*found)).alias("h")).select("row", "doc_id", "n_words", "h.*")
    # heads look up a number that is put into the set; a window that happens to have it is not verified
    head = F.lit(HEAD).cast("long")
    hashed = windows.withColumn("hash", F.when(F.col("at") > 0, F.xxhash64("gram")).otherwise(head))
    known = hashes.where(F.col("hash") != head).select(F.col("hash").alias("known")).union(hashes.sparkSession.range(1).select(head))
    return hashed.join(F.broadcast(known), F.col("hash") == F.col("known")).drop("hash", "known")


def contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """One row per row of docs(row, doc_id, text): row, doc_id, n_words, items, spans.

    items: sorted ids of the items with an occurring window; spans: (at, len) of the
    verified occurrences in words, counted from 1.
    """
    windows = scratch.table(benchmark_windows(benchmark, window), "windows")
    hashes = scratch.table(windows.select(F.xxhash64("gram").alias("hash")).distinct(), "hashes")
    n = hashes.count()
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # at most `window` rows
    said = windows.select(F.explode(F.split("gram", " ")).alias("w")).distinct().limit(MAX_VOCABULARY + 1).collect()
    vocabulary = sorted(r["w"] for r in said) if len(said) <= MAX_VOCABULARY else None
    texts = docs.select("row", "doc_id", words(F.col("text")).alias("w"))
    sets = max(1, -(-n // MAX_HASHES))
    parts = []
    for k in range(sets):
        part = hashes.where(F.pmod("hash", F.lit(sets)) == k) if sets > 1 else hashes
        parts.append(scratch.table(_scan(texts, part, lengths, vocabulary, heads=k == 0), f"scanned-{k}"))
    scanned = parts[0]
    for more in parts[1:]:
        scanned = scanned.union(more)
    # windows with their items; verified by equality of the words, not of the hash
    known = windows.groupBy("len", "gram").agg(F.collect_set("item_id").alias("ids"))
    hit = (
        scanned.where("at > 0")
        .select("row", "at", "len", "gram")
        .join(F.broadcast(known) if n <= MAX_VERIFIED else known, ["len", "gram"])
        .groupBy("row")
        .agg(
            F.collect_list(F.struct("at", "len")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"),
        )
    )
    return parts[0].where("at = 0").select("row", "doc_id", "n_words").join(hit, "row", "left").select(
        "row",
        "doc_id",
        "n_words",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<at:int,len:int>>")).alias("spans"),
    )


def with_row(docs: DataFrame) -> DataFrame:
    """docs with `row`, a number of its own for each row, the same whenever a lost task is run again."""
    return docs.withColumn("row", F.monotonically_increasing_id())


def hit_words(spans: Column) -> Column:
    """How many word positions the spans cover."""
    covered = F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))
    return F.size(F.array_distinct(covered)).cast("long")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(with_row(docs), benchmark, Scratch(spark, "op4"))
    return found.select(
        "doc_id",
        "n_words",
        hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}

_WORDS_SQL = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^0-9a-z\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '')"
)
ORACLE_SQL = {
    "op4_benchmark_decontamination": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS_SQL} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram
          FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM grams),
windows AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs CROSS JOIN lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, windows.n, item_id FROM windows JOIN grams ON windows.gram = grams.gram AND windows.n = grams.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
}
