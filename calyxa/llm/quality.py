"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

A text has two blocks of features, hashed to BUCKETS columns: its distinct words and word
pairs, all of the same value, and the runs of one to three word forms (letters, digits
and signs of a word in short, marked if the word is said twice in a row), by how often
they occur.  Both blocks have length 1, so a score is one sparse dot product that does
not grow with the text.  Weights are learnt in one task from a bounded sample of labelled rows, whole
texts each, chosen by a hash of their ids: about MAX_TRAIN rows, and fewer if these have over
MAX_FEATURES features (both bounds are parameters); all rows are scored, whole.

Edge cases: null or empty text has no features and is scored by the intercept; very long texts
have at most 2 * BUCKETS features; without labelled rows every score is 0.5, which predicts 1; null labels and labels other than 0 and 1 teach
nothing; a doc_id labelled twice teaches twice; repeated rows are scored row by row;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calyxa.llm.class_lm import crc_mod
from calyxa.llm.scratch import Scratch, free_name
from calyxa.llm.words import CACHE_WORDS, column_bytes, mix, ngram_hashes, released, slices

BUCKETS = 1 << 18
MAX_TRAIN = 12_000
MAX_FEATURES = 24_000_000
EPOCHS = 3
_RUNS = re.compile(r"(.)\1+", re.S)
#: Parameters of FTRL-proximal.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4


class _Kinds(dict):
    """Code point -> A, a or 9 for upper-case letters, other letters and digits; all else stays."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        return kind


class Forms(dict):
    """Word -> hashes of the lower-cased word and of its form, remembered for some words."""

    def __init__(self) -> None:
        self.kinds = _Kinds()

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        form = _RUNS.sub(r"\1", word.decode().translate(self.kinds))
        got = self[word] = (xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest(form, 1))
        return got


def features(text: bytes | None, forms: Forms) -> tuple[np.ndarray, np.ndarray]:
    """Hashed columns and values of a text."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    h, form = np.array([forms[w] for w in words], np.uint64).T
    form = form.copy()
    form[1:] += (h[1:] == h[:-1]).astype(np.uint64)
    said = np.unique(np.concatenate([mix(h), ngram_hashes(h, 2)]) % np.uint64(BUCKETS))
    runs, times = np.unique(np.concatenate([ngram_hashes(form, n) for n in (1, 2, 3)]) % np.uint64(BUCKETS), return_counts=True)
    value = np.concatenate([np.full(len(said), 1 / np.sqrt(len(said))), times / np.sqrt((times * times).sum())])
    return np.concatenate([said, runs]).astype(np.int32), value.astype(np.float32)


def _train(rows: Iterator[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all columns and, last, the intercept."""
    one = np.ones(1, np.float32)
    data = [(y, np.append(at, np.int32(BUCKETS)), np.concatenate([x, one])) for y, at, x in rows]
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) > L1, w, 0.0)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(data)):
            y, at, x = data[i]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return weights(slice(None))


def fit(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "quality", max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES
) -> np.ndarray:
    """Weights learnt from docs(doc_id, text) and labels(doc_id, label)."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")
    )
    share = min(1.0, max_train / max(1, usable.count()))
    chance = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1_000_003)) / 1_000_003
    chosen = usable.where(chance < share)  # about max_train rows, so it may be broadcast

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms()
        for batch in (part for b in batches for part in slices(b)):
            found = [features(t, forms) for t in column_bytes(batch, "text")]
            lengths = pa.array(np.cumsum([0, *(len(at) for at, _ in found)]).astype(np.int32))
            columns = [
                pa.ListArray.from_arrays(lengths, pa.array(np.concatenate([f[k] for f in found] or [np.zeros(0, t)])))
                for k, t in ((0, np.int32), (1, np.float32))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "y", "i", "x"])
        released()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for batch in batches:
                i, x = (np.array(batch.column(k).flatten()) for k in (2, 3))
                cut = np.cumsum([0, *(batch.column(2).value_lengths().to_pylist())])
                for y, s, e in zip(batch.column(1).to_pylist(), cut[:-1], cut[1:], strict=True):
                    yield y, i[s:e], x[s:e]  # copied by _train

        w = _train(rows())
        i = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(w[i])], names=["i", "w"])
        released()

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = sample.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    rows = scratch.table(sample.mapInArrow(extract, "doc_id long, y int, i array<int>, x array<float>"), "features")
    found = rows.agg(F.sum(F.size("i"))).first()[0] or 0
    if found > max_features:
        rows = rows.where(chance < share * max_features / found)
    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "y")
    got = one.select("doc_id", "y", "i", "x").mapInArrow(learn, "i long, w double").toArrow()
    weights = np.zeros(BUCKETS + 1)
    weights[np.array(got["i"], np.int64)] = np.array(got["w"], np.float64)
    return weights


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """docs with the score of the whole text, from 0 to 1, in a new column; all other columns stay."""
    if free_name(docs, name) != name:
        raise ValueError(f"docs already has a column named {name}")
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, forms = sent.value, Forms()
        for batch in batches:
            logits = np.empty(batch.num_rows)
            for i, text in enumerate(column_bytes(batch, "text")):
                at, x = features(text, forms)
                logits[i] = w[-1] + w[at] @ x
            p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, name])
        released()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(doc_id):
    return crc_mod(doc_id, 3) == 1


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    weights = fit(docs, labels.where(~held_out(F.col("doc_id"))), Scratch(spark, "op7"))
    scored = score(docs, weights)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
#: The model is learnt by an online method; tests hold it to its accuracy on held-out rows.
ORACLE_SQL: dict[str, str] = {}
