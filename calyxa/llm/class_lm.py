"""Brown class-based n-grams: scores of texts from word classes found by exchange.

1. Counts of all words of the training texts, by shuffle (64-bit word hashes as keys).
2. The TOP most frequent words get their classes by exchange: from the counts of all pairs
   of neighbours (all other words are one item of its own class), words are moved one at a
   time to the class where the class bigram likelihood is largest, until a sweep moves none.
3. Every other word of the corpus, however rare, is moved to the class of best likelihood
   given how often it follows and precedes each class.  These counts are shuffled by
   word and folded word by word, so vocabulary and counts grow with the corpus.
4. P(token | token before) = P(class | class before) * P(token | class): class bigrams are
   counted over all training texts with the classes of all words, and interpolated with
   class unigrams; every word's count is raised by one, and one class (that of most
   words) has one unseen word, so a text's probability is never zero (they sum to one where no class is empty).

Scores need class and count of every token.  Those of the KNOWN most frequent words are
broadcast (a bounded table); other words meet theirs by shuffle, once per document and word,
and a document's sequence of classes is put together from both.

Edge cases: null text is empty, its only token is the end; rows are told apart by position,
so repeated rows and repeated or null doc_ids get a result each; very long texts are one
row's sequence of a byte or two per token; of words equally frequent those of smaller
hash are taken first, of classes equally likely the first; an empty training set
leaves every word unseen; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calyxa.llm.scratch import Scratch
from calyxa.llm.words import column_bytes, released, signed, slices, split_words

TOP, CLASSES, KNOWN = 1024, 64, 65_536
SWEEPS = 12
#: Distinct words that a task holds before it passes their counts on, and occurrences likewise.
HELD_WORDS, HELD_TOKENS = 250_000, 1_500_000
#: Words whose codes a task remembers.
REMEMBERED = 300_000
#: The end of a text as a token; no word holds a blank.
END = b" end"
#: Numbers below are places of known words, others are hashes.
_PLACES = 1 << 20


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text modulo m; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def word_hash(word: bytes) -> int:
    return max(xxhash.xxh3_64_intdigest(word), _PLACES)


_END_HASH = int(signed(word_hash(END)))


def word_counts(texts: DataFrame) -> DataFrame:
    """(text) -> (word, n): counts of all tokens, the end included; word is a 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def passed() -> pa.RecordBatch:
            keys = signed(np.fromiter(map(word_hash, held), np.uint64, len(held)))
            out = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.fromiter(held.values(), np.int64, len(held)))], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in column_bytes(batch, "text"):
                held.update(split_words(text))
                held[END] += 1
                if len(held) >= HELD_WORDS:
                    yield passed()
        if held:
            yield passed()

    parts = texts.select(F.col("text").cast("string")).mapInArrow(run, "word long, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class _Codes(dict):
    """Word -> its place among the known words, or its hash; remembered for some words."""

    def __init__(self, places: dict[int, int]):
        self.places = places

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            frequent = {w: c for w, c in self.items() if c < _PLACES}
            self.clear()
            self.update(frequent)
        h = word_hash(word)
        code = self[word] = self.places.get(h, h)
        return code

    def run_on(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all tokens of a batch's texts, an end first and one after each text; the tokens of each text."""
        tokens, lengths = [END], []
        for text in column_bytes(batch, "text"):
            words = split_words(text)
            tokens += words
            tokens.append(END)
            lengths.append(len(words) + 1)
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens)), np.array(lengths, np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (part for batch in batches for part in slices(batch))


def _places(hashes: np.ndarray) -> dict[int, int]:
    return {h: i for i, h in enumerate(hashes.view(np.uint64).tolist())}


def top_bigrams(texts: DataFrame, top: np.ndarray) -> DataFrame:
    """(text) -> (pair, n): counts of neighbours among the top words; all others are item len(top)."""
    size = len(top) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = _Codes(_places(top)), np.zeros(size * size, np.int64)
        for batch in _parts(batches):
            x = np.minimum(codes.run_on(batch)[0], np.uint64(len(top))).astype(np.int64)
            total += np.bincount(x[:-1] * size + x[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])
        released()

    parts = texts.select(F.col("text").cast("string")).mapInArrow(run, "pair long, n long")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1.0)), 0.0)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS, pinned: int = 0) -> np.ndarray:
    """Class of each item, by exchange from classes of like frequency.

    The last `pinned` items stay in classes of their own, behind the others.
    """
    n = len(bigrams)
    free = n - pinned
    weight = bigrams.sum(1) + bigrams.sum(0)
    by_weight = np.argsort(-weight[:free], kind="stable")
    kind = np.arange(n) - free + classes
    kind[by_weight] = np.arange(free) % classes
    width = classes + pinned
    one = np.zeros((n, width))
    one[np.arange(n), kind] = 1
    between = one.T @ bigrams @ one
    for _ in range(sweeps):
        moved = 0
        for w in by_weight:
            if not weight[w]:
                continue
            out = np.bincount(kind, bigrams[w], width)
            into = np.bincount(kind, bigrams[:, w], width)
            own, a = bigrams[w, w], kind[w]
            out[a] -= own
            into[a] -= own
            between[a] -= out
            between[:, a] -= into
            between[a, a] -= own
            # the gain of adding w to each class b: changes of row b and column b
            f = _xlogx(between)
            row, col = between + out[None, :], between + into[:, None]
            gain = (_xlogx(row) - f).sum(1) + (_xlogx(col) - f).sum(0)
            d = np.diagonal(between)
            gain += _xlogx(d + out + into + own) - _xlogx(d + out) - _xlogx(d + into) + _xlogx(d)
            left, right = between.sum(1) + into, between.sum(0) + out
            gain -= _xlogx(left + out.sum() + own) - _xlogx(left) + _xlogx(right + into.sum() + own) - _xlogx(right)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            kind[w] = b
            between[b] += out
            between[:, b] += into
            between[b, b] += own
        if not moved:
            break
    return kind


def contexts(texts: DataFrame, top: np.ndarray, kind: np.ndarray) -> DataFrame:
    """(text) -> (word, sides): for all words but the top ones, two bytes per occurrence.

    The bytes are the classes of the word before and of the word behind, CLASSES if that is none of the top.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, of_place = _Codes(_places(top)), np.append(kind, CLASSES).astype(np.uint8)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def passed() -> pa.RecordBatch:
            word, sides = np.concatenate([w for w, _ in held]), np.concatenate([s for _, s in held])
            held.clear()
            order = np.argsort(word, kind="stable")
            word = word[order]
            first = np.flatnonzero(np.diff(word, prepend=word[:1] ^ np.uint64(1)))
            ends = np.append(first, len(word)).astype(np.int32) * 2
            data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(sides[order].tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(signed(word[first])), data], names=["word", "sides"])

        for batch in _parts(batches):
            code, _ = codes.run_on(batch)
            classes = of_place[np.minimum(code, np.uint64(len(top))).astype(np.int64)]
            at = np.flatnonzero(code >= len(top))
            held.append((code[at], np.stack([classes[at - 1], classes[at + 1]], axis=1)))
            if sum(len(w) for w, _ in held) >= HELD_TOKENS:
                yield passed()
        if held and any(len(w) for w, _ in held):
            yield passed()
        released()

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "word long, sides binary")


def assigned(sides: DataFrame, before: np.ndarray, behind: np.ndarray, mass: np.ndarray) -> DataFrame:
    """(word, sides) -> (word, n, kind): each word's count and its class of best likelihood.

    before[c, b] and behind[c, b] are the logs that a neighbour of class c gives to class b,
    mass[b] is the log of the tokens of b.  A word's rows come one after the other, and only sums are kept.
    """
    width = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left, right = None, np.zeros(width), np.zeros(width)

        def result(word: np.ndarray, lefts: np.ndarray, rights: np.ndarray) -> pa.RecordBatch:
            n = lefts.sum(axis=1)
            kind = (lefts @ before + rights @ behind - n[:, None] * mass).argmax(axis=1)
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n.astype(np.int64)), pa.array(kind.astype(np.int32))], names=["word", "n", "kind"])

        for batch in batches:
            if not batch.num_rows:
                continue
            word = np.array(batch.column(0))
            raw = batch.column(1).to_pylist()
            new = np.diff(word, prepend=word[0]) != 0
            group = np.cumsum(new)
            of = np.repeat(group, np.fromiter(map(len, raw), np.int64, len(raw)) // 2) * width
            flat = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 2)
            groups = int(group[-1]) + 1
            lefts, rights = (np.bincount(of + flat[:, k], minlength=groups * width).reshape(groups, width).astype(float) for k in (0, 1))
            words = word[np.append(0, np.flatnonzero(new))]
            if last is not None:
                if last == words[0]:
                    lefts[0] += left
                    rights[0] += right
                else:
                    yield result(np.array([last]), left[None, :], right[None, :])
            last, left, right = words[-1], lefts[-1], rights[-1]
            if groups > 1:
                yield result(words[:-1], lefts[:-1], rights[:-1])
        if last is not None:
            yield result(np.array([last]), left[None, :], right[None, :])

    return sides.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word long, n long, kind int")


@dataclass(frozen=True)
class ClassModel:
    """What scoring broadcasts; all of bounded size."""

    known: np.ndarray  # hashes of the known words
    counts: np.ndarray  # their counts
    kind: np.ndarray  # their classes
    unseen: int  # class of words that training texts don't hold
    tokens: int
    types: int
    types_of: np.ndarray  # types of each class


def _smoothed(between: np.ndarray) -> np.ndarray:
    """P(class | class before), interpolated with class unigrams."""
    share = (between.sum(0) + 1) / (between.sum() + len(between))
    return (between + 8 * share[None, :]) / (between.sum(1) + 8)[:, None]


def fit(texts: DataFrame, scratch: Scratch) -> tuple[ClassModel, DataFrame]:
    """The model of the training texts and the table (word, n, kind) of their words."""
    counts = scratch.table(word_counts(texts), "counts")
    frequent = counts.orderBy(F.desc("n"), "word").limit(KNOWN).toArrow()
    known, n = np.array(frequent["word"], np.int64), np.array(frequent["n"], np.int64)
    # the end is always among the first
    if _END_HASH in known:
        at = int(np.flatnonzero(known == _END_HASH)[0])
        order = np.append(at, np.delete(np.arange(len(known)), at))
        known, n = known[order], n[order]
    top = known[:TOP]
    pairs = top_bigrams(texts, top).toArrow()
    size = len(top) + 1
    bigrams = np.zeros(size * size)
    bigrams[np.array(pairs["pair"], np.int64)] = np.array(pairs["n"], np.int64)
    kind = exchange(bigrams.reshape(size, size), CLASSES, pinned=1)
    one = np.zeros((size, CLASSES + 1))
    one[np.arange(size), kind] = 1
    between = one.T @ bigrams.reshape(size, size) @ one
    kind = kind[:-1]

    p = _smoothed(between)
    before, behind = np.log(p[:, :CLASSES]), np.log(p[:CLASSES].T)
    mass = np.log(between.sum(0)[:CLASSES] + 1)
    ours = scratch.spark.createDataFrame(pa.table({"word": top, "n": n[:TOP], "kind": kind.astype(np.int32)}))
    rest = scratch.table(assigned(contexts(texts, top, kind), before, behind, mass), "rest")
    vocabulary = rest.union(ours)
    found = vocabulary.join(F.broadcast(_hashes(scratch, known)), "word").select("word", "kind").toArrow()
    of = dict(zip(found["word"].to_pylist(), found["kind"].to_pylist(), strict=True))
    kind = np.array([of[h] for h in known.tolist()], np.int64)
    types_of = np.zeros(CLASSES)
    total = 0
    for r in vocabulary.groupBy("kind").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect():
        types_of[r["kind"]] = r["v"]
        total += r["n"]
    return ClassModel(known, n, kind, int(types_of.argmax()), total, int(types_of.sum()), types_of), vocabulary


def _hashes(scratch: Scratch, words: np.ndarray) -> DataFrame:
    return scratch.spark.createDataFrame(pa.table({"word": words}), "word long")


def _encoded(docs: DataFrame, model) -> DataFrame:
    """Counts of each text, its classes in order, and its rare words.

    A number of the sequence below CLASSES is a class, any other is CLASSES and the place of a rare word in `rare`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, kind = model.value
        codes = _Codes(_places(known))
        value, of_place = np.log10(np.append(counts, 0) + 1.0), np.append(kind, 0).astype(np.uint32)
        row, part = 0, TaskContext.get().partitionId()
        for batch in _parts(batches):
            code, lengths = codes.run_on(batch)
            code = code[1:]
            place = np.minimum(code, np.uint64(len(known))).astype(np.int64)
            at = np.cumsum(np.append(0, lengths))
            starts = at[:-1]
            logs = np.add.reduceat(value[place], starts)
            sequence = of_place[place]
            # rare words: distinct ones of each text, in order of text and hash
            rest = np.flatnonzero(place == len(known))
            text = np.repeat(np.arange(len(lengths)), lengths)[rest]
            order = np.lexsort((code[rest], text))
            t, h = text[order], code[rest][order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
            group = np.cumsum(new) - 1
            first = np.searchsorted(t[new], np.arange(len(lengths) + 1))
            sequence[rest[order]] = CLASSES + group - first[t]
            times = np.bincount(group, minlength=int(new.sum()))
            packed = []
            for s, e, rares in zip(at[:-1].tolist(), at[1:].tolist(), np.diff(first).tolist(), strict=True):
                packed.append(sequence[s:e].astype(np.uint8 if rares + CLASSES <= 256 else np.uint16 if rares + CLASSES <= 65_536 else np.uint32).tobytes())
            words = pa.StructArray.from_arrays([pa.array(signed(h[new])), pa.array(times)], names=["word", "times"])
            n_rare = np.bincount(text, minlength=len(lengths))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((part << 33) + row + np.arange(len(lengths))),
                    batch.column(0),
                    batch.column(1),
                    pa.array(lengths),
                    pa.array(lengths - n_rare),
                    pa.array(logs),
                    pa.array(packed, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), words),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_frequent", "logs", "sequence", "rare"],
            )
            row += len(lengths)
        released()

    return docs.select("doc_id", "held_out", F.col("text").cast("string")).mapInArrow(
        run,
        "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, logs double, sequence binary, "
        "rare array<struct<word:long,times:long>>",
    )


def _decoded(rows: DataFrame, unseen: int) -> DataFrame:
    """`classes`, a byte per token, from the sequence and the rare words found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.arange(CLASSES, dtype=np.uint8)
        for batch in _parts(batches):
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023,E731
            n, rares, raw = column("n_tokens").to_pylist(), column("n_words").to_pylist(), column("sequence").to_pylist()
            found = column("found")
            lengths = found.value_lengths().fill_null(0).to_pylist()
            flat = found.flatten()
            place, kind = (np.array(flat.field(k)) for k in (0, 1))
            out, s = [], 0
            for i, x in enumerate(raw):
                of = np.concatenate([base, np.full(rares[i], unseen, np.uint8)])
                of[CLASSES + place[s : s + lengths[i]]] = kind[s : s + lengths[i]]
                s += lengths[i]
                out.append(of[np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(x) // n[i]])].tobytes())
            kept = [batch.column(k) for k in range(6)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.binary())], names=[*batch.schema.names[:6], "classes"])
        released()

    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "logs", "base_score", "n_words", "sequence", "found").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, base_score double, classes binary"
    )


def _flat(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes before, classes, and the first token of each text of a batch with `classes` last; texts begin behind an end."""
    raw = batch.column(batch.num_columns - 1).to_pylist()
    now = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    starts = np.cumsum([0, *map(len, raw[:-1])])
    return np.append(end, now[:-1]), now, starts


def class_bigrams(resolved: DataFrame, end: int) -> np.ndarray:
    """Counts of neighbouring classes over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in _parts(batches):
            last, now, _ = _flat(batch, end)
            total += np.bincount(last * CLASSES + now, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    got = resolved.select("classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES * CLASSES)
    out[np.array(got["pair"], np.int64)] = np.array(got["n"], np.int64)
    return out.reshape(CLASSES, CLASSES)


def score(docs: DataFrame, model: ClassModel, vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """docs(doc_id, held_out, text) -> n_tokens, n_known, train_tokens, base_score, score of every row.

    Class bigrams are counted over the rows that are not held out.
    """
    sent = scratch.spark.sparkContext.broadcast((model.known, model.counts, model.kind))
    rows = scratch.table(_encoded(docs, sent), "encoded")
    rare = (
        rows.select("row", F.posexplode("rare").alias("place", "r"))
        .select("row", "place", "r.word", "r.times")
        .join(vocabulary.select("word", "n", "kind"), "word")
        .groupBy("row")
        .agg(
            F.sum("times").alias("n_rare"),
            F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"),
            F.collect_list(F.struct("place", "kind")).alias("found"),
        )
    )
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    base = math.log10(model.tokens + model.types + 1)
    joined = rows.withColumn("n_words", F.size("rare")).drop("rare").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        logs.alias("logs"),
        (logs - F.col("n_tokens") * base).alias("base_score"),
        "n_words",
        "sequence",
        F.coalesce("found", F.array().cast("array<struct<place:int,kind:int>>")).alias("found"),
    )
    resolved = scratch.table(_decoded(joined, model.unseen), "resolved")
    scratch.drop("encoded")
    end = int(model.kind[0]) if len(model.kind) else model.unseen
    between = class_bigrams(resolved.where(~F.col("held_out")), end)
    transition, emission = logs_of(between, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            last, now, starts = _flat(batch, end)
            total = np.add.reduceat(transition[last, now] - emission[now], starts)
            at = batch.schema.get_field_index("logs")
            total = pa.array(total + np.array(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 3, 5)), total], names=[*(batch.schema.names[k] for k in (0, 1, 2, 3, 5)), "score"])

    scored = resolved.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    train = F.lit(model.tokens).cast("long").alias("train_tokens")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", train, "base_score", "score")


def logs_of(between: np.ndarray, model: ClassModel) -> tuple[np.ndarray, np.ndarray]:
    """log10 of P(class | class before), and of each class's tokens with one added per word."""
    mass = between.sum(0) + model.types_of
    mass[model.unseen] += 1
    return np.log10(_smoothed(between)), np.log10(np.maximum(mass, 1))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op6")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    model, vocabulary = fit(docs.where(~F.col("held_out")), scratch)
    return score(docs, model, vocabulary, scratch)


QUERIES = {"op6_class_lm": op6_class_lm}
#: The model is fitted by an iterative search; tests hold counts, classes and scores against brute force.
ORACLE_SQL: dict[str, str] = {}
