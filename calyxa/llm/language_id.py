"""Language identification by unigram pieces, summed over all segmentations.

A fixed public vocabulary of pieces gives, for each language, a distribution over
pieces.  The probability of a word is the sum over all ways to cut it into pieces (the
forward algorithm); that of a text is the product over its words.  Piece probabilities
are learnt by expectation maximisation on the word counts of each language.

Learning takes about MAX_DOCS documents of each language, chosen by a hash of doc_id,
whole texts each; every text is scored whole.  The forward algorithm runs on all distinct new words of an
Arrow batch at once, and a task remembers the words it has met.  Words of over LONG characters
(texts without spaces are one word) are summed in logarithms, so their length has no bound.

Languages are learnt and scored BLOCK at a time, which bounds what is broadcast; with more
than BLOCK of them, each block scans the texts once and a row's best of all blocks counts.

Edge cases: texts that are null or hold no letter (as str.isalpha tells) are `und` with score 0, as are
all texts if there was nothing to learn from; ties go to the first language by name; very long
texts are scored whole; null languages teach nothing; repeated rows are answered row by row;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyxa.llm.class_lm import crc_mod
from calyxa.llm.scratch import Scratch
from calyxa.llm.words import mix

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MAX_DOCS = 4_000
#: Languages of one model.
BLOCK = 64
ROUNDS = 3
#: Characters up to which the product of the least probabilities is a double.
LONG = 32
FLOOR = 1e-7
#: Word scores that a task remembers (numbers, all languages together).
REMEMBERED = 3_000_000
_WORD_SIGN = re.compile(r"[^\W\d_]")
_STEP = np.uint64(0x100000001B3)


def pieces_of(path: str) -> list[str]:
    """The pieces of the vocabulary, without control pieces and single bytes."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    return [sp.id_to_piece(i) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def _mixed(h: int) -> int:
    """`mix` of one 64-bit number."""
    m = 2**64 - 1
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & m
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & m
    return h ^ (h >> 33)


def prefix_table(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Sorted hashes of all prefixes of pieces, the piece of each (-1 if it is none), the longest length, the number of pieces."""
    prefixes: dict[int, int] = {}
    for i, piece in enumerate(pieces):
        h = 0
        for k, c in enumerate(piece):
            h = ((h + ord(c) + 1) * int(_STEP)) & (2**64 - 1)
            key = _mixed(h)
            if k == len(piece) - 1:
                prefixes[key] = i
            else:
                prefixes.setdefault(key, -1)
    keys = np.array(sorted(prefixes), np.uint64)
    return keys, np.array([prefixes[k] for k in keys.tolist()], np.int32), max(map(len, pieces)), len(pieces)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORD_SIGN.finditer(text))


class Lattice:
    """Finds all pieces in many words at once; made from a prefix_table."""

    def __init__(self, keys: np.ndarray, piece: np.ndarray, longest: int, unknown: int):
        self.keys, self.piece, self.longest, self.unknown = keys, piece, longest, unknown

    def edges(self, words: list[str]):
        """(first position of each word, word of each position, from, to, piece) of the words' lattices.

        Word w has len + 1 positions; edges are ordered by their end's place in the word, then by end.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        first = np.concatenate([[0], np.cumsum(lengths + 1)])
        codes = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        left = np.repeat(lengths, lengths + 1) - (np.arange(len(codes)) - np.repeat(first[:-1], lengths + 1))
        start = np.flatnonzero(left > 0)
        h = np.zeros(len(start), np.uint64)
        src, dst, got = [], [], []
        for n in range(1, self.longest + 1):
            h = (h + codes[start + n - 1] + np.uint64(1)) * _STEP
            key = mix(h)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            piece = np.where(there, self.piece[at], -1)
            if n == 1:
                src.append(start), dst.append(start + 1), got.append(np.where(piece < 0, self.unknown, piece))
            else:
                full = piece >= 0
                src.append(start[full]), dst.append(start[full] + n), got.append(piece[full])
            go = there & (left[start] > n)
            start, h = start[go], h[go]
            if not len(start):
                break
        src, dst, got = map(np.concatenate, (src, dst, got))
        word = np.repeat(np.arange(len(words)), lengths + 1)
        place = dst - first[word[dst]]
        order = np.lexsort((dst, place))
        return first, word, src[order], dst[order], got[order], place[order]

    def _steps(self, place: np.ndarray):
        cut = np.flatnonzero(np.diff(place)) + 1
        return zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]]), strict=True)

    def forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log of the sum over segmentations, for each word and each column of p (piece x language)."""
        out = np.empty((len(words), p.shape[1]))
        lengths = np.array([len(w) for w in words])
        for long in (False, True):
            at = np.flatnonzero((lengths > LONG) == long)
            if not len(at):
                continue
            first, _, src, dst, piece, place = self.edges([words[i] for i in at])
            alpha = np.full((first[-1], p.shape[1]), -np.inf if long else 0.0)
            alpha[first[:-1]] = 0.0 if long else 1.0
            weights = np.log(p) if long else p
            for s, e in self._steps(place):
                d = dst[s:e]
                head = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
                if long:
                    alpha[d[head]] = _log_sums(alpha[src[s:e]] + weights[piece[s:e]], head)
                else:
                    alpha[d[head]] = np.add.reduceat(alpha[src[s:e]] * weights[piece[s:e]], head, axis=0)
            ends = alpha[first[1:] - 1]
            out[at] = ends if long else np.log(ends)
        return out

    def expected(self, words: list[str], lang: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts (piece x language) of words with a language and a count each."""
        out = np.zeros(p.shape)
        lengths = np.array([len(w) for w in words])
        for long in (False, True):
            at = np.flatnonzero((lengths > LONG) == long)
            if not len(at):
                continue
            first, word, src, dst, piece, place = self.edges([words[i] for i in at])
            of, times = lang[at][word[src]], n[at][word[src]]
            prob = p[piece, of]
            if long:
                weight = times * self._shares_of_long(first, word, src, dst, place, np.log(prob))
            else:
                alpha, beta = np.zeros(first[-1]), np.zeros(first[-1])
                alpha[first[:-1]] = 1.0
                for s, e in self._steps(place):
                    d = dst[s:e]
                    head = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
                    alpha[d[head]] = np.add.reduceat(alpha[src[s:e]] * prob[s:e], head)
                beta[first[1:] - 1] = 1.0
                # edges into an end are done once all edges out of it are: by the ends' places from last to first
                for s, e in list(self._steps(place))[::-1]:
                    np.add.at(beta, src[s:e], beta[dst[s:e]] * prob[s:e])
                weight = times * alpha[src] * prob * beta[dst] / alpha[first[1:] - 1][word[src]]
            np.add.at(out, (piece, of), weight)
        return out

    def _shares_of_long(self, first, word, src, dst, place, prob) -> np.ndarray:
        """Expected uses of each edge of a word, from logs of the edges' probabilities."""
        alpha, beta = np.full(first[-1], -np.inf), np.full(first[-1], -np.inf)
        alpha[first[:-1]] = beta[first[1:] - 1] = 0.0
        for s, e in self._steps(place):
            d = dst[s:e]
            head = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
            alpha[d[head]] = _log_sums((alpha[src[s:e]] + prob[s:e])[:, None], head)[:, 0]
        start = src - first[word[src]]
        order = np.lexsort((src, -start))
        for s, e in self._steps(-start[order]):
            k = order[s:e]
            head = np.concatenate([[0], np.flatnonzero(np.diff(src[k])) + 1])
            beta[src[k[head]]] = _log_sums((beta[dst[k]] + prob[k])[:, None], head)[:, 0]
        return np.exp(alpha[src] + prob + beta[dst] - alpha[first[1:] - 1][word[src]])


def _log_sums(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    """log of the sum of exp of each run of rows that begins at head."""
    most = np.maximum.reduceat(x, head, axis=0)
    sizes = np.diff(np.append(head, len(x)))
    return most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, sizes, axis=0)), head, axis=0))


def _marked(text: str) -> list[str]:
    return ["▁" + w for w in text.split()]


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, text) -> (lang, word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update((lang, w) for w in _marked(text or ""))
            langs, words = zip(*held, strict=True) if held else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def languages(docs: DataFrame) -> dict[str, int]:
    """Documents of each language of docs(lang), by name."""
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {k: sizes[k] for k in sorted(sizes)}


def fit(docs: DataFrame, table: tuple, sizes: dict[str, int], scratch: Scratch, max_docs: int = MAX_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages, in order of name, and piece probabilities (piece x language) from docs(doc_id, lang, text).

    table: a prefix_table; p has one more row, for characters outside the vocabulary.  sizes: the
    documents of the languages to learn, which must be few enough for p to be broadcast.
    """
    sc = scratch.spark.sparkContext
    langs = sorted(sizes)
    size = table[-1] + 1
    p = np.full((size, len(langs)), 1 / size)
    if not langs:
        return langs, p
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, max_docs / sizes[k]))])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    chosen = docs.where(F.col("lang").isin(langs)).where(chance < share[F.col("lang")])
    counts = scratch.table(_word_counts(chosen), "lang-words")
    place = {k: i for i, k in enumerate(langs)}
    sent = sc.broadcast(table)
    for _ in range(ROUNDS):
        model = sc.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(*sent.value), np.zeros(model.value.shape)
            for batch in batches:
                lang = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
                total += lattice.expected(batch.column(1).to_pylist(), lang, np.array(batch.column(2)), model.value)
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["piece", "lang", "n"])

        got = counts.mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        new = np.full(p.shape, 0.05)
        new[np.array(got["piece"], np.int64), np.array(got["lang"], np.int64)] += np.array(got["n"], np.float64)
        p = np.maximum(new / new.sum(axis=0), FLOOR)
        model.unpersist()
    return langs, p


def score(docs: DataFrame, table: tuple, langs: list[str], p: np.ndarray, scratch: Scratch) -> DataFrame:
    """docs(row, doc_id, held_out, text) -> row, doc_id, held_out, lang_pred, best, whole.

    best is the log likelihood of the best of these languages, whole the log of the sum of
    all; lang_pred is null for texts without letters.
    """
    sent = scratch.spark.sparkContext.broadcast((table, langs, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, langs, p = sent.value
        lattice = Lattice(*table)
        room = max(1000, REMEMBERED // max(1, len(langs)))
        seen: dict[str, int] = {}
        scores = np.zeros((room, len(langs)))
        for batch in batches:
            texts = batch.column(3).to_pylist()
            pred, best, whole = [], [], []
            for i in range(0, len(texts), 256):
                some = [_marked(t) if t and langs and has_letter(t) else [] for t in texts[i : i + 256]]
                met = dict.fromkeys(chain.from_iterable(some))
                new = [w for w in met if w not in seen and len(w) <= LONG]
                if len(seen) + len(new) > room:
                    seen.clear()
                    new = [w for w in met if len(w) <= LONG]
                    if len(new) > room:
                        room = len(new)
                        scores = np.zeros((room, len(langs)))
                for k in range(0, len(new), 20_000):
                    part = new[k : k + 20_000]
                    at = len(seen)
                    scores[at : at + len(part)] = lattice.forward(part, p)
                    seen.update((w, at + j) for j, w in enumerate(part))
                for ws in some:
                    if not ws:
                        pred.append(None), best.append(0.0), whole.append(0.0)
                        continue
                    try:
                        total = scores[np.fromiter(map(seen.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                    except KeyError:  # long words are summed one at a time and not remembered: they may be whole texts
                        total = scores[np.array([seen[w] for w in ws if len(w) <= LONG], np.int64)].sum(axis=0)
                        for w in ws:
                            if len(w) > LONG:
                                total = total + lattice.forward([w], p)[0]
                    k = int(np.argmax(total))
                    pred.append(langs[k]), best.append(float(total[k])), whole.append(float(total[k] + np.log(np.exp(total - total[k]).sum())))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(pred, pa.string()), pa.array(best, pa.float64()), pa.array(whole, pa.float64())],
                names=["row", "doc_id", "held_out", "lang_pred", "best", "whole"],
            )

    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(
        run, "row long, doc_id long, held_out boolean, lang_pred string, best double, whole double"
    )


def identify(docs: DataFrame, table: tuple, scratch: Scratch) -> DataFrame:
    """docs(doc_id, held_out, lang, text) -> doc_id, held_out, lang_pred, score of every row; learns from rows not held out."""
    train = docs.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = languages(train)
    names, rows = list(sizes), docs.withColumn("row", F.monotonically_increasing_id())
    scored = []
    for i in range(0, max(1, len(names)), BLOCK):
        block = {k: sizes[k] for k in names[i : i + BLOCK]}
        langs, p = fit(train, table, block, scratch)
        scored.append(score(rows, table, langs, p, scratch))
        if len(names) > BLOCK:
            scored[-1] = scratch.table(scored[-1], f"block-{i}")
    done = scored[0]
    if len(scored) > 1:
        # a row's best block; of equals that of the first languages
        each = F.struct(F.col("best").alias("best"), (-F.col("block")).alias("first"), "lang_pred", "doc_id", "held_out")
        numbered = scored[0].withColumn("block", F.lit(0))
        for k, more in enumerate(scored[1:], 1):
            numbered = numbered.union(more.withColumn("block", F.lit(k)))
        top = numbered.groupBy("row").agg(F.max(each).alias("m"), F.collect_list("whole").alias("wholes"))
        odds = F.aggregate("wholes", F.lit(0.0), lambda a, w: a + F.exp(w - F.col("m.best")))
        done = top.select("m.doc_id", "m.held_out", "m.lang_pred", "m.best", (F.col("m.best") + F.log(odds)).alias("whole"))
    return done.select(
        "doc_id",
        "held_out",
        F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"),
        F.when(F.col("lang_pred").isNotNull(), F.exp(F.col("best") - F.col("whole"))).otherwise(0.0).alias("score"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
        (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
    )
    return identify(docs, prefix_table(pieces_of(vocabulary)), Scratch(spark, "op9"))


QUERIES = {"op9_language_id": op9_language_id}
#: The model is learnt by expectation maximisation; tests hold the sums against all segmentations and the accuracy on held-out rows.
ORACLE_SQL: dict[str, str] = {}
