"""Words of whole texts and 64-bit hashes of them, for Arrow batches in Python workers.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; only A-Z is lower-cased.
Both are what ``bytes.split`` and ``bytes.lower`` do on UTF-8.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CACHE_WORDS = 150_000
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def split_words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


#: Rows of a batch that are Python objects at a time.
ROWS_AT_ONCE = 512


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of ROWS_AT_ONCE rows, without copies."""
    return (batch.slice(i, ROWS_AT_ONCE) for i in range(0, batch.num_rows, ROWS_AT_ONCE))


def column_bytes(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column."""
    at = batch.schema.get_field_index(name)
    for part in slices(batch):
        yield from part.column(at).cast(pa.binary()).to_pylist()


def released() -> None:
    """Give memory that is free again back to the system; a worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the murmur3 finaliser)."""
    x = x ^ (x >> _S)
    x = x * _M1
    x = x ^ (x >> _S)
    x = x * _M2
    return x ^ (x >> _S)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for at most CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words (none if there are fewer)."""
    if len(hashes) < n:
        return hashes[:0]
    last = len(hashes) - n + 1
    out = mix(hashes[:last] + np.uint64(n))
    for i in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + last])
    return out


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; of fewer words the whole sequence is the only one."""
    if not len(hashes):
        return hashes
    return np.unique(ngram_hashes(hashes, min(n, len(hashes))))


def signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)
