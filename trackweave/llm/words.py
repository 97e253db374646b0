"""Array arithmetic on batches of texts: words, word hashes, shingles.

A word is a maximal run of characters other than ASCII non-alphanumerics, after A-Z became a-z:
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. In UTF-8 every byte of a non-ASCII character counts as a word byte,
so words can be found on bytes. All functions work on slices of a few MB, so that memory stays bounded by the
slice or by the longest single text.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 2 << 20
SHINGLE = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def is_word(lower: np.ndarray) -> np.ndarray:
    """Which bytes of lower-cased UTF-8 belong to words."""
    return _IS_WORD[lower]


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, dtype=U64), _BASE_INV: np.ones(1, dtype=U64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_powers[base]) < n:
        table = np.full(max(n, 1 << 16), base, dtype=U64)
        table[0] = 1
        _powers[base] = np.multiply.accumulate(table)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, so that all bits of a hash depend on all bits of ``h``."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[start:end]`` for many spans, from one prefix sum."""
    prefix = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values.astype(U64, copy=False) * powers(_BASE, len(values)), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * powers(_BASE_INV, len(values) + 1)[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of the texts ``row .. row + n_texts`` of a batch; ``first[i] .. first[i+1]`` are those of text i."""

    row: int
    raw: np.ndarray
    lower: np.ndarray
    text_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.first) - 1

    def hashes(self) -> np.ndarray:
        return span_hash(self.lower, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, offsets) for runs of texts of about ``limit`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, at, data = texts.buffers()
    at = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def find_words(row: int, raw: np.ndarray, at: np.ndarray) -> Words:
    lower = _LOWER[raw]
    inside = _IS_WORD[lower]
    n = len(raw)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < n]
    begins[edge] = inside[edge]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edge = at[1:][at[1:] > 0] - 1
    stops[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    return Words(row, raw, lower, at, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, at))


def batch_words(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Words]:
    for row, raw, at in text_slices(texts, limit):
        yield find_words(row, raw, at)


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text and, for each text, where its windows begin.

    A text of 1 to k-1 words has one window, of all its words; a text without words has none.
    """
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(n)))
    starts = np.repeat(first[:-1] - begin[:-1], n) + np.arange(begin[-1])
    ends = starts + np.repeat(np.minimum(counts, k), n)
    return span_hash(hashes, starts, ends), begin


def distinct_sets(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and where each text's begin."""
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], np.searchsorted(owner[keep], np.arange(len(begin)))


def shingle_sets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the k-word shingles of each text, sorted, and where each text's begin."""
    return distinct_sets(*windows(words.hashes(), words.first, k))
