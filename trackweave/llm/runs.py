"""Periodic runs of words: minimisers at scales of powers of two, and direct scans for short periods."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import SLICE_BYTES, U64, mix

SHORT = 8
SEED = U64(0x13198A2E03707344)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
OUT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def short_runs(ids: np.ndarray, stop: np.ndarray, least: int, exponent: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, length, period) of all maximal stretches of period 1 to SHORT; ``stop``: where each word's text ends."""
    found = []
    for q in range(1, min(SHORT, len(ids) - 1) + 1):
        equal = np.zeros(len(ids) - q + 2, dtype=bool)
        equal[1:-1] = (ids[:-q] == ids[q:]) & (np.arange(q, len(ids)) < stop[:-q])
        edge = np.flatnonzero(equal[1:] != equal[:-1])
        start, length = edge[::2], edge[1::2] - edge[::2] + q
        long = length >= max(least, exponent * q)
        found.append((start[long], length[long], np.full(int(long.sum()), q)))
    return found


def minimiser_places(names: np.ndarray, stop: np.ndarray, scale: int) -> np.ndarray:
    """Places whose name has the smallest hash of some ``scale`` neighbouring places (the leftmost of equal ones), all inside one text.

    The name of a place stands for the ``2 * scale`` words from there, so equal windows choose corresponding places.
    """
    low, place = mix(names.astype(U64) ^ SEED), np.arange(len(names))
    step = 1
    while step < scale:
        right = low[step:] < low[:-step]
        low, place = np.where(right, low[step:], low[:-step]), np.where(right, place[step:], place[:-step])
        step *= 2
    place = place[np.arange(len(place)) + 3 * scale - 1 <= stop[: len(place)]]
    return place[np.concatenate(([True], place[1:] != place[:-1]))] if len(place) else place


def extended(ids: np.ndarray, at: int, period: int, known: int, low: int, high: int) -> tuple[int, int]:
    """The largest stretch of ``ids[low:high]`` around ``at`` that repeats itself after ``period`` words, of which ``known`` words are known to."""
    end, size = at + known, 64
    while end + period < high:
        n = min(size, high - period - end)
        same = ids[end : end + n] == ids[end + period : end + period + n]
        if not same.all():
            end += int(same.argmin())
            break
        end, size = end + n, size * 2
    start, size = at, 64
    while start > low:
        n = min(size, start - low)
        same = (ids[start - n : start] == ids[start - n + period : start + period])[::-1]
        if not same.all():
            start -= int(same.argmin())
            break
        start, size = start - n, size * 2
    return start, end + period


def periodic_runs(ids: np.ndarray, first: np.ndarray, least: int = 6, exponent: int = 4) -> tuple[np.ndarray, ...]:
    """(text, start in the text, length, smallest period) of every run of the texts ``ids[first[i] : first[i + 1]]``, by text, start and period.

    A run of period q in (P, 2P] holds 4q words, so two windows of P places, q apart, lie inside it; places are named by the 2P words that follow.
    Equal windows have corresponding minimisers, and inside a run a name comes back after q places at the earliest. Each minimiser is therefore paired with the next
    one of its name, and pairs P to 2P apart are extended; a text where no minimiser's name comes back has no runs of longer periods either. Names are exact (a pair of two names of half the length), as are the comparisons.
    """
    if exponent < 4:
        raise ValueError("runs hold their period four times or more")
    sizes = np.diff(first)
    stop = np.repeat(first[1:], sizes)
    found = short_runs(ids, stop, least, exponent)
    # texts long enough for the scale, put together; ``origin``: where each came from
    scale, names, width, texts = SHORT, ids, 1, np.arange(len(sizes))
    at = first[:-1]
    while len(texts := texts[sizes[texts] > exponent * scale]):
        n = sizes[texts]
        here = np.concatenate(([0], np.cumsum(n)))
        names = names[np.repeat(at[texts] - here[:-1], n) + np.arange(here[-1])]
        own = ids if len(texts) == len(sizes) else ids[np.repeat(first[texts] - here[:-1], n) + np.arange(here[-1])]
        own_stop = np.repeat(here[1:], n)
        while width < 2 * scale:
            pairs = names.astype(np.int64)
            pairs[:-width] = pairs[:-width] * (int(names.max()) + 1) + names[width:]
            names, width = pd.factorize(pairs)[0], 2 * width
        place = minimiser_places(names, own_stop, scale)
        place = place[np.argsort(names[place], kind="stable")]
        gap = np.diff(place)
        again = (names[place[1:]] == names[place[:-1]]) & (own_stop[place[1:]] == own_stop[place[:-1]])
        pair = again & (gap > scale) & (gap <= 2 * scale)
        seeds = np.stack((gap[pair], place[:-1][pair]), axis=1)
        rows, last, until = [], 0, 0
        for period, p in seeds[np.lexsort((seeds[:, 1], seeds[:, 0]))].tolist():
            if period == last and p < until - period:
                continue
            text = int(np.searchsorted(here, p, side="right")) - 1
            start, until = extended(own, p, period, width, int(here[text]), int(here[text + 1]))
            last = period
            if until - start >= max(least, exponent * period):
                rows.append((first[texts[text]] + start - here[text], until - start, period))
        if rows:
            found.append(tuple(np.array(rows, dtype=np.int64).T))
        at = np.zeros(len(sizes), dtype=np.int64)
        at[texts] = here[:-1]
        texts = texts[np.unique(np.searchsorted(here, place[1:][again], side="right") - 1)]
        scale *= 2
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 4
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # a stretch that is also periodic by a multiple of its smallest period was found under both
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    text = np.searchsorted(first, start, side="right") - 1
    return text, start - first[text], length, period


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """Periodic runs of words of every text, one row per row: the id, n_words, runs and the text without the repeats.

    A word is a maximal run of characters other than ASCII white space. A run is a stretch of words with smallest period q, at least ``least`` and
    ``exponent * q`` words long, that no neighbouring word extends; runs come by start, then period. ``collapsed`` joins by one space the words that no run holds after its first q words.
    Null is the empty text, which has no words and no runs. Each row is judged alone, whatever its id and its other columns hold, so rows that repeat give repeated results,
    nothing is shuffled, and memory is bounded by a slice of a few MB or the longest single text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lo, size = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                texts.append((text.as_py() or "").encode())
                size += len(texts[-1])
                if size >= SLICE_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), *described(texts)], names=[id_col, "n_words", "runs", "collapsed"])
                    texts, lo, size = [], i + 1, 0

    def described(texts: list[bytes]) -> list[pa.Array]:
        words = [t.split() for t in texts]  # bytes split at ASCII white space
        first = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        flat = np.empty(first[-1], dtype=object)
        flat[:] = [x for w in words for x in w]
        text, start, length, period = periodic_runs(pd.factorize(flat)[0], first, least, exponent)
        bounds = np.searchsorted(text, np.arange(len(words) + 1))
        for i in np.unique(text).tolist():
            drop = np.zeros(len(words[i]), dtype=bool)
            for s, n, q in zip(*(x[bounds[i] : bounds[i + 1]].tolist() for x in (start, length, period)), strict=True):
                drop[s + q : s + n] = True
            words[i] = [words[i][j] for j in np.flatnonzero(~drop).tolist()]
        runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(RUN))
        return [pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), pa.array([b" ".join(w).decode() for w in words], pa.string())]

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {OUT}")
