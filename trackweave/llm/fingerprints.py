"""Threshold-scaled document sketches: every shingle hash below a fixed fraction of the hash range."""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SHINGLE, U64, batch_words, distinct_sets, windows

FRACTION = 1 / 8
LEAST = 32
ALL = 2**64 - 1


@dataclass
class Sketches:
    """Sorted retained hashes of each text, where each text's begin, and the largest hash that each would have retained."""

    values: np.ndarray
    begin: np.ndarray
    top: np.ndarray

    def take(self, rows: np.ndarray) -> "Sketches":
        return Sketches(*take(self.values, self.begin, rows), self.top[rows])

    def hex(self) -> list[str]:
        """Per text the largest hash it would have retained and all it has, 16 digits each; the empty string for a text without words."""
        text, tops = self.values.astype(">u8").tobytes().hex(), self.top.tolist()
        return [f"{t:016x}{text[16 * b : 16 * e]}" if e > b else "" for t, b, e in zip(tops, self.begin[:-1].tolist(), self.begin[1:].tolist(), strict=True)]


def sketches(texts: pa.Array, fraction: float = FRACTION, k: int = SHINGLE) -> Sketches:
    """Retained is every hash of a k-word shingle below ``fraction`` of the range, so sketches of parts merge by union.

    A text with fewer than LEAST of these is retained below the smallest of the fractions 1/2, 1/4, ... above ``fraction`` that gives
    LEAST hashes, or as a whole. Two sketches are compared below the smaller of their limits, which each carries.
    """
    tops = [ALL]
    while tops[-1] + 1 > fraction * 2**64:
        tops.append(max(((tops[-1] + 1) >> 1) - 1, int(fraction * 2**64) - 1))
    base = U64(tops[-1])
    parts: list[Sketches] = []
    for words in batch_words(texts):
        hashes, begin = windows(words.hashes(), words.first, k)
        n = len(begin) - 1
        low = hashes <= base
        owner = np.repeat(np.arange(n), np.diff(begin))
        values, at = distinct_sets(hashes[low], np.concatenate(([0], np.cumsum(np.bincount(owner[low], minlength=n)))))
        top = np.full(n, base)
        few = np.diff(at) < LEAST
        rows = np.flatnonzero(few)
        if len(rows):
            every, every_at = distinct_sets(*take(hashes, begin, rows))
            of = np.repeat(np.arange(len(rows)), np.diff(every_at))
            own_top = np.full(len(rows), U64(ALL))
            for t in tops[1:]:
                own_top[np.bincount(of[every <= U64(t)], minlength=len(rows)) >= LEAST] = U64(t)
            top[rows] = own_top
            keep = every <= own_top[of]
            of_value = np.repeat(np.arange(n), np.diff(at))
            values = np.concatenate((values[~few[of_value]], every[keep]))
            of_value = np.concatenate((of_value[~few[of_value]], rows[of[keep]]))
            values = values[np.argsort(of_value, kind="stable")]
            at = np.concatenate(([0], np.cumsum(np.bincount(of_value, minlength=n))))
        parts.append(Sketches(values, at, top))
    if not parts:
        return Sketches(np.zeros(0, dtype=U64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=U64))
    sizes = np.concatenate([np.diff(x.begin) for x in parts])
    return Sketches(np.concatenate([x.values for x in parts]), np.concatenate(([0], np.cumsum(sizes))), np.concatenate([x.top for x in parts]))


def take(values: np.ndarray, begin: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments ``rows`` of a ragged array, in that order."""
    size = begin[rows + 1] - begin[rows]
    at = np.concatenate(([0], np.cumsum(size)))
    return values[np.repeat(begin[rows] - at[:-1], size) + np.arange(at[-1])], at


def likeness(a: Sketches, b: Sketches) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard, containment of a in b) of the i-th sketches of both, below their common limit; two empty ones are equal."""
    top = np.minimum(a.top, b.top)
    n = len(top)
    owner = np.concatenate((np.repeat(np.arange(n), np.diff(a.begin)), np.repeat(np.arange(n), np.diff(b.begin))))
    values = np.concatenate((a.values, b.values))
    below = values <= top[owner]
    na, nb = (np.bincount(o, minlength=n) for o in (owner[: len(a.values)][below[: len(a.values)]], owner[len(a.values) :][below[len(a.values) :]]))
    values, owner = values[below], owner[below]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    union = np.bincount(owner[new], minlength=n)
    both = na + nb - union
    blank = (np.diff(a.begin) == 0) & (np.diff(b.begin) == 0)
    return np.where(blank, 1.0, both / np.maximum(union, 1)), np.where(blank, 1.0, both / np.maximum(na, 1))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """doc_id, n_chars and the fingerprint (``Sketches.hex``) of every text; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.as_py()) for x in texts], pa.int64()), pa.array(sketches(texts, fraction).hex(), pa.string())],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"


def order_keys(ids: pa.Array, ties: pa.Array) -> np.ndarray:
    """17 bytes a row that sort as descending id, null ids last, then rising hash of the text."""
    sign = U64(1 << 63)
    out = np.zeros((len(ids), 17), dtype=np.uint8)
    out[:, 0] = ids.is_null().to_numpy(zero_copy_only=False)
    out[:, 1:9] = (~(ids.fill_null(0).to_numpy(zero_copy_only=False).view(U64) ^ sign)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 9:] = (ties.to_numpy(zero_copy_only=False).view(U64) ^ sign).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def neighbour_blocks(docs: DataFrame, id_col: str, text_col: str, per_block: int = 1000, most: int = 20_000, per_cut: int = 20) -> DataFrame:
    """Rows (block, ghost, doc_id, tie, text): contiguous ranges of about equal size of the rows by descending id and hash of the text.

    Each block also gets, as a ghost, the row that follows its last one (the first of the next block that has
    rows; for the last block the first row of all). The ranges are cut by a sample of about ``per_cut`` rows a block, ids and hashes
    only; it decides sizes and no result. At most ``per_cut * most`` sampled pairs, within chance, and ``most`` block starts reach the driver, however many
    rows or null ids there are. Above ``per_block * most`` rows the blocks grow; they are read as sorted streams. Rows that repeat both id and text share a block.
    """
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), tie.alias("tie"))
    rows = docs.count()
    n = min(most, max(1, rows // per_block))
    cuts = np.zeros(0, dtype="S17")
    if n > 1:
        chosen = ids.sample(min(1.0, per_cut * n / rows), seed=10).toArrow()
        held = np.sort(order_keys(*(c.combine_chunks() for c in chosen.columns)))
        cuts = np.unique(held[np.arange(1, n) * len(held) // n]) if len(held) else cuts

    def block_of(ids: pa.Array, ties: pa.Array) -> np.ndarray:
        return np.searchsorted(cuts, order_keys(ids, ties), side="right")

    @F.arrow_udf("long")
    def block(ids: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array(block_of(ids, ties))

    firsts = ids.groupBy(block("doc_id", "tie").alias("b")).agg(F.max(F.struct("doc_id", F.bitwise_not("tie").alias("tie"))).alias("top")).collect()
    tops = {r.b: (r.top.doc_id, ~r.top.tie) for r in firsts}
    order = sorted(tops)
    before = {b: order[i - 1] for i, b in enumerate(order)}

    @F.arrow_udf("array<long>")
    def places(ids: pa.Array, ties: pa.Array) -> pa.Array:
        out = []
        for b, i, t in zip(block_of(ids, ties).tolist(), ids.to_pylist(), ties.to_pylist(), strict=True):
            out.append([2 * b, 2 * before[b] + 1] if (i, t) == tops[b] else [2 * b])
        return pa.array(out, pa.list_(pa.int64()))

    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), tie.alias("tie"))
    return held.select(F.explode(places("doc_id", "tie")).alias("place"), "doc_id", "tie", "text").select(
        F.expr("place div 2").alias("block"), F.expr("place % 2").alias("ghost"), "doc_id", "tie", "text"
    )


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    The next document is the one with the next smaller id (after the last: the first); rows that share an id
    follow each other by a hash of their text, null ids come last. The edited text has the last
    floor(n_chars / 2) code points replaced by the first as many (or all) of the next document. Null counts as
    empty; a text without words has an empty fingerprint, and two empty ones have likeness 1. One row per row.
    """
    blocks = neighbour_blocks(docs, id_col, text_col)

    def pairs(rows: list[tuple]) -> pa.RecordBatch | None:
        own = np.array([i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]], dtype=np.int64)
        if not len(own):
            return None
        texts = [r[3] for r in rows]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own.tolist()]
        plain = sketches(pa.array(texts, pa.large_string()), fraction)
        after = sketches(pa.array(edited, pa.large_string()), fraction)
        mine = plain.take(own)
        near_edited, in_edited = likeness(mine, after)
        near_next, in_next = likeness(mine, plain.take(own + 1))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in own.tolist()], pa.int64()),
                pa.array([len(texts[i]) for i in own.tolist()], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(mine.hex(), pa.string()),
                pa.array(after.hex(), pa.string()),
                *(pa.array(x, pa.float64()) for x in (near_edited, near_next, in_edited, in_next)),
            ],
            names=[x.split()[0] for x in OUT.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).fill_null("").to_pylist(), strict=True):
                held.append(row)
                size += len(row[3])
                if size > 4 << 20 and len(held) > 1:
                    if (out := pairs(held)) is not None:
                        yield out
                    held, size = held[-1:], len(row[3])
        if (out := pairs(held)) is not None:
            yield out

    dealt = blocks.repartition("block").sortWithinPartitions("block", "ghost", F.desc("doc_id"), "tie")
    return dealt.select("block", "ghost", "doc_id", "text").mapInArrow(run, OUT)
