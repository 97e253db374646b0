"""Best-two-fit packing of tokenised documents into sequences of fixed capacity."""

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialise
from .words import U64, span_hash

CAPACITY = 2048
END_ID = 0
SLOTS = 1 << 20
MOST_REMEMBERED = 4 << 20
SLICE_CHARS = 1 << 20
LETTER, NUMBER, SPACE, OTHER, UNSURE = 1, 2, 3, 4, 255


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def character_classes() -> np.ndarray:
    """Class of each code point as the vocabulary's pattern knows them; unassigned and beyond the BMP: unsure."""
    import regex

    table = np.full(0x110000, UNSURE, dtype=np.uint8)
    bmp = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    for pattern, kind in ((r"[^\p{Cn}]", OTHER), (r"\s", SPACE), (r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        table[[ord(c) for c in regex.findall(pattern, bmp)]] = kind
    return table


class Encoder:
    """Token ids of many texts; each distinct piece of text between split points is encoded once and remembered, and is compared with what is remembered.

    The vocabulary merges bytes only inside the pieces that its pattern splits off: contractions, runs of
    letters, numbers or other signs with one leading space, and white space. The splits are found for a whole
    slice of texts at once. Texts with characters of unsure class, or with the string of a special token, go through
    the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = character_classes()
        self._forget()

    def _forget(self) -> None:
        self.slot_hash = np.zeros(SLOTS, dtype=U64)
        self.slot_entry = np.zeros(SLOTS, dtype=np.int32)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.begin = np.zeros(1 << 16, dtype=np.int32)
        self.points = np.zeros(1 << 18, dtype=np.uint16)  # characters beyond the BMP are not remembered
        self.point_begin = np.zeros(1 << 16, dtype=np.int32)
        self.used = self.written = self.entries = 0

    def splits(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Starts of the pieces; ``at``: where the texts begin, and the end of the last."""
        kind = self.classes[points]
        n = len(points)
        new = np.ones(n, dtype=bool)
        new[1:] = kind[1:] != kind[:-1]
        text_start = np.zeros(n + 1, dtype=bool)
        text_start[at] = True
        new |= text_start[:-1]
        starts = new.copy()
        run = np.flatnonzero(new)
        end = np.append(run[1:], n)
        spaces = (kind[run] == SPACE) & ~text_start[end]
        last = end[spaces] - 1
        starts[last] = True
        starts[last[points[last] == 32] + 1] = False
        quote = np.flatnonzero((points == 39) & starts)
        quote = quote[(quote + 1 < n)]
        quote = quote[(kind[quote + 1] == LETTER) & ~text_start[quote + 1] & new[quote]]
        for i in quote.tolist():
            tail = points[i + 1 : i + 3].tolist()
            size = 1 if tail[0] in (115, 116, 109, 100) else 2 if tail in ([114, 101], [118, 101], [108, 108]) and not text_start[i + 2] else 0
            if size:
                starts[i + 1] = False
                if i + 1 + size < n:
                    starts[i + 1 + size] = True
        return np.flatnonzero(starts)

    def _learn(self, texts: list[str]) -> np.ndarray:
        """New entries for the pieces: their ids, and the pieces themselves."""
        got = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
        size = np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(texts))
        points = np.frombuffer("".join(texts).encode("utf-16-le"), dtype=np.uint16)
        while self.used + len(got.ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.written + len(points) > len(self.points):
            self.points = np.concatenate((self.points, np.zeros_like(self.points)))
        while self.entries + len(texts) + 1 > len(self.begin):
            self.begin, self.point_begin = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.point_begin))
        self.ids[self.used : self.used + len(got.ids)] = got.ids
        self.points[self.written : self.written + len(points)] = points
        fresh = self.entries + np.arange(len(texts))
        self.begin[fresh + 1] = self.used + np.cumsum(size)
        self.point_begin[fresh + 1] = self.written + np.cumsum([len(t) for t in texts])
        self.used += len(got.ids)
        self.written += len(points)
        self.entries += len(texts)
        return fresh

    def _others(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Pieces that are not the text of their entry, which has the same hash."""
        size, known = ends - starts, self.point_begin[entry].astype(np.int64)
        wrong = size != self.point_begin[entry + 1] - known
        to = np.concatenate(([0], np.cumsum(np.where(wrong, 0, size))))
        at = np.repeat(known - to[:-1], np.diff(to)) + np.arange(to[-1])
        here = points if not wrong.any() else points[np.repeat(starts - to[:-1], np.diff(to)) + np.arange(to[-1])]
        differ = np.flatnonzero(self.points[at] != here)
        wrong[np.searchsorted(to, differ, side="right") - 1] = True
        return np.flatnonzero(wrong)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        odd = np.zeros(len(texts), dtype=bool)
        odd[np.searchsorted(at, np.flatnonzero(self.classes[points] == UNSURE), side="right") - 1] = True
        for mark in self.special:
            if mark in whole:
                odd |= [mark in t for t in texts]
        if not odd.any():
            return self._remembered(whole, points, at)
        rest = ["" if o else t for o, t in zip(odd.tolist(), texts, strict=True)]
        ids, begin = self._remembered(text := "".join(rest), np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), np.concatenate(([0], np.cumsum([len(t) for t in rest]))))
        parts = np.split(ids, begin[1:-1])
        rows = np.flatnonzero(odd).tolist()
        for r, e in zip(rows, self.tokenizer.encode_batch_fast([texts[r] for r in rows], add_special_tokens=False), strict=True):
            parts[r] = np.array(e.ids, dtype=np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def _remembered(self, whole: str, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(points):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(at), dtype=np.int64)
        if max(self.used, self.written // 3) > MOST_REMEMBERED:
            self._forget()
        starts = self.splits(points, at)
        ends = np.append(starts[1:], len(points))
        hashes = span_hash(points, starts, ends)
        slot = (hashes & U64(SLOTS - 1)).astype(np.int64)
        entry = self.slot_entry[slot]
        miss = np.flatnonzero(self.slot_hash[slot] != hashes)
        if len(miss):
            fresh, first, place = np.unique(hashes[miss], return_index=True, return_inverse=True)
            pieces = [whole[b:e] for b, e in zip(starts[miss[first]].tolist(), ends[miss[first]].tolist(), strict=True)]
            new = self._learn(pieces)
            at_slot = (fresh & U64(SLOTS - 1)).astype(np.int64)
            self.slot_hash[at_slot], self.slot_entry[at_slot] = fresh, new
            entry[miss] = new[place]
        # hashes of unlike pieces may be equal: these get entries of their own, which no hash leads to
        others = self._others(points, starts, ends, entry)
        if len(others):
            entry[others] = self._learn([whole[b:e] for b, e in zip(starts[others].tolist(), ends[others].tolist(), strict=True)])
        begin = self.begin[entry].astype(np.int64)
        size = self.begin[entry + 1] - begin
        to = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(begin - to[:-1], size) + np.arange(to[-1])]
        return ids, to[np.searchsorted(starts, at)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker, whatever the number of its tasks."""
    return Encoder(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            column = batch.column(1).fill_null("")
            ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_CHARS, side="right")))
                keys, texts = batch.column(0).slice(lo, hi - lo).cast(pa.int64()).to_pylist(), column.slice(lo, hi - lo).to_pylist()
                ids, at = encode(texts)
                rows = []
                for key, b, e in zip(keys, at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = np.empty(e - b + 1, dtype="<u4")
                    own[:-1], own[-1] = ids[b:e], end_id
                    first = (len(own) - 1) % capacity + 1
                    cuts = [0, *range(first, len(own) + 1, capacity)]
                    for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((key, i, x, y - x, zlib.crc32(own[x:y].data), own[x:y].tolist() if keep_ids else None))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
                n = 6 if keep_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds[:n], strict=True)], names=names[:n])
                lo = hi

    return docs.select(id_col, text_col).mapInArrow(run, PIECES + ", ids array<int>" * keep_ids)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many such bins) for a histogram of lengths.

    A bin is filled greedily with the largest length that still fits. Then its smallest is taken out if two
    unpacked ones together fill the wider gap better; of such pairs the one that leaves least is put in. The
    same filling serves as many bins as the histogram allows, so the work depends on the number of distinct lengths.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    while len(have := np.flatnonzero(left)):
        own: Counter[int] = Counter()
        gap = capacity
        spare = left.copy()
        while len(fit := have[: np.searchsorted(have, gap, side="right")]):
            fit = fit[spare[fit] > 0]
            if not len(fit):
                break
            length = int(fit[-1])
            n = min(gap // length, int(spare[length]))
            own[length] += n
            spare[length] -= n
            gap -= n * length
        if gap:
            least = min(own)
            wide = gap + least
            pool = have[spare[have] > 0]
            pool = pool[pool < wide]
            if len(pool):
                other = np.searchsorted(pool, wide - pool, side="right") - 1
                ok = other >= 0
                a, b = pool[ok], pool[other[ok]]
                twice = (a == b) & (spare[a] < 2)
                lower = np.where(twice & (other[ok] > 0), pool[np.maximum(other[ok] - 1, 0)], b)
                total = np.where(twice & (other[ok] == 0), 0, a + lower)
                if len(total) and total.max() > least:
                    i = int(total.argmax())
                    own[least] -= 1
                    own[int(a[i])] += 1
                    own[int(lower[i])] += 1
                    own = +own
        times = min(int(left[length]) // n for length, n in own.items())
        for length, n in own.items():
            left[length] -= n * times
        bins.append((sorted(own.elements(), reverse=True), times))
    return bins


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence that holds each and its place there.

    A document is its token ids, as the vocabulary's tokenizer gives them without special tokens around the text, and ``end_id``; null is the empty text, which has one piece of one id. Only
    documents longer than ``capacity`` are cut, the first piece takes what is over. Columns: ``PIECES`` (and
    ids on demand), sequence_id, offset. Only the histogram of lengths (at most ``capacity`` numbers) reaches
    the driver, and a table of places no longer than the fillings found from it goes back. Pieces of one length
    are numbered by hashed buckets, so a length that a third of all rows share is no single task's work. Rows that
    repeat an id are separate documents.
    """
    found = tokenised_pieces(docs, path or tokenizer_file(), id_col, text_col, capacity, end_id, keep_ids)
    columns = found.columns
    # rows that repeat all their columns, such as empty texts of null id, are spread by the salt
    pieces = materialise(found.withColumn("salt", (F.monotonically_increasing_id() % 4096).cast("int")), "pieces")
    histogram = {r.length: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    sequence, taken, places = 0, Counter(), []
    for lengths, times in best_two_fit(histogram, capacity):
        offset = 0
        for length in lengths:
            places.append((length, taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    places.sort()
    wide = U64(1 << 48)
    keys = np.array([p[0] for p in places], dtype=U64) * wide + np.array([p[1] for p in places], dtype=U64)
    first, sequence_at, offset_at = (np.array([p[i] for p in places], dtype=np.int64) for i in (1, 2, 3))

    buckets = max(1, sum(histogram.values()) // 4000)
    bucketed = pieces.withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32, salt), {buckets})"))
    before = (
        bucketed.groupBy("length", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
        .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    ranked = (
        bucketed.withColumn("nth", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "salt")) - 1)
        .join(before, ["length", "bucket"])
        .select(*columns, (F.col("nth") + F.col("before")).alias("nth"))
    )

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, nth: pa.Array) -> pa.Array:
        a, b = (np.asarray(x.to_numpy(zero_copy_only=False), dtype=np.int64) for x in (length, nth))
        i = np.searchsorted(keys, a.astype(U64) * wide + b.astype(U64), side="right") - 1
        return pa.StructArray.from_arrays([pa.array(sequence_at[i] + b - first[i]), pa.array(offset_at[i])], names=["sequence_id", "offset"])

    return ranked.withColumn("place", place("length", "nth")).select(*columns, "place.sequence_id", "place.offset")
