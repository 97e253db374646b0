"""Repeated passages by sparse suffixes at minimiser positions."""

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .words import U64, Words, batch_words, is_word, mix, span_hash

LEAST = 50
PREFIX = 20
TOP = U64(2**64 - 1)


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` of values[i : i + width] for all i where that fits."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def minimisers(hashes: np.ndarray, first: np.ndarray, least: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the suffixes to keep and the hashes of their first ``prefix`` words.

    Of every ``least`` consecutive words of one text the position with the smallest prefix hash is kept: the same in all texts that hold these words.
    """
    width = least - prefix + 1
    n = len(hashes)
    if n < least:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    starts = np.arange(n - prefix + 1)
    grams = mix(span_hash(hashes, starts, starts + prefix) ^ U64(0x243F6A8885A308D3))
    low = sliding(grams, width, np.minimum)
    text_end = np.repeat(first[1:], np.diff(first))[: len(low)]
    inside = np.arange(len(low)) + least <= text_end
    low = np.where(inside, low, U64(0))
    # position i is the smallest of some window iff the largest of the minima of the windows over it is its own
    padded = np.concatenate((np.zeros(width - 1, dtype=U64), low, np.zeros(width - 1, dtype=U64)))
    top = sliding(padded, width, np.maximum)[: len(grams)]
    keep = np.flatnonzero((top == grams) & (top > 0))
    return keep, grams[keep]


def sequence_keys(words: Words) -> np.ndarray:
    """128-bit digests of the word sequences, as two columns of signed numbers.

    Words are joined by one space and hashed whole: the polynomial hashes of spans, which are fine for a few words, meet on long regular sequences.
    """
    keep = is_word(words.lower)
    joined = np.where(keep, words.lower, np.uint8(32))
    later = np.ones(len(words.starts), dtype=bool)
    later[words.first[:-1][words.first[:-1] < len(later)]] = False
    keep[words.starts[later] - 1] = True
    at = np.concatenate(([0], np.cumsum(keep)))[words.text_at].tolist()
    data = memoryview(joined[keep])
    digests = b"".join(blake2b(data[b:e], digest_size=16).digest() for b, e in zip(at[:-1], at[1:], strict=True))
    return np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)


def retained(docs: DataFrame, least: int, prefix: int) -> DataFrame:
    """Rows (doc_id, row, k1, k2, n_words, grams, positions) of (doc_id, text, row)."""
    kind = "doc_id long, row long, k1 long, k2 long, n_words long, grams array<long>, positions array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch_words(batch.column(1)):
                hashes = words.hashes()
                keys = sequence_keys(words)
                at, grams = minimisers(hashes, words.first, least, prefix)
                cuts = np.searchsorted(at, words.first).astype(np.int32)
                local = at - np.repeat(words.first[:-1], np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.row, words.n_texts),
                        batch.column(2).slice(words.row, words.n_texts),
                        pa.array(keys[:, 0]),
                        pa.array(keys[:, 1]),
                        pa.array(words.counts().astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(grams.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(local.astype(np.int32))),
                    ],
                    names=[f.split()[0] for f in kind.split(", ")],
                )

    return docs.mapInArrow(run, kind)


def extensions(texts: DataFrame, least: int, prefix: int) -> DataFrame:
    """(window, doc_id, k1, at) of rows (doc_id, text, k1, positions): the runs of ``least`` words to which a suffix there extends, left and right."""
    width = least - prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch_words(batch.column(1)):
                hashes = words.hashes()
                keys = sequence_keys(words)[:, 0]
                lo, n = words.row, words.n_texts
                wanted = batch.column(2).slice(lo, n).to_numpy(zero_copy_only=False)
                lists = batch.column(3).slice(lo, n)
                size = np.diff(lists.offsets.to_numpy())
                text = np.repeat(np.arange(n), size)
                at = lists.flatten().to_numpy().astype(np.int64) + words.first[text]
                ok = keys[text] == wanted[text]
                at, text = at[ok], text[ok]
                mark = np.zeros(len(hashes) + 1, dtype=np.int32)
                begin = np.maximum(at - width, words.first[text])
                end = np.minimum(at, words.first[text + 1] - least) + 1
                some = end > begin
                np.add.at(mark, begin[some], 1)
                np.add.at(mark, end[some], -1)
                starts = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                owner = np.searchsorted(words.first, starts, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(span_hash(hashes, starts, starts + least).view(np.int64)),
                        batch.column(0).slice(lo, n).take(pa.array(owner)),
                        batch.column(2).slice(lo, n).take(pa.array(owner)),
                        pa.array((starts - words.first[owner]).astype(np.int32)),
                    ],
                    names=["window", "doc_id", "k1", "at"],
                )

    return texts.select("doc_id", "text", "k1", "positions").mapInArrow(run, "window long, doc_id long, k1 long, at int")


def split_join(rows: DataFrame, keys: DataFrame, key: str, hot: int = 1000) -> DataFrame:
    """``rows`` joined with ``keys`` (key, n, ...), where n is how many rows hold the key.

    Keys that hold more than one in ``hot`` of the rows, fewer than ``hot`` therefore, are broadcast, so their rows stay where they are; the others are dealt by key.
    """
    total = keys.agg(F.sum("n")).first()[0] or 0
    frequent = keys.filter(F.col("n") * hot > total).drop("n")
    rare = rows.join(F.broadcast(frequent.select(key)), key, "left_anti").join(keys.filter(F.col("n") * hot <= total).drop("n"), key)
    return rows.join(F.broadcast(frequent), key).unionByName(rare)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, prefix: int = PREFIX) -> DataFrame:
    """One row per maximal passage of at least ``least`` words that also stands in another document.

    Columns: doc_id, first_word and last_word (from 0, both in the passage), n_words, later (words of it whose windows stand in a document
    with a smaller id, so that removing these leaves one copy of each). Words are compared in lower case without signs.

    Texts of equal words are one class, of which the smallest id goes on; the others, and it, are repeated as a whole.
    Suffixes are kept where a content-selected minimiser stands, at least one in every ``least`` words. Those with equal first ``prefix`` words
    from different classes are candidates, which are extended left and right to all runs of ``least`` words around them; the runs found in two classes,
    merged where they overlap, are the passages. Equal prefixes and runs are found by grouping 64-bit hashes of them, not by comparing neighbours of
    a sorted array: the neighbour shares the longest text to the right, but another suffix may share more to the left, and a passage that begins there
    would be lost. No pairs are made: copies of a passage only meet in counts, whatever their number.

    Rows are documents of their own also where ids are null, which come last, or repeat; rows that repeat id and text are one class and all rank as its first.
    Documents of fewer words have no passage; null is the empty text.
    """
    id_, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    row = F.xxhash64(id_.isNull(), id_, text)
    rows = materialise(retained(docs.select(id_.alias("doc_id"), text.alias("text"), row.alias("row")), least, prefix), "suffixes")
    long = rows.filter(F.col("n_words") >= least)
    names = long.groupBy("k1", "k2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("name"), F.count(F.lit(1)).alias("copies"), F.first("grams").alias("grams"), F.first("positions").alias("positions"))
    classes = materialise(names.select("k1", "k2", "name.doc_id", "name.row", "copies", "grams", "positions"), "sequences")
    suffixes = classes.select("doc_id", "k1", "row", F.explode(F.arrays_zip("grams", "positions")).alias("s")).select("doc_id", "k1", "row", F.col("s.grams").alias("gram"), F.col("s.positions").alias("position"))
    recurring = suffixes.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("k1").alias("a"), F.max("k1").alias("b")).filter("a <> b").select("gram", "n")
    recurring = materialise(recurring, "prefixes")
    candidates = split_join(suffixes, recurring, "gram").groupBy("k1", "row", "doc_id").agg(F.collect_set("position").alias("positions"))
    texts = docs.select(row.alias("__row"), text.alias("text"))
    windows = materialise(extensions(candidates.join(texts, F.col("row") == F.col("__row")), least, prefix), "windows")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1")
    found = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min("k1").alias("a"), F.max("k1").alias("b"), F.min(rank).alias("least")).filter("a <> b")
    found = materialise(found.select("window", "n", F.col("least.k1").alias("least")), "runs")
    spots = split_join(windows, found, "window").select("k1", "at", (F.col("k1") != F.col("least")).alias("again"))

    @F.arrow_udf("array<struct<first:long,last:long,later:long>>")
    def merged(starts: pa.Array, again: pa.Array) -> pa.Array:
        out = []
        for s, a in zip(starts.to_pylist(), again.to_pylist(), strict=True):
            s = np.unique(np.array(s, dtype=np.int64))
            cut = np.flatnonzero(np.diff(s) >= least) + 1
            spans = []
            later = np.zeros(int(s[-1]) + least + 1, dtype=np.int64)
            a = np.array(a or [], dtype=np.int64)
            np.add.at(later, a, 1)
            np.add.at(later, a + least, -1)
            total = np.concatenate(([0], np.cumsum(np.cumsum(later) > 0)))
            for run in np.split(s, cut):
                b, e = int(run[0]), int(run[-1]) + least
                spans.append({"first": b, "last": e - 1, "later": int(total[e] - total[b])})
            out.append(spans)
        return pa.array(out, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("later", pa.int64())])))

    per_class = spots.groupBy("k1").agg(F.collect_set("at").alias("starts"), F.collect_set(F.when(F.col("again"), F.col("at"))).alias("again"))
    parts = classes.select("k1", "doc_id", "copies").join(per_class.select("k1", merged("starts", "again").alias("spans")), "k1")
    inner = parts.select(F.col("k1").alias("i1"), F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["later"]).alias("inner"))
    copied = classes.filter("copies > 1").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("row").alias("first_row"))
    whole = (
        long.join(copied, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
        .join(inner, F.col("k1") == F.col("i1"), "left")
        .select(
            "doc_id",
            F.lit(0).cast("long").alias("first"),
            (F.col("n_words") - 1).alias("last"),
            F.when(F.col("row") != F.col("first_row"), F.col("n_words")).otherwise(F.coalesce("inner", F.lit(0))).alias("later"),
        )
    )
    single = parts.filter("copies = 1").select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.first", "s.last", "s.later")
    return whole.unionByName(single).select("doc_id", F.col("first").alias("first_word"), F.col("last").alias("last_word"), (F.col("last") - F.col("first") + 1).alias("n_words"), "later")
