"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .words import U64, text_slices

ORDER = 3
BITS = 16
MOST_LABELS = 20_000
LOST = 0.003
LENGTH = 200
SMOOTHING = 1.0
SLICE = 1 << 19


def ngram_buckets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of texts in one byte array, and where each text's begin."""
    code = np.zeros(len(raw), dtype=U64)
    for k in range(ORDER):
        code[: max(0, len(raw) - k)] |= raw[k:].astype(U64) << U64(8 * k)
    bucket = ((code * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS)).astype(np.int64)
    n = np.maximum(np.diff(at) - ORDER + 1, 0)
    begin = np.concatenate(([0], np.cumsum(n)))
    return bucket[np.repeat(at[:-1] - begin[:-1], n) + np.arange(begin[-1])], begin


@dataclass
class Model:
    """Log ratio of target to raw probability per bucket, and the least resampling key of a document that stays."""

    weights: np.ndarray
    least: float = -np.inf

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Mean log ratio of each text's n-grams; 0 for a text shorter than an n-gram."""
        out = np.zeros(len(texts))
        for row, raw, at in text_slices(texts, SLICE):
            bucket, begin = ngram_buckets(raw, at)
            total = np.concatenate(([0.0], np.cumsum(self.weights[bucket])))[begin]
            n = np.diff(begin)
            out[row : row + len(n)] = np.diff(total) / np.maximum(n, 1)
        return out


def score_column(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts))

    return score(text)


def noise(key: Column) -> Column:
    """A standard Gumbel variate that depends on the id alone, so that reruns agree; null ids share one."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(20), key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def label_sample(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled ids, chosen by a hash: id, good, and whether it serves to fit (else to set the cut-off)."""
    rows = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    h = F.xxhash64(F.lit(7), "doc_id")
    n = rows.count()
    if n > 2 * most:  # only hashes that can be among the smallest ``most`` leave their tasks
        rows = rows.filter(h <= F.lit(int(-(2**63) + 1.5 * most / n * 2**64)))
    return rows.orderBy(h, "doc_id").limit(most).select(F.col("doc_id").alias("__label"), (F.col("quality") > 0).alias("good"), (F.expr("pmod(xxhash64(11, doc_id), 2)") == 0).alias("fit"))


def ngram_models(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Log ratios per bucket: counts of all texts make the raw model, those of good labelled ones the target model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_n, good_n = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            target = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for row, raw, at in text_slices(batch.column(0), SLICE):
                bucket, begin = ngram_buckets(raw, at)
                raw_n += np.bincount(bucket, minlength=1 << BITS)
                own = np.repeat(target[row : row + len(at) - 1], np.diff(begin))
                good_n += np.bincount(bucket[own], minlength=1 << BITS)
        used = np.flatnonzero(raw_n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw_n[used]), pa.array(good_n[used])], names=["bucket", "raw", "good"])

    fitted = sample.select("__label", (F.col("fit") & F.col("good")).alias("target"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    marked = texts.join(F.broadcast(fitted), F.col("__id") == F.col("__label"), "left").select("__text", "target")
    counts = marked.mapInArrow(run, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.full(1 << BITS, SMOOTHING), np.full(1 << BITS, SMOOTHING)
    raw[counts.bucket] += counts.raw
    good[counts.bucket] += counts.good
    if not counts.good.sum():
        return np.zeros(1 << BITS)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest finite value (the least if there are fewer), by histograms of ever narrower ranges; ranges of 1024 counts reach the driver."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if lo is None or k <= 0:
        return np.inf
    if k >= n:
        return lo
    while hi > lo:
        width = (hi - lo) / 1024
        if width <= abs(hi) * 1e-15:
            break
        spot = F.least(F.floor((F.col(column) - lo) / width), F.lit(1023))
        bins = df.filter(F.col(column).between(lo, hi)).groupBy(spot.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for b in sorted(bins, key=lambda r: -r.b):
            if k <= b["n"]:
                lo, hi = b.lo, b.hi
                break
            k -= b["n"]
    return lo


def resampling_key(score: Column, id_: Column) -> Column:
    """Log importance weight of LENGTH n-grams of the text plus Gumbel noise."""
    return score * LENGTH + noise(id_.cast("long"))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labels: int = MOST_LABELS, lost: float = LOST, k: int | None = None
) -> tuple[Model, DataFrame]:
    """The model and the scored rows (doc_id, score, key, kept) of all of ``docs``.

    Raw and target text are multinomial models over hashed byte n-grams; score is a document's mean log ratio of the two. The
    log importance weight of the whole text would grow with its length, so that length alone decided; weights are those of LENGTH n-grams of
    the text instead. The key is this log weight plus a standard Gumbel variate, so the ``k`` largest keys are a sample without replacement
    in proportion to the weights. Without a given ``k`` it is the number of documents whose score reaches the cut-off below which a share
    ``lost`` of the good labelled documents lies that were not used to fit. At most ``most_labels`` labels serve both; raw counts,
    scores and k cover all documents. Ties at the last key all stay, and so do repeated rows together. Null is the empty text (score 0);
    without good labels every score is 0 and, where no ``k`` is given, all stay. Labels with null id or quality are left out; an id labelled
    more than once is good if any says so.
    """
    sample = materialise(label_sample(labels, most_labels), "labels")
    model = Model(ngram_models(docs, sample, id_col, text_col))
    score = score_column(model, F.coalesce(F.col(text_col), F.lit("")))
    scored = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), score.alias("score")).withColumn("key", resampling_key(F.col("score"), F.col("doc_id"))), "scores")
    if k is None:
        held = sample.filter("good and not fit").select("__label")
        least = scored.join(F.broadcast(held), F.col("doc_id") == F.col("__label")).groupBy("__label").agg(F.min("score").alias("score"))
        good = np.sort([r.score for r in least.select("score").collect()])
        cutoff = good[int(len(good) * lost)] if len(good) else -np.inf
        k = scored.filter(F.col("score") >= F.lit(float(cutoff))).count()
    model.least = kth_largest(scored, "key", k)
    return model, scored.withColumn("kept", F.col("key") >= F.lit(float(model.least)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that the sample takes (``fit_quality``), with all columns.

    Texts are scored once more instead of shuffled, by the same model, so each row is judged by its own id and text: rows with null or
    repeated ids, too. Other columns are passed on unseen.
    """
    model, _ = fit_quality(docs, labels, id_col, text_col, k=k)
    key = resampling_key(score_column(model, F.coalesce(F.col(text_col), F.lit(""))), F.col(id_col))
    return docs.filter(key >= F.lit(float(model.least)))
