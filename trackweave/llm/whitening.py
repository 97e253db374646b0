"""Whitening of embeddings by the covariance of their distinct vectors."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .suffixes import split_join

STEP = 256
COMPONENTS = 4
LARGEST = 2**63 - 1


@dataclass
class Whitening:
    """``n``: total weight; per dimension the exact weighted ``sums``; unit eigenvectors as columns and their ``values``, falling; the covariance's ``trace``."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def size(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def varied(self) -> np.ndarray:
        """Which components have a variance beyond rounding."""
        return self.values > self.size * np.finfo(float).eps * max([0.0, *self.values[:1]])

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        k = min(components, self.size)
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = ((x - self.mean) @ self.vectors[:, :k]) / np.sqrt(np.maximum(self.values[:k], 0))
        return np.where(self.varied()[:k], scores, 0.0)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - sum)**2 over the dimensions, exactly; None beyond a long."""
        largest = self.n * max([0, *(int(abs(int(e))) for e in (x.min(initial=0), x.max(initial=0)))]) + max([0, *map(abs, self.sums)])
        if largest**2 * max(1, self.size) <= LARGEST:
            return ((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        wide = ((self.n * x.astype(object) - np.array(self.sums, dtype=object)) ** 2).sum(axis=1).tolist()
        return [int(d) if d <= LARGEST else None for d in wide]


def rows_of(lists: pa.Array, size: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size)


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", step: int = STEP) -> DataFrame:
    """(vec_id, x) of the rows whose vector is not null and holds finite numbers only; x: floor(``step`` * entry), as long."""
    kept = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c")).filter(
        F.col("c").isNotNull() & ~F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    )
    return kept.select("vec_id", F.transform("c", lambda c: F.floor(c * float(step))).alias("x"))


def exact_sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Total weight and weighted sum of each dimension of (x, weight): a row of partial sums per task, added as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for batch in batches:
            x, w = rows_of(batch.column(0), size), batch.column(1).to_numpy()
            n += int(w.sum())
            # halves of 32 bits times weights below 2**31 stay below the range of a sum of a batch, whatever the entries
            wide = int(np.abs(w).max(initial=0)) * max(1, len(w)) < 2**31
            high, low = (x >> 32, x & 0xFFFFFFFF) if wide else (x.astype(object) >> 32, x.astype(object) & 0xFFFFFFFF)
            total = [t + (int(h) << 32) + int(lo) for t, h, lo in zip(total, w @ high, w @ low, strict=True)]
        yield pa.RecordBatch.from_pylist([{"n": n, "i": i, "high": t >> 62, "low": t & (2**62 - 1)} for i, t in enumerate(total)], schema=pa.schema([(c, pa.int64()) for c in ("n", "i", "high", "low")]))

    big = "decimal(38,0)"
    parts = fit.select("x", "weight").mapInArrow(run, "n long, i long, high long, low long")
    found = {r.i: r for r in parts.groupBy("i").agg(*(F.sum(F.col(c).cast(big)).alias(c) for c in ("n", "high", "low"))).collect()}
    return (int(found[0].n) if found else 0), [(int(found[i].high) << 62) + int(found[i].low) for i in range(size)] if found else [0] * size


def scatter(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """Sum of weight * (x - mean)(x - mean)' over (x, weight): one centred matrix product a batch, one matrix a task, rows of these added by their number."""
    size = len(mean)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            centred = rows_of(batch.column(0), size) - mean
            total += (centred * batch.column(1).to_numpy()[:, None]).T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), rows_of(batch.column(1), size), strict=True):
                total[i] = total.get(i, 0.0) + row
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["i", "row"])

    kind = "i long, row array<double>"
    rows = fit.select("x", "weight").mapInArrow(products, kind).repartition("i").mapInArrow(add, kind).collect()
    return np.array([r.row for r in sorted(rows, key=lambda r: r.i)]).reshape(-1, size) if rows else np.zeros((size, size))


def fit_whitening(fit: DataFrame, size: int) -> Whitening:
    """Fit on (x, weight), x of ``size`` entries. Only sums, and the covariance of ``size`` squared entries, reach the driver."""
    n, sums = exact_sums(fit, size) if size else (0, [])
    if not n:
        return Whitening(n, sums, np.eye(size), np.zeros(size), 0.0)
    covariance = scatter(fit, np.array([s / n for s in sums])) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    # the entry of the largest size is positive
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(size)])
    return Whitening(n, sums, vectors, values, float(np.trace(covariance)))


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, weights: str = "one", step: int = STEP) -> DataFrame:
    """Whitened scores of every row with a whole vector: (vec_id, component, n, deviation, whitened, explained, identity_error).

    Vectors become longs x = floor(``step`` * entry). Equal x are one vector of the fit, with weight 1 (``weights`` "one") or as many as there are rows ("count"); n is the total weight.
    Each distinct vector is whitened once and joined back to its rows; vectors that hold over a thousandth of the rows are joined in place.
    identity_error is measured on the whitened vectors: the largest entry of their centred weighted covariance minus the identity.

    Rows whose vector is null or holds a null or a number that is not finite are left out. The commonest length of the vectors (of equally common ones the largest) is the fit's; a row with a vector of
    another length, or an empty one, is returned once, with null component, deviation, whitened and explained. Components without variance have whitened and explained 0 and do not
    count in identity_error, which is 0 if there is no other. A deviation beyond a long is null. Null and repeated ids are rows as any; entries beyond the range of a long become its ends; an empty table gives an empty result.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights are one or count")
    rows = whole_vectors(table, id_col, vector_col, step)
    distinct = materialise(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "vectors")
    common = distinct.groupBy(F.size("x").alias("size")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = common.size if common else 0
    fit = distinct.filter(F.size("x") == size).select("x", (F.lit(1) if weights == "one" else F.col("n")).cast("long").alias("weight"))
    fitted = fit_whitening(fit, size)
    k = min(components, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = np.diff(batch.column(0).offsets.to_numpy()) == size if size else np.zeros(batch.num_rows, dtype=bool)
            deviation, scores = [None] * batch.num_rows, [None] * batch.num_rows
            if fits.any():
                x = rows_of(batch.column(0).filter(pa.array(fits)), size)
                for i, d, s in zip(np.flatnonzero(fits).tolist(), fitted.deviations(x), fitted.whitened(x, components).tolist(), strict=True):
                    deviation[i], scores[i] = d, s
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(deviation, pa.int64()), pa.array(scores, pa.list_(pa.float64()))],
                names=["x", "n", "deviation", "scores"],
            )

    done = materialise(distinct.select("x", "n").mapInArrow(run, "x array<long>, n long, deviation long, scores array<double>"), "whitened")
    weight = F.lit(1) if weights == "one" else F.col("n")
    known = done.filter(F.col("scores").isNotNull())
    score = [F.col("scores")[i] for i in range(k)]
    varied = np.flatnonzero(fitted.varied()[:k]).tolist()
    error = 0.0
    if varied and fitted.n:
        means = known.agg(*(F.sum(s * weight) / fitted.n for s in score)).first()
        pairs = [(i, j) for i in varied for j in varied if i <= j]
        covariance = known.agg(*(F.sum((score[i] - means[i]) * (score[j] - means[j]) * weight) / fitted.n for i, j in pairs)).first()
        error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, covariance, strict=True))
    explained = [float(v / fitted.trace) if on else 0.0 for v, on in zip(fitted.values[:k], fitted.varied()[:k], strict=True)]
    shares = F.array(*map(F.lit, explained)) if explained else F.lit(None).cast("array<double>")
    back = split_join(rows, done, "x").select("vec_id", "deviation", F.posexplode_outer("scores").alias("at", "whitened"))
    return back.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
