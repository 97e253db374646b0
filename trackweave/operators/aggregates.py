"""Summaries, histograms, percentiles and correlations."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import TILE, bin_of
from .selection import medians, nth_by_group
from .windows import call_peaks, numbered

REDUCERS = {
    "max": lambda v, p: F.max(v),
    "min": lambda v, p: F.min(v),
    "mean": lambda v, p: F.avg(v),
    "sum": lambda v, p: F.sum(v),
    "median": lambda v, p: F.median(v),
    "count": lambda v, p: F.count(v),
    "first": lambda v, p: F.min_by(v, p),
    "last": lambda v, p: F.max_by(v, p),
    "sample": lambda v, p: F.max_by(v, p),
}


def reducer(name: str | Callable[[np.ndarray], float], value: str = "value", pos: str = "pos") -> Column:
    """An aggregate by name, or by any function of an array that gives a number; ``last`` and ``sample`` take the value at the largest position.

    A function gets the values of a group that are not null in order of position, and is not asked about groups without any, whose aggregate is null. It sees a group whole, so groups must
    fit into a task. Groups are gathered by Spark and come to Python many at a time, as a batch for each small group would cost far more than the function.
    """
    if not callable(name):
        return REDUCERS[name](value, pos)

    @F.arrow_udf("double")
    def reduced(groups: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(groups).to_numpy(zero_copy_only=False))]).astype(np.int64)
        values = groups.flatten().to_numpy(zero_copy_only=False)
        return pa.array([float(name(values[a:b])) if b > a else None for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.float64())

    v = F.col(value).cast("double")
    known = F.collect_list(F.when(v.isNotNull() & ~F.isnan(v), F.struct(F.col(pos).alias("p"), v.alias("v"))))
    return reduced(F.transform(F.array_sort(known), lambda x: x.v))


def summary(track: DataFrame, value: str = "value") -> DataFrame:
    return track.agg(F.sum(value).alias("total"), F.max(value).alias("highest"), F.min(value).alias("lowest"), F.avg(value).alias("average"), F.stddev_samp(value).alias("deviation"))


def with_whole(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates per chromosome and, as chromosome ``whole``, over all."""
    return df.rollup("chrom").agg(*aggregates).withColumn("chrom", F.coalesce("chrom", F.lit("whole")))


def nth_values(df: DataFrame, column: str, *places: Column) -> DataFrame:
    """One row: the values at 0-based places of the sorted column, nulls left out; ``places`` are expressions of ``n``, the number of values."""
    found = nth_by_group(df, [], column, *places)
    return found.agg(*[F.min(F.when(F.col("i") == i, F.col("value"))).alias(f"v{i}") for i in range(len(places))])


def middle_percent(df: DataFrame, column: str, percent: float) -> DataFrame:
    """(low, high): limits that hold the middle ``percent`` of the sorted values, by index."""
    cut = F.floor(F.col("n") * (100 - percent) / 200)
    return nth_values(df, column, cut, F.col("n") - 1 - cut).select(F.col("v0").alias("low"), F.col("v1").alias("high"))


def null_model(track: DataFrame, percent: float = 10.0) -> DataFrame:
    """(median, deviation) of the null model: the lower half of every k-th value, mirrored about the median, k = 100 / percent."""
    k = int(100 / percent)
    taken = numbered(track, ["chrom"], bin_of(F.col("pos"), TILE), "pos").filter(F.col("nth") % k == 0)
    half = nth_values(taken, "value", F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    middle = half.select(((F.col("v0") + F.col("v1")) / 2).alias("median"))
    low = taken.join(F.broadcast(middle), F.col("value") < F.col("median"))
    mirrored = low.select("median", F.explode(F.array(F.col("value"), 2 * F.col("median") - F.col("value"))).alias("x"))
    return mirrored.agg(F.first("median").alias("median"), F.stddev_samp("x").alias("deviation"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal half-open bins of [low, high); empty bins count 0, values outside are left out."""
    width = (high - low) / bins
    counts = df.filter((F.col(column) >= low) & (F.col(column) < high)).groupBy(F.floor((F.col(column) - low) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return spine.join(counts, "bin", "left").select("bin", (F.col("bin") * width + low).alias("start"), F.coalesce("n", F.lit(0)).alias("n"))


def _moments(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").filter("v is not null")
    return long, long.groupBy("name").agg(F.sum("v").alias("total"), F.avg("v").alias("average"), F.stddev_samp("v").alias("deviation"), (F.avg("v") + F.stddev_samp("v")).alias("cutoff"))


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: total, average, median, deviation and cut-off (average + deviation); missing values are left out."""
    long, moments = _moments(df, columns)
    return moments.join(medians(long, ["name"], "v", "middle"), "name").select("name", "total", "average", "middle", "deviation", "cutoff")


def matrix_regions(matrix: DataFrame, column: str, span: int, cutoff: float | None = None, min_length: int = 10_000, max_gap: int = 2000) -> DataFrame:
    """Regions of a matrix (chrom, start, ...) where a column reaches the cut-off, its mean plus deviation if none is given; missing values are left out."""
    track = matrix.select("chrom", F.col("start").alias("pos"), F.col(column).cast("double").alias("value")).filter("value is not null")
    limit = _moments(matrix, [column])[1].select("cutoff") if cutoff is None else matrix.sparkSession.range(1).select(F.lit(cutoff).alias("cutoff"))
    high = track.join(F.broadcast(limit), F.col("value") >= F.col("cutoff")).select("chrom", "pos", "value")
    return call_peaks(high, float("-inf"), min_length=min_length, max_gap=max_gap, span=span)


def combined_regions(matrix: DataFrame, cutoffs: dict[str, float], least: int, span: int, min_length: int = 10_000, max_gap: int = 2000) -> DataFrame:
    """Regions of a matrix (chrom, start, ...) where at least ``least`` columns reach their cut-offs, as ``call_peaks`` gives them; score is the largest number that do. Missing values do not."""
    calls = sum((F.coalesce(F.col(c) >= limit, F.lit(False)).cast("double") for c, limit in cutoffs.items()), F.lit(0.0))
    return call_peaks(matrix.select("chrom", F.col("start").alias("pos"), calls.alias("value")), least, min_length=min_length, max_gap=max_gap, span=span)


SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def correlation_matrix(tracks: DataFrame, track: str = "track", cells: int = 1 << 20) -> DataFrame:
    """Pearson correlation of every two tracks (track, chrom, pos, value) over their common positions: a, b, n, r.

    Positions are dealt to tasks. A task puts some of them at a time, at most ``cells`` values, into a matrix of tracks by positions and adds up its products, so that it sends one row
    a pair of tracks and no row a pair of values. Values are taken from their track's mean first, so that sums do not cancel. Null and NaN values are missing; values
    that repeat at a position pair with each of the other track. Tracks of constant values have no correlation (null).
    """
    known = tracks.select(F.col(track).alias("t"), "chrom", "pos", F.col("value").cast("double").alias("v")).filter("v is not null and not isnan(v)")
    means = known.groupBy("t").agg(F.avg("v").alias("m"))
    centred = known.join(means, "t").select("t", "chrom", "pos", (F.col("v") - F.col("m")).alias("v"))

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number: dict = {}
        total = {s: np.zeros((0, 0)) for s in SUMS}

        def add(held: list[pd.DataFrame]) -> None:
            f = pd.concat(held)
            for t in f["t"].unique():
                number.setdefault(t, len(number))
            grown = len(number) - len(total["n"])
            for s in SUMS:
                total[s] = np.pad(total[s], (0, grown))
            rows = f["t"].map(number).to_numpy()
            place = pd.factorize(pd.MultiIndex.from_frame(f[["chrom", "pos"]]))[0]
            own, at = np.unique(rows, return_inverse=True)
            n, x, q = (np.zeros((len(own), place.max() + 1)) for _ in range(3))
            for m, v in ((n, 1.0), (x, f["v"].to_numpy()), (q, f["v"].to_numpy() ** 2)):
                np.add.at(m, (at, place), v)
            cross = np.ix_(own, own)
            for s, y in zip(SUMS, (n @ n.T, x @ n.T, n @ x.T, q @ n.T, n @ q.T, x @ x.T), strict=True):
                total[s][cross] += y

        held, size = [], 0
        for f in frames:
            held.append(f)
            size += len(f)
            if size >= cells:
                f = pd.concat(held)
                # the last position may go on in the next batch
                last = (f["chrom"] == f["chrom"].iloc[-1]) & (f["pos"] == f["pos"].iloc[-1])
                if not last.all():
                    add([f[~last]])
                held, size = [f[last]], int(last.sum())
        if size:
            add(held)
        names = sorted(number)
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        at = [(number[a], number[b]) for a, b in pairs]
        yield pd.DataFrame({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], **{s: [total[s][i, j] for i, j in at] for s in SUMS}}).query("n > 0")

    kind = known.schema["t"].dataType.simpleString()
    dealt = centred.repartition("chrom", "pos").sortWithinPartitions("chrom", "pos")
    parts = dealt.mapInPandas(products, f"a {kind}, b {kind}, {', '.join(f'{s} double' for s in SUMS)}")
    sums = parts.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in SUMS])
    n = F.col("n")
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt((F.col("sxx") - F.col("sx") ** 2 / n) * (F.col("syy") - F.col("sy") ** 2 / n))
    varied = (F.col("sxx") - F.col("sx") ** 2 / n > 1e-14 * F.col("sxx")) & (F.col("syy") - F.col("sy") ** 2 / n > 1e-14 * F.col("syy"))
    return sums.select("a", "b", n.cast("long").alias("n"), F.when(varied, r).alias("r"))


def confidence_95(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(column).alias("average"), (F.stddev_samp(column) * 1.96 / F.sqrt(F.count(column))).alias("half_width"))


def z_scores(df: DataFrame, column: str) -> DataFrame:
    """Missing values stay missing."""
    s = df.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    return df.join(F.broadcast(s), F.lit(True)).withColumn("z", (F.col(column) - F.col("__m")) / F.col("__s")).drop("__m", "__s")
