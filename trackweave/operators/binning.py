"""Bins, spines, samplers and gap filling over positions."""

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .aggregates import nth_values, reducer
from .ranges import TILE, bin_of, nearest, points_in, with_neighbours
from .selection import medians
from .windows import numbered


def bin_values(track: DataFrame, step: int, method: str | Callable[[np.ndarray], float] = "median") -> DataFrame:
    """One value per bin that has points: chrom, bin, value; medians of bins wider than a tile are found without gathering a bin."""
    if method == "median" and step > TILE:
        return medians(track.select("chrom", bin_of(F.col("pos"), step).alias("bin"), "value"), ["chrom", "bin"], "value", "value")
    return track.groupBy("chrom", bin_of(F.col("pos"), step).alias("bin")).agg(reducer(method).alias("value"))


def bin_spine(lengths: DataFrame, step: int) -> DataFrame:
    """All bins of chromosomes (chrom, length)."""
    return lengths.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), bin_of(F.col("length") - 1, step))).alias("bin"))


def bedgraph_bins(track: DataFrame, lengths: DataFrame, step: int, method: str = "median") -> DataFrame:
    """chrom, start, end, value of every bin; missing where a bin has no point."""
    bins = bin_spine(lengths, step).join(bin_values(track, step, method), ["chrom", "bin"], "left").join(lengths, "chrom")
    return bins.select("chrom", (F.col("bin") * step).alias("start"), F.least((F.col("bin") + 1) * step, F.col("length")).alias("end"), "value")


def chromosome_windows(lengths: DataFrame, size: int, step: int) -> DataFrame:
    """Windows that may overlap: chrom, start, end, nth."""
    w = lengths.select("chrom", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("nth", "start"))
    return w.select("chrom", "start", F.least(F.col("start") + size, F.col("length")).alias("end"), "nth")


def binned(df: DataFrame, x: str, y: str, edges: list[float], method: str = "mean", left_closed: bool = True) -> DataFrame:
    """y reduced by the bin of x, for all bins: bin, value, n; empty bins have a missing value. Method: as ``reducer``, or middle."""
    c = F.col(x)
    place = sum((F.when(c >= e if left_closed else c > e, 1).otherwise(0) for e in edges), F.lit(-1))
    rows = df.withColumn("bin", place).filter((F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1))
    if method == "middle":
        how = F.array_sort(F.collect_list(F.struct(c.alias("x"), F.col(y).alias("y"))))
        values = rows.groupBy("bin").agg(how.alias("all"), F.count(F.lit(1)).alias("n")).select("bin", F.get("all", F.floor(F.size("all") / 2).cast("int")).y.alias("value"), "n")
    else:
        values = rows.groupBy("bin").agg(reducer(method, y, x).alias("value"), F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(values, "bin", "left").select("bin", "value", F.coalesce("n", F.lit(0)).alias("n"))


def to_grid(pos: Column, resolution: int) -> Column:
    return (F.round(pos / resolution) * resolution + 1).cast("long")


def genome_grid(track: DataFrame, resolution: int) -> DataFrame:
    """Distinct grid coordinates of the points."""
    return track.select("chrom", to_grid(F.col("pos"), resolution).alias("pos")).distinct()


def peak_grid(peaks: DataFrame, resolution: int) -> DataFrame:
    """Grid points around the centre of each peak, a resolution apart, inside the peak: chrom, start, end, pos."""
    centre = F.floor((F.col("start") + F.col("end")) / 2)
    back, ahead = F.floor((centre - F.col("start")) / resolution), F.floor((F.col("end") - centre) / resolution)
    return peaks.select("chrom", "start", "end", F.explode(F.sequence(centre - back * resolution, centre + ahead * resolution, F.lit(resolution).cast("long"))).alias("pos"))


def region_background(regions: DataFrame, genome: DataFrame, resolution: int) -> DataFrame:
    """Per chromosome that both have, and as ``whole`` over these: grid points inside regions, grid points of the genome and their quotient: chrom, points, n, share."""
    inside = peak_grid(regions, resolution).groupBy("chrom").agg(F.count(F.lit(1)).alias("points"))
    both = genome_grid(genome, resolution).groupBy("chrom").agg(F.count(F.lit(1)).alias("n")).join(inside, "chrom")
    sums = both.rollup("chrom").agg(F.sum("points").alias("points"), F.sum("n").alias("n"))
    return sums.select(F.coalesce("chrom", F.lit("whole")).alias("chrom"), "points", "n", (F.col("points") / F.col("n")).alias("share"))


def first_per_grid(track: DataFrame, resolution: int) -> DataFrame:
    """The first value of each grid coordinate."""
    return track.groupBy("chrom", to_grid(F.col("pos"), resolution).alias("grid")).agg(F.min_by("value", "pos").alias("value")).withColumnRenamed("grid", "pos")


def next_on_grid(track: DataFrame, step: int, tile: int = TILE) -> DataFrame:
    """For each grid position from the first to the last point: the nearest point at or after it, each point once: chrom, pos, value."""
    ends = track.groupBy("chrom").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    grid = ends.select("chrom", F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias("pos"))
    marks = track.select("chrom", F.col("pos"))
    hit = nearest(grid.withColumn("pos", F.col("pos") - 1), marks, tile).select("chrom", F.col("after").alias("pos")).filter("pos is not null").distinct()
    return hit.join(track, ["chrom", "pos"]).select("chrom", "pos", "value")


def fill_gaps(track: DataFrame, resolution: int, fill: float = 0.0, tile: int = TILE) -> DataFrame:
    """The track and, in each gap wider than ``resolution``, points of value ``fill`` a resolution apart."""
    gap = with_neighbours(track, ("pos",), tile).filter(F.col("next.pos") - F.col("pos") > resolution)
    inner = gap.select("chrom", F.explode(F.sequence(F.col("pos") + resolution, F.col("next.pos") - 1, F.lit(resolution).cast("long"))).alias("pos"), F.lit(fill).alias("value"))
    return track.select("chrom", "pos", "value").unionByName(inner)


def zero_filled_segments(track: DataFrame, span: int, tile: int = TILE) -> DataFrame:
    """Segments (chrom, start, end, value) of ``span`` positions, cut where the next begins, and zeros in between."""
    rows = with_neighbours(track, ("pos",), tile).select("chrom", "pos", "value", F.col("next.pos").alias("next"))
    own = F.struct(F.col("pos").alias("start"), F.least(F.col("pos") + span, "next").alias("end"), F.col("value").alias("value"))
    gap = F.when(F.col("next") > F.col("pos") + span, F.array(own, F.struct((F.col("pos") + span).alias("start"), F.col("next").alias("end"), F.lit(0.0).alias("value"))))
    return rows.select("chrom", F.explode(F.coalesce(gap, F.array(own))).alias("s")).select("chrom", "s.start", "s.end", "s.value")


def hashed_order(*keys: Column) -> Column:
    """A reproducible random order: the MD5 of the keys."""
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]))


def sample_tags(tags: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """floor(n * share) tags of each (chrom, strand), chosen by a hash."""
    by = ["chrom", "strand"]
    order = hashed_order(F.lit(seed), F.col("pos"), F.col("tag_id"))
    n = tags.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(tags.withColumn("order", order), by, F.substring("order", 1, 3), "order", "pos", "tag_id")
    return placed.join(n, by).filter(F.col("nth") < F.floor(F.col("n") * share)).select(*tags.columns)


def median_gap(track: DataFrame, tile: int = TILE) -> DataFrame:
    gaps = with_neighbours(track, ("pos",), tile).select((F.col("next.pos") - F.col("pos")).alias("gap"))
    middle = nth_values(gaps, "gap", F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    return middle.select(((F.col("v0") + F.col("v1")) / 2).alias("gap"))


def random_regions(spark, lengths: DataFrame, n: int, size: int, seed: int = 1) -> DataFrame:
    """n regions of ``size``, placed uniformly over all chromosomes by hashed offsets: nth, chrom, start, end (relative to the chromosome)."""
    order = W.orderBy("chrom")
    bounds = lengths.withColumn("stop", F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("begin", F.col("stop") - F.col("length"))
    total = lengths.agg(F.sum("length").alias("total"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)
    drawn = spark.range(n).join(F.broadcast(total), F.lit(True)).select("id", F.floor(u * F.col("total")).cast("long").alias("at"))
    # all chromosomes end to end are one axis
    one = F.lit("all").alias("chrom")
    spans = bounds.select(one, F.col("begin").alias("start"), F.col("stop").alias("end"), F.col("chrom").alias("name"), "length")
    hit = points_in(spans, drawn.select(one, F.col("at").alias("pos"), "id"), TILE, closed=False)
    start = F.col("pos") - F.col("start")
    return hit.select(F.col("id").alias("nth"), F.col("name").alias("chrom"), start.alias("start"), F.least(start + size, F.col("length")).alias("end"))


def window_counts(tags: DataFrame, lengths: DataFrame, size: int, gap: int) -> DataFrame:
    """Tags (chrom, start, end) that lie wholly in each of the windows of ``size``, ``gap`` apart: chrom, nth, n; empty ones count 0."""
    pitch = size + gap
    spine = lengths.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / pitch))).alias("nth"))
    nth = F.floor(F.col("start") / pitch)
    inside = tags.withColumn("nth", nth).filter(F.col("end") <= F.col("nth") * pitch + size).groupBy("chrom", "nth").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(inside, ["chrom", "nth"], "left").select("chrom", "nth", F.coalesce("n", F.lit(0)).alias("n"))
