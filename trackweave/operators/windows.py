"""Sequential operators over the positions of a track (chrom, pos, value): regions, extrema, sliding sums, gaps."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .greedy import choose
from .ranges import TILE, bin_of, merged, with_neighbours


def remove_redundant(track: DataFrame) -> DataFrame:
    """The largest value at each position."""
    return track.groupBy("chrom", "pos").agg(F.max("value").alias("value"))


def call_peaks(track: DataFrame, cutoff: float, up_limit: float | None = None, min_length: int = 200, max_gap: int = 50, span: int = 1, tile: int = TILE) -> DataFrame:
    """Regions where values reach the cut-off with gaps of at most ``max_gap``: chrom, start, end, summit, score, n.

    A region ends ``span`` after its last position and is kept if at least ``min_length`` long; summit is the first position of
    the largest value. Runs are found inside tiles of the axis; only those at a tile's edges are joined across tiles.
    """
    high = track.filter(F.col("value") >= cutoff) if up_limit is None else track.filter(F.col("value").between(cutoff, up_limit))
    best = F.struct(F.col("value").alias("value"), (-F.col("pos")).alias("at"))
    points = high.select("chrom", F.col("pos").alias("start"), F.col("pos").alias("end"), best.alias("best"), F.lit(1).cast("long").alias("n"))
    sums = [F.min("start").alias("start"), F.max("end").alias("end"), F.max("best").alias("best"), F.sum("n").alias("n")]
    whole = merged(points, sums, max_gap, tile)
    return whole.filter(F.col("end") - F.col("start") + span >= min_length).select(
        "chrom", "start", (F.col("end") + span).alias("end"), (-F.col("best.at")).alias("summit"), F.col("best.value").alias("score"), "n"
    )


def local_extrema(track: DataFrame, width: int, peaks: bool = True, tile: int = TILE) -> DataFrame:
    """Local maxima (or minima) that no higher (lower) one within ``width`` precedes in the greedy choice.

    A candidate rises before and falls after (plateaus count at their last point). Going along the axis, a candidate within ``width`` of
    the last chosen one replaces it if it is higher, else it is passed over. All tiles choose at once (``greedy``).
    """
    sign = 1 if peaks else -1
    steps = with_neighbours(track, tile=tile).filter(F.col("next").isNull() | (F.col("next.value") != F.col("value"))).select("chrom", "pos", "value")
    steps = with_neighbours(steps, tile=tile)
    found = steps.filter(((F.col("value") - F.col("prev.value")) * sign > 0) & ((F.col("value") - F.col("next.value")) * sign > 0)).select("chrom", "pos", "value")
    return choose(found.withColumn("worth", F.col("value") * sign), "pos", width, "worth", ["pos"], tile).drop("worth")


def sliding_sum(track: DataFrame, other: DataFrame, before: int, after: int) -> DataFrame:
    """Per point of ``track``: total of ``other`` within [pos - before, pos + after]; null where there is none.

    The axis is cut into blocks as wide as the neighbourhood, so that each neighbourhood is the end of one block and the begin of the next. Every block adds its values up from both
    sides, and a point asks for one total of each kind: the work grows with the rows and not with the width, and no value outside a neighbourhood ever enters its total, so that large values
    take nothing from small ones elsewhere and infinite ones stay where they are.
    """
    width, own = before + after + 1, F.col("pos")
    block = bin_of(own - before, width)
    # the neighbourhood is [pos - before, end of block) and [begin of the next block, pos + after]
    asked = F.explode(F.array(F.struct((own - before).alias("at"), F.lit(0).alias("side"), block.alias("block")), F.struct((own + after).alias("at"), F.lit(1).alias("side"), (block + 1).alias("block"))))
    a = track.select("chrom", "pos", "value", asked.alias("x")).select("chrom", "pos", "value", "x.*", F.lit(None).cast("double").alias("weight"))
    none = F.lit(None)
    b = other.select("chrom", none.cast("long").alias("pos"), none.cast("double").alias("value"), own.alias("at"), none.cast("int").alias("side"), bin_of(own, width).alias("block"), F.col("value").cast("double").alias("weight"))
    by = W.partitionBy("chrom", "block")
    up, down = (by.orderBy(o).rangeBetween(W.unboundedPreceding, W.currentRow) for o in (F.asc("at"), F.desc("at")))
    summed = a.unionByName(b).withColumns({"low": F.sum("weight").over(up), "high": F.sum("weight").over(down)}).filter("side is not null")
    # points that repeat have equal totals and are spread again
    both = summed.groupBy("chrom", "pos", "value").agg(F.max(F.when(F.col("side") == 0, F.col("high"))).alias("high"), F.max(F.when(F.col("side") == 1, F.col("low"))).alias("low"), F.count_if(F.col("side") == 0).alias("c"))
    total = F.when(F.col("high").isNull(), F.col("low")).when(F.col("low").isNull(), F.col("high")).otherwise(F.col("high") + F.col("low"))
    return both.select("chrom", "pos", "value", total.alias("total"), F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("copy")).drop("copy")


def fill_missing(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Missing values between two present ones become the mean of both."""
    near = with_neighbours(df, tile=tile)
    return near.select("chrom", "pos", F.coalesce("value", (F.col("prev.value") + F.col("next.value")) / 2).alias("value"))


def fill_forward(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Missing values take the last present one before them on the chromosome; those before the first stay missing."""
    keyed = df.withColumns({"value": F.when(~F.isnan("value"), F.col("value")), "tile": bin_of(F.col("pos"), tile)})
    ends = keyed.groupBy("chrom", "tile").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("pos"))).alias("final"))
    earlier = F.last("final", True).over(W.partitionBy("chrom").orderBy("tile").rowsBetween(W.unboundedPreceding, -1))
    own = F.last("value", True).over(W.partitionBy("chrom", "tile").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    filled = keyed.withColumn("own", own).join(ends.select("chrom", "tile", earlier.alias("earlier")), ["chrom", "tile"])
    return filled.select("chrom", "pos", F.coalesce("own", "earlier").alias("value"))


def numbered(df: DataFrame, keys: list[str], block: Column, *order: str | Column) -> DataFrame:
    """Rows with ``nth``, their number from 0 by ``order`` among those of equal ``keys``.

    ``block`` must not fall along the order. Rows are numbered inside blocks and go on from the counts of the blocks before, so the work is
    spread by blocks and not by keys.
    """
    keyed = df.withColumn("block", block)
    counts = keyed.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    inner = keyed.withColumn("nth", F.row_number().over(W.partitionBy(*keys, "block").orderBy(*order)) - 1)
    both = inner.join(counts.select(*keys, "block", F.coalesce(before, F.lit(0)).alias("before")), [*keys, "block"])
    return both.select(*df.columns, (F.col("nth") + F.col("before")).alias("nth"))


def running_total(track: DataFrame, tile: int = TILE) -> DataFrame:
    """Sum of all values up to each position: inside tiles, plus the totals of the tiles before."""
    keyed = track.withColumn("tile", bin_of(F.col("pos"), tile))
    totals = keyed.groupBy("chrom", "tile").agg(F.sum("value").alias("t"))
    before = F.sum("t").over(W.partitionBy("chrom").orderBy("tile").rowsBetween(W.unboundedPreceding, -1))
    inner = keyed.withColumn("part", F.sum("value").over(W.partitionBy("chrom", "tile").orderBy("pos")))
    both = inner.join(totals.withColumn("before", F.coalesce(before, F.lit(0.0))), ["chrom", "tile"])
    return both.select("chrom", "pos", "value", (F.col("part") + F.col("before")).alias("running"))


def thin_out(peaks: DataFrame, interval: int, tile: int = TILE) -> DataFrame:
    """Peaks of which each starts more than ``interval`` after the last one kept.

    The choice is greedy: each depends on the last one. All tiles choose at once (``greedy``).
    """
    rows = peaks.select("chrom", "start", "end", "score")
    return choose(rows, "start", interval, None, ["start", "end", "score"], tile)
