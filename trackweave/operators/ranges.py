"""Range joins, merging, nearest neighbours and coverage of intervals.

Intervals are half-open rows (chrom, start, end). Spark has no range-join operator: a join on the chromosome and an inequality
compares all rows of a chromosome. Here both sides are dealt to bins of the position axis, joined on (chrom, bin), and the exact condition is
checked on the pairs that remain; a pair is kept only in the first bin that both sides share. Bins also spread a large chromosome.

Bins have levels, each four times as wide as the one below. An interval lies in at most two bins of its own level, the lowest where that is so, and looks for others on
the levels above that occur on the other side. So an interval as long as a chromosome is two rows, and a short one is compared with long ones in their few bins only.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TILE = 1 << 20


def bin_of(pos: Column, size: int) -> Column:
    return F.floor(pos / size).cast("long")


def with_bins(df: DataFrame, size: int, start: str = "start", end: str = "end") -> DataFrame:
    """One row per bin that [start, end) touches; an empty interval stays in the bin of its start."""
    return df.withColumn("bin", F.explode(F.sequence(bin_of(F.col(start), size), bin_of(F.greatest(F.col(end) - 1, F.col(start)), size))))


def level_of(start: str, end: str, size: int) -> Column:
    """The lowest level whose bins, ``size * 4**level`` wide, are as long as [start, end); an empty interval is one position long."""
    q = F.floor((F.greatest(F.col(end) - F.col(start), F.lit(1)) - 1) / size).cast("long")
    return F.when(q > 0, F.ceil(F.length(F.bin(q)) / 2)).otherwise(0).cast("int")


def width_of(level: int, size: int) -> int:
    return size * 4**level


def levels_of(*levels: DataFrame) -> list[list[int]]:
    """The levels that occur in each of the frames (level), some thirty at most; one job."""
    marked = [df.toDF("level").distinct().withColumn("side", F.lit(i)) for i, df in enumerate(levels)]
    rows = reduce(DataFrame.unionByName, marked).filter("level is not null").collect()
    return [sorted(r.level for r in rows if r.side == i) for i in range(len(levels))]


def _by_level(own: Column, values: dict[int, Column], otherwise: Column) -> Column:
    """The value of the row's own level."""
    return reduce(lambda out, v: F.when(own == v[0], v[1]).otherwise(out), values.items(), otherwise)


def _dealt(df: DataFrame, own: Column, roles: dict[int, list[tuple[int, int]]], start: str, end: str, size: int, prefix: str) -> DataFrame:
    """A row per role (level, who) of the row's own level and bin of that level."""
    last = F.greatest(F.col(end) - 1, F.col(start))

    def bins(level: int, who: int) -> Column:
        width = width_of(level, size)
        spots = F.sequence(bin_of(F.col(start), width), bin_of(last, width))
        return F.transform(spots, lambda spot: F.struct(F.lit(level).alias("level"), F.lit(who).alias("who"), spot.alias("bin")))

    none = F.array().cast("array<struct<level:int,who:int,bin:bigint>>")
    places = {v: F.concat(none, *[bins(*r) for r in rs]) for v, rs in roles.items()}
    rows = df.withColumn("__at", F.explode(_by_level(own, places, none)))
    return rows.select(*df.columns, *[F.col(f"__at.{c}").alias(f"{prefix}{c}") for c in ("level", "who", "bin")])


def dealt_for_pairs(a: DataFrame, right: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Both sides (``right`` with names b_<name>) as rows per level, role and bin; see :func:`overlap_pairs`."""
    la, lb = level_of("start", "end", size), level_of("b_start", "b_end", size)
    of_a, of_b = levels_of(a.select(la), right.select(lb))
    roles_a = {v: [(v, 0)] * any(w <= v for w in of_b) + [(w, 1) for w in of_b if w > v] for v in of_a}
    roles_b = {v: [(v, 1)] * any(w < v for w in of_a) + [(w, 0) for w in of_a if w >= v] for v in of_b}
    return _dealt(a, la, roles_a, "start", "end", size, "__a_"), _dealt(right, lb, roles_b, "b_start", "b_end", size, "__b_")


def overlap_pairs(a: DataFrame, b: DataFrame, size: int, levels: bool = True, parts: int | None = None) -> DataFrame:
    """Pairs of overlapping intervals: all columns of a, and those of b as b_<name>; touching ones do not overlap.

    A pair meets on the higher of both levels: where a's is not below b's, a is there at home (who = 0) and b a guest; else it is the other way round (who = 1).
    Guests never meet each other. Where all intervals are known to be hardly longer than ``size``, or are dear to make twice, ``levels`` may be false: then all bins are ``size`` wide.
    ``parts`` is the number of partitions of the join, then a merge join; the session's and the planner's choice if not given.
    """
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    same = F.col("chrom") == F.col("b_chrom")
    at = ["__a_bin"]
    if levels:
        at = ["__a_level", "__a_who", "__a_bin"]
        x, y = dealt_for_pairs(a, right, size)
        meet = same & (F.col("__a_level") == F.col("__b_level")) & (F.col("__a_who") == F.col("__b_who")) & (F.col("__a_bin") == F.col("__b_bin"))
        width = F.expr(f"shiftleft({size}L, 2 * __a_level)")
    else:
        x, y = with_bins(a, size).withColumnRenamed("bin", "__a_bin"), with_bins(right, size, "b_start", "b_end").withColumnRenamed("bin", "__b_bin")
        meet, width = same & (F.col("__a_bin") == F.col("__b_bin")), F.lit(size)
    if parts:
        x, y = x.repartition(parts, "chrom", *at), y.hint("merge")
    pairs = x.join(y, meet).filter((F.col("b_start") < F.col("end")) & (F.col("start") < F.col("b_end")) & (F.col("__a_bin") == F.floor(F.greatest("start", "b_start") / width).cast("long")))
    return pairs.select(*a.columns, *[c for c in right.columns if c != "b_chrom"])


def points_in(intervals: DataFrame, points: DataFrame, size: int, closed: bool = True, levels: bool = True, how: str = "inner", parts: int | None = None) -> DataFrame:
    """Rows (all columns of intervals, pos and the other columns of points); ``closed``: the end belongs to the interval.

    Intervals lie in two bins of their level at most, a point looks in one bin of each level that occurs. Where all intervals are known to be hardly longer than ``size``, or are dear to make twice, ``levels`` may be
    false: then all bins are ``size`` wide. ``how`` left keeps intervals without points, with nulls, once per bin. ``parts`` is the number of partitions of the join (the session's if not given);
    it is a merge join, as the files of few columns that the planner measures say little about the size of rows made from them.
    """
    spans = intervals.withColumn("stop", F.col("end") + (1 if closed else 0))
    last = F.greatest(F.col("stop") - 1, F.col("start"))
    own = level_of("start", "stop", size)
    of = levels_of(spans.select(own))[0] if levels else [0]
    if len(of) > 1:
        spots = {v: F.sequence(bin_of(F.col("start"), width_of(v, size)), bin_of(last, width_of(v, size))) for v in of}
        x = spans.withColumn("level", own).withColumn("bin", F.explode(_by_level(F.col("level"), spots, F.array().cast("array<bigint>"))))
        seen = F.explode(F.array(*[F.struct(F.lit(v).alias("level"), bin_of(F.col("pos"), width_of(v, size)).alias("bin")) for v in of]))
        y = points.withColumn("__at", seen).withColumns({"p_level": F.col("__at.level"), "p_bin": F.col("__at.bin")}).drop("__at")
        meet = (F.col("level") == F.col("p_level")) & (F.col("bin") == F.col("p_bin"))
    else:
        width = width_of(*(of or [0]), size)
        x = with_bins(spans, width, "start", "stop").withColumn("level", F.lit(0))
        y = points.withColumns({"p_level": F.lit(0), "p_bin": bin_of(F.col("pos"), width)})
        meet = F.col("bin") == F.col("p_bin")
    y = y.withColumnRenamed("chrom", "p_chrom")
    hit = (F.col("chrom") == F.col("p_chrom")) & meet & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop"))
    if parts:
        x = x.repartition(parts, "chrom", *(["level"] if len(of) > 1 else []), "bin")
    return x.join(y.hint("merge"), hit, how).drop("level", "p_level", "bin", "p_bin", "p_chrom", "stop")


def dealt_to(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt by keys to ``parts`` partitions; as they are if no number is given."""
    return df.repartition(parts, *keys) if parts else df


def collapsed(df: DataFrame, n: str = "__n") -> DataFrame:
    """Each distinct row with the number of its copies, which :func:`expanded` brings back."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(n))


def expanded(df: DataFrame, n: str = "__n") -> DataFrame:
    return df.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).drop(n)


def overlapping(a: DataFrame, b: DataFrame, size: int, cover: float = 0.0) -> DataFrame:
    """Rows of a, equal ones each, that some interval of b overlaps by more than the share ``cover`` of b's length (overlap counted plus one)."""
    shared = F.least("end", "b_end") - F.greatest("start", "b_start")
    pairs = overlap_pairs(collapsed(a), b.select("chrom", "start", "end"), size).filter((shared + 1) / (F.col("b_end") - F.col("b_start")) > cover)
    return expanded(pairs.select(*a.columns, "__n").distinct())


def _islands(df: DataFrame, keys: list[str], order: list[str], aggregates: list[Column], gap: int = 0) -> DataFrame:
    running = F.max("end").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= running + gap, 0).otherwise(1)
    flagged = df.withColumn("fresh", fresh)
    return flagged.withColumn("island", F.sum("fresh").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).groupBy(*keys, "island").agg(*aggregates)


def merged(df: DataFrame, aggregates: list[Column], gap: int, tile: int, parts: int | None = None) -> DataFrame:
    """Unions of intervals (chrom, start, end, ...) that lie at most ``gap`` apart, with ``aggregates``, which may be applied again to their own results.

    Intervals merge inside tiles of the axis first. Of a tile, only the union that may go on in later tiles (the last one) and those that
    begin within reach of an earlier tile (all one union, as what reaches there covers them) are carried over, two rows per tile at most; all others are
    finished where they are. So no task handles a chromosome, unless as two rows per tile. ``parts``: partitions that the tiles are dealt to, the session's number if not given.
    """
    keyed = dealt_to(df.withColumn("tile", bin_of(F.col("start"), tile)), parts, "chrom", "tile")
    ends = keyed.groupBy("chrom", "tile").agg(F.max("end").alias("upto"))
    reach = F.max("upto").over(W.partitionBy("chrom").orderBy("tile").rowsBetween(W.unboundedPreceding, -1))
    local = _islands(keyed, ["chrom", "tile"], ["start", "end"], aggregates, gap).join(ends.select("chrom", "tile", "upto", reach.alias("reach")), ["chrom", "tile"])
    inner = F.coalesce(F.col("start") <= F.col("reach") + gap, F.lit(False))
    # a negative number gathers what an earlier tile reaches
    local = local.withColumns({"part": F.when(inner, -1).otherwise(F.col("island")), "last": F.col("end") == F.col("upto")})
    pieces = local.groupBy("chrom", "tile", "part").agg(*aggregates, F.max("last").alias("last"))
    placed = pieces.withColumn("place", F.when((F.col("part") < 0) | F.col("last"), F.lit(None).cast("long")).otherwise(F.col("tile")))
    return _islands(dealt_to(placed, parts, "chrom", "place"), ["chrom", "place"], ["start", "end"], aggregates, gap).drop("place", "island")


def merge_intervals(df: DataFrame, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """Unions of overlapping or touching intervals: chrom, start, end, n."""
    base = df.select("chrom", "start", "end", F.lit(1).cast("long").alias("n"))
    sums = [F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")]
    return merged(base, sums, 0, tile, parts).select("chrom", "start", "end", "n")


def merge_peaks(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Merged peaks: summit and score of the highest member (the first on ties), total_p summed."""
    best = F.struct(F.col("score").alias("score"), (-F.col("start")).alias("s"), (-F.col("end")).alias("e"), (-F.col("summit")).alias("m"))
    base = df.select("chrom", "start", "end", "total_p", F.lit(1).cast("long").alias("n"), best.alias("best"))
    sums = [F.min("start").alias("start"), F.max("end").alias("end"), F.sum("total_p").alias("total_p"), F.sum("n").alias("n"), F.max("best").alias("best")]
    return merged(base, sums, 0, tile).select("chrom", "start", "end", "n", (-F.col("best.m")).alias("summit"), F.col("best.score").alias("score"), "total_p")


def covered_bases(a: DataFrame, b: DataFrame, size: int, levels: bool = True, parts: int | None = None) -> DataFrame:
    """Per row of a that b covers somewhere, equal ones each: positions that b covers, where b's intervals do not overlap each other. ``parts``: partitions of each step, the session's number if not given."""
    shared = F.least("end", "b_end") - F.greatest("start", "b_start")
    pairs = overlap_pairs(collapsed(dealt_to(a, parts, *a.columns)), b.select("chrom", "start", "end"), size, levels, parts)
    found = dealt_to(pairs, parts, *a.columns).groupBy(*a.columns, "__n").agg(F.sum(shared).alias("covered"))
    return expanded(found)


def nearest(points: DataFrame, marks: DataFrame, tile: int = TILE) -> DataFrame:
    """Per point (chrom, pos, ...): the last mark at or before it (``before``) and the first after it (``after``).

    An as-of join in both directions: marks and points are united and read in order inside tiles; the marks nearest
    to a tile from outside come from one row per tile.
    """
    extra = [c for c in points.columns if c not in ("chrom", "pos")]
    null = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra]
    both = points.select("chrom", "pos", *extra, F.lit(1).alias("is_point"), F.lit(None).cast("long").alias("mark")).unionByName(
        marks.select("chrom", F.col("pos"), *null, F.lit(0).alias("is_point"), F.col("pos").alias("mark"))
    )
    both = both.withColumn("tile", bin_of(F.col("pos"), tile))
    ends = marks.withColumn("tile", bin_of(F.col("pos"), tile)).groupBy("chrom", "tile").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    spine = both.select("chrom", "tile").distinct().join(ends, ["chrom", "tile"], "left")
    # what follows is read backwards: a frame that grows costs one step per row, one that shrinks is computed anew for each
    up, down = W.partitionBy("chrom").orderBy("tile"), W.partitionBy("chrom").orderBy(F.desc("tile"))
    spine = spine.select(
        "chrom", "tile",
        F.last("hi", True).over(up.rowsBetween(W.unboundedPreceding, -1)).alias("earlier"),
        F.last("lo", True).over(down.rowsBetween(W.unboundedPreceding, -1)).alias("later"),
    )
    up, down = W.partitionBy("chrom", "tile").orderBy("pos", "is_point"), W.partitionBy("chrom", "tile").orderBy(F.desc("pos"), F.desc("is_point"))
    found = both.withColumns(
        {
            "before": F.last("mark", True).over(up.rowsBetween(W.unboundedPreceding, 0)),
            "after": F.last("mark", True).over(down.rowsBetween(W.unboundedPreceding, -1)),
        }
    ).filter("is_point = 1")
    joined = found.join(spine, ["chrom", "tile"])
    return joined.select("chrom", "pos", *extra, F.coalesce("before", "earlier").alias("before"), F.coalesce("after", "later").alias("after"))


def with_neighbours(df: DataFrame, columns: tuple[str, ...] = ("pos", "value"), tile: int = TILE) -> DataFrame:
    """Rows with the structs ``prev`` and ``next`` of ``columns`` of the neighbouring rows of the chromosome, by the first of these columns.

    Neighbours inside a tile come from a window over the tile; those across a tile's edge from the first and last row of each tile.
    """
    place = columns[0]
    row = F.struct(*[F.col(c) for c in columns])
    keyed = df.withColumn("tile", bin_of(F.col(place), tile))
    order = W.partitionBy("chrom", "tile").orderBy(*columns)
    inner = keyed.withColumns({"prev": F.lag(row).over(order), "next": F.lead(row).over(order)})
    ends = keyed.groupBy("chrom", "tile").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    by = W.partitionBy("chrom").orderBy("tile")
    spine = ends.select("chrom", "tile", F.lag("hi").over(by).alias("earlier"), F.lead("lo").over(by).alias("later"))
    out = inner.join(spine, ["chrom", "tile"])
    return out.select(*df.columns, F.coalesce("prev", "earlier").alias("prev"), F.coalesce("next", "later").alias("next"))
