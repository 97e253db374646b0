"""Profiles of regions of unlike lengths, fitted to one number of bins: whole genes, joined exons, exons by class of length.

A region of length L has n = L // step equal bins, numbered 5' to 3'. The value of a bin is the middle one of its points by position, 0 where it has none;
regions shorter than ``step`` and regions without points have no row. Bounds are whole numbers and half-open, ``step`` is even. To fit k bins to m, the
middle of each bin (its start plus half a step) is dealt to m equal bins: of several the middle one is taken, and a bin that gets none repeats the one before.
All this is integer arithmetic on rows, so no region needs to be held whole.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .profiles import GENE, gene_points, middle_rows, told_apart


def whole(a: Column, b: Column) -> Column:
    """a / b in whole numbers, for a >= 0 and b > 0."""
    return F.call_function("div", a, b)


def region_bins(points: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Bins that have points: keys, length, n, i (5' to 3') and value, of rows with keys, strand, start, end, pos and value."""
    rows = points.withColumn("length", F.col("end") - F.col("start")).withColumn("n", F.floor(F.col("length") / step))
    rows = rows.filter("n > 0 and pos >= start and pos < end")
    raw = whole((F.col("pos") - F.col("start")) * F.col("n"), F.col("length"))
    placed = rows.withColumn("i", F.when(F.col("strand") == "+", raw).otherwise(F.col("n") - 1 - raw))
    return middle_rows(placed, *keys, "i").select(*keys, "length", "n", "i", "value")


def fitted(bins: DataFrame, keys: list[str], step: int, m: Column, trim: Column | None = None, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Bins of :func:`region_bins` fitted to ``m`` per region after ``trim`` (0 or 1) bins at both ends have gone: keys, bin and value for all m bins, or those from ``low`` to ``high``.

    The trimmed bin before the first is what bins repeat that have none before them; without trimming it is the first. Regions that trimming leaves empty have no row.
    """
    placed = placed_bins(bins, keys, step, m, trim, low, high)
    return placed.groupBy(*keys, "bin").agg(F.coalesce(F.max(F.when(F.col("hit"), F.col("value"))), F.lit(0.0)).alias("value"))


def placed_bins(bins: DataFrame, keys: list[str], step: int, m: Column, trim: Column | None = None, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """The rows that :func:`fitted` makes its bins of: keys, bin, value, hit (the bin takes this value, which one row of a region and bin may say), first (which one row of each region and bin says).

    Each bin names the bins that take it, and the first of a region all m as well, so that the bins are made and moved once.
    """
    rows = bins.withColumns({"m": m.cast("long"), "trim": (F.lit(0) if trim is None else trim).cast("long")})
    rows = rows.withColumns({"k": F.col("n") - 2 * F.col("trim"), "t": F.col("i") - F.col("trim")}).filter("k > 0")
    size, half = F.col("length") * F.col("m"), F.col("n") * F.col("m") * (step // 2)

    def first_of(j: Column) -> Column:
        """The first of the k bins that is dealt to bin j or a later one."""
        return whole(F.greatest(j * F.col("length") * F.col("k") - half, F.lit(0)) + size - 1, size)

    def taken(j: Column) -> Column:
        low, high = first_of(j), first_of(j + 1)
        return F.when(F.col("k") > F.col("m"), low + whole(high - low, F.lit(2))).when(F.col("k") == F.col("m"), j).otherwise(F.greatest(high - 1, -F.col("trim")))

    def dealt(t: Column) -> Column:
        return whole(F.greatest(t, F.lit(0)) * size + half, F.col("length") * F.col("k"))

    low, high = F.lit(0) if low is None else low, F.col("m") - 1 if high is None else high
    rows = rows.withColumns({"low": low.cast("long"), "high": high.cast("long"), "first": F.row_number().over(W.partitionBy(*keys).orderBy("i")) == 1})

    def shown(j: Column) -> Column:
        return F.least(F.greatest(j, F.col("low")), F.col("high"))

    t = F.col("t")
    begin, end = F.when(F.col("first") | (t <= 0), F.col("low")).otherwise(shown(dealt(t))), F.when(F.col("first"), F.col("high")).otherwise(shown(dealt(t + 1)))
    placed = rows.withColumn("bin", F.explode(F.sequence(begin, end))).withColumn("hit", taken(F.col("bin")) == t).filter("first or hit")
    return placed.select(*keys, "bin", "value", "hit", "first")


def average_placed(placed: DataFrame) -> DataFrame:
    """Mean and number of the values of :func:`fitted` per bin, straight from :func:`placed_bins`: no row per region and bin is made, as a bin without a value adds 0 to the sum."""
    return placed.groupBy("bin").agg((F.sum(F.when(F.col("hit"), F.coalesce("value", F.lit(0.0))).otherwise(0.0)) / F.count_if("first")).alias("value"), F.count_if("first").alias("n"))


def gene_bins(genes: DataFrame, track: DataFrame, size: int = 3000, step: int = 50, parts: int | None = None) -> DataFrame:
    """Genes, a step and a half wider at both ends, fitted to (size + step) // step bins after one bin at each end has gone: GENE, bin, value."""
    margin = step + step // 2
    spans = told_apart(genes, parts).select(*GENE, (F.col("txStart") - margin).alias("start"), (F.col("txEnd") + margin).alias("end"))
    bins = region_bins(gene_points(spans, track, parts), GENE, step)
    return fitted(bins, GENE, step, F.lit((size + step) // step), F.lit(1))


def _sided_bins(genes: DataFrame, track: DataFrame, size: int, reach: int, wing: int, step: int, parts: int | None) -> tuple[list, Column]:
    """What :func:`fitted` and :func:`placed_bins` take for the three parts of genes, and the number of a bin in the whole row of bins."""
    wing = min(wing, reach)
    side, body, centre, n = wing // step, (size + step) // step, reach // step, (2 * reach + step) // step
    half, margin = step // 2, step + step // 2
    plus = F.col("strand") == "+"
    start, end = F.when(plus, F.col("txStart")).otherwise(F.col("txEnd")), F.when(plus, F.col("txEnd")).otherwise(F.col("txStart"))
    bounds = ((start - reach - half, start + reach + half), (F.col("txStart") - margin, F.col("txEnd") + margin), (end - reach - half, end + reach + half))
    spans = told_apart(genes, parts).select(*GENE, F.posexplode(F.array(*[F.struct(a.alias("start"), b.alias("end")) for a, b in bounds])).alias("part", "x")).select(*GENE, "part", "x.start", "x.end")
    keys, inner = [*GENE, "part"], F.col("part") == 1
    bins = region_bins(gene_points(spans, track, parts), keys, step)
    low = F.when(F.col("part") == 0, centre - side).when(inner, 0).otherwise(centre + 1)
    high = F.when(F.col("part") == 0, centre - 1).when(inner, body - 1).otherwise(centre + side)
    number = F.col("bin") + F.when(F.col("part") == 0, side - centre).when(inner, side).otherwise(side + body - centre - 1)
    return [bins, keys, step, F.when(inner, body).otherwise(n), F.when(inner, 1).otherwise(0), low, high], number.alias("bin")


def gene_with_sides(genes: DataFrame, track: DataFrame, size: int = 3000, reach: int = 3000, wing: int = 1000, step: int = 50, parts: int | None = None) -> DataFrame:
    """Bins upstream of the start (-wing to -step), of the gene and downstream of the end (step to wing), numbered on from 0: GENE, bin, value.

    ``reach`` and ``wing`` are multiples of ``step``. A part without points has no rows; the others keep their numbers. The three parts of a gene are spans of one join with the track.
    """
    bins, number = _sided_bins(genes, track, size, reach, wing, step, parts)
    return fitted(*bins).select(*GENE, number, "value")


def average_with_sides(genes: DataFrame, track: DataFrame, size: int = 3000, reach: int = 3000, wing: int = 1000, step: int = 50, parts: int | None = None) -> DataFrame:
    """Mean and number of the values of :func:`gene_with_sides`: bin, value, n."""
    bins, number = _sided_bins(genes, track, size, reach, wing, step, parts)
    return average_placed(placed_bins(*bins).select(number, "value", "hit", "first"))


def parts_of(genes: DataFrame, step: int, introns: bool = False, parts: int | None = None) -> DataFrame:
    """Exons (or introns), half a step wider at both ends: GENE, part (from 0), start, end; gap: what lies between the parts up to this one; from, upto: bounds of all parts put end to end."""
    half, n = step // 2, F.size("exonStarts")
    starts, ends = (F.slice("exonEnds", 1, F.greatest(n - 1, F.lit(0))), F.slice("exonStarts", 2, F.greatest(n - 1, F.lit(0)))) if introns else (F.col("exonStarts"), F.col("exonEnds"))
    listed = told_apart(genes, parts).select(*GENE, F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.struct((x.s - half).alias("start"), (x.e + half).alias("end"))).alias("p"))
    between = F.transform("p", lambda r, i: r.start - F.when(i > 0, F.get(F.col("p"), i - 1).end))
    listed = listed.withColumn("between", between)
    gaps = listed.withColumn("gaps", F.transform("between", lambda _, i: F.aggregate(F.slice("between", 2, i), F.lit(0).cast("long"), lambda t, x: t + x)))
    last = F.size("p") - 1
    rows = gaps.select(*GENE, F.get("p", F.lit(0)).start.alias("from"), (F.get("p", last).end - F.get("gaps", last)).alias("upto"), F.posexplode(F.arrays_zip("p", "gaps")).alias("part", "x"))
    return rows.select(*GENE, "part", "x.p.start", "x.p.end", F.col("x.gaps").alias("gap"), "from", "upto")


def joined_bins(genes: DataFrame, track: DataFrame, size: int = 3000, step: int = 50, least: int = 10, introns: bool = False, parts: int | None = None) -> DataFrame:
    """Exons (or introns) put end to end and fitted to (size + step) // step bins: GENE, bin, value.

    The first point of a part comes at least ``least`` after the last one of the parts before: the part is moved on by what is missing.
    """
    points = gene_points(parts_of(genes, step, introns, parts), track, parts).withColumn("pos", F.col("pos") - F.col("gap"))
    state = F.struct(F.lit(None).cast("long").alias("end"), F.lit(0).cast("long").alias("d"))

    def move(s: Column, r: Column) -> Column:
        d = F.coalesce(F.greatest(F.lit(least) - (r["first"] - s["end"]), F.lit(0)), F.lit(0)).cast("long")
        return F.struct((r["last"] + d).alias("end"), d.alias("d"))

    # what moves a part are the first and last points of the parts up to it: windows over rows that lie by genes already
    edges = {c: f("pos").over(W.partitionBy(*GENE, "part")) for c, f in (("first", F.min), ("last", F.max))}
    own = points.withColumns(edges).withColumn("edge", F.struct("part", "first", "last"))
    met = own.withColumn("p", F.collect_set("edge").over(W.partitionBy(*GENE)))
    upto = F.filter(F.array_sort("p"), lambda x: x.part <= F.col("part"))
    moved = met.withColumn("d", F.aggregate(upto, state, move).d)
    rows = moved.select(*GENE, F.col("from").alias("start"), F.col("upto").alias("end"), (F.col("pos") + F.col("d")).alias("pos"), "value")
    return fitted(region_bins(rows, GENE, step), GENE, step, F.lit((size + step) // step))


def part_bins(genes: DataFrame, track: DataFrame, classes: list[tuple[int, int, int]], step: int = 50, introns: bool = False, parts: int | None = None) -> DataFrame:
    """Each exon (or intron) fitted to the bins of its class: GENE, part, class, bin, value.

    ``classes`` are (lower, upper, size): the first with lower <= length < upper takes the part, fitted to (size + step) // step bins; parts of no class are left out.
    """
    length = F.col("end") - F.col("start") - step
    number = F.coalesce(*[F.when((length >= lower) & (length < upper), i) for i, (lower, upper, _) in enumerate(classes)])
    m = F.coalesce(*[F.when(F.col("class") == i, (size + step) // step) for i, (_, _, size) in enumerate(classes)])
    keys = [*GENE, "part", "class"]
    pieces = parts_of(genes, step, introns, parts).select(*GENE, "part", "start", "end").withColumn("class", number).filter("class is not null")
    return fitted(region_bins(gene_points(pieces, track, parts), keys, step), keys, step, m)


def breaks(start: float, end: float, step: float, percent: bool = False) -> list[float]:
    """The x axis of a profile: steps from start to end in base pairs, or as many from 0 to 100."""
    n = int((end - start) // step) + 1
    low, high = (0.0, 100.0) if percent else (start, end)
    points = [low + (high - low) * i / max(n - 1, 1) for i in range(n)]
    return points if percent else [round(x) for x in points]
