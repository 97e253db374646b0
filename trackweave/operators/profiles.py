"""Signal profiles: values of a track around gene starts and ends, along gene bodies, exons and regions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import collapsed, dealt_to, expanded, points_in

# spans of genes are a few such bins wide: they are dealt to bins of this one level
BIN = 1 << 13
# what tells genes apart: names repeat in gene tables, and so do whole rows, which ``copy`` numbers; the start leads, as rows are sorted by these and few genes share it
GENE = ["txStart", "chrom", "name", "strand", "txEnd", "copy"]
# genes are dealt by their places: a name that a query fixes is no key of its plan, and partitions named by it would be dealt once more
PLACE = [c for c in GENE if c != "name"]


def told_apart(genes: DataFrame, parts: int | None = None) -> DataFrame:
    """Genes with ``copy``: the number, from 0, among rows of equal name, strand and bounds, by exons; every row is a gene of its own. ``parts``: partitions that they are dealt to."""
    ties = [c for c in ("exonStarts", "exonEnds") if c in genes.columns]
    return dealt_to(genes, parts, *PLACE[:-1]).withColumn("copy", F.row_number().over(W.partitionBy(*GENE[:-1]).orderBy(*(ties or [F.lit(0)]))) - 1)


def gene_points(spans: DataFrame, track: DataFrame, parts: int | None = None) -> DataFrame:
    """Points inside spans of genes, dealt by genes to ``parts`` partitions, so that all that is grouped by genes lies where it is."""
    rows = points_in(spans, track, BIN, closed=False, levels=False, parts=parts)
    return rows.repartition(*([parts] if parts else []), *PLACE)


def middle_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the rows of equal keys the middle one by position (index n // 2): one sort and no list of a group."""
    group = W.partitionBy(*keys)
    placed = rows.withColumns({"__nth": F.row_number().over(group.orderBy("pos", "value")) - 1, "__of": F.count(F.lit(1)).over(group)})
    return placed.filter(F.col("__nth") == F.floor(F.col("__of") / 2)).drop("__nth", "__of")


def anchor_bins(genes: DataFrame, track: DataFrame, reach: int = 2000, step: int = 100, end: bool = False, parts: int | None = None) -> DataFrame:
    """Per gene and bin that has points: GENE, bin, value; bins run 5' to 3' around the start (or end) of transcription."""
    plus = F.col("strand") == "+"
    anchor = F.when(plus != F.lit(end), F.col("txStart")).otherwise(F.col("txEnd"))
    half = step // 2
    spans = told_apart(genes, parts).select(*GENE, (anchor - reach - half).alias("start"), (anchor + reach + half).alias("end"))
    count = (2 * reach + step) // step
    raw = F.floor((F.col("pos") - F.col("start")) / step).cast("int")
    rows = gene_points(spans, track, parts).withColumn("bin", F.when(plus, raw).otherwise(count - 1 - raw))
    return middle_rows(rows, *GENE, "bin").select(*GENE, "bin", "value")


def body_bins(genes: DataFrame, track: DataFrame, bins: int = 60, parts: int | None = None) -> DataFrame:
    """Per gene and relative bin of its body, 5' to 3': mean value."""
    spans = told_apart(genes, parts).select(*GENE, F.col("txStart").alias("start"), F.col("txEnd").alias("end"))
    raw = F.floor((F.col("pos") - F.col("start")) * bins / (F.col("end") - F.col("start"))).cast("int")
    rows = gene_points(spans, track, parts).withColumn("bin", F.when(F.col("strand") == "+", raw).otherwise(bins - 1 - raw))
    return rows.groupBy(*GENE, "bin").agg(F.avg("value").alias("value"))


def joined_exon_bins(genes: DataFrame, track: DataFrame, bins: int = 30, introns: bool = False, parts: int | None = None) -> DataFrame:
    """Per gene and relative bin of its exons (or introns) put end to end: mean value."""
    exons = F.arrays_zip(F.col("exonStarts").alias("s"), F.col("exonEnds").alias("e"))
    if introns:
        n = F.size("exonStarts")
        exons = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.struct(F.get("exonEnds", i).alias("s"), F.get("exonStarts", i + 1).alias("e")))).otherwise(
            F.array().cast("array<struct<s:bigint,e:bigint>>")
        )
    listed = told_apart(genes, parts).select(*GENE, exons.alias("x"))
    size = F.aggregate("x", F.lit(0).cast("long"), lambda t, r: t + r.e - r.s)
    before = F.transform("x", lambda r, i: F.struct(r.s.alias("start"), r.e.alias("end"), F.aggregate(F.slice(F.col("x"), 1, i), F.lit(0).cast("long"), lambda t, q: t + q.e - q.s).alias("skip")))
    pieces = listed.select(*GENE, size.alias("size"), F.explode(before).alias("p")).select(*GENE, "size", "p.*").filter("end > start")
    raw = F.floor((F.col("pos") - F.col("start") + F.col("skip")) * bins / F.col("size")).cast("int")
    rows = gene_points(pieces, track, parts).withColumn("bin", F.when(F.col("strand") == "+", raw).otherwise(bins - 1 - raw))
    return rows.groupBy(*GENE, "bin").agg(F.avg("value").alias("value"))


def average_profile(values: DataFrame, groups: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Mean and number of values per bin; with ``groups`` (name, grp) for each group of genes. ``parts``: partitions of the join with the groups, then a merge join."""
    if groups is None:
        return values.groupBy("bin").agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    both = dealt_to(values, parts, "name").join(groups.hint("merge") if parts else groups, "name")
    return both.groupBy("grp", "bin").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """Mean of profiles (bin, value, n) weighted by n."""
    return profiles.filter("value is not null").groupBy("bin").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"), F.sum("n").alias("n"))


def centre_profile(regions: DataFrame, track: DataFrame, width: int) -> DataFrame:
    """Average value at each offset of a window of ``width`` around the middle of regions: offset, value, n (windows with a value there)."""
    mid = F.floor((F.col("start") + F.col("end")) / 2).cast("long")
    spans = regions.select("chrom", (mid - width // 2).alias("start"), (mid - width // 2 + width).alias("end"))
    rows = points_in(spans, track, BIN, closed=False, levels=False)
    return rows.groupBy((F.col("pos") - F.col("start")).alias("offset")).agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def region_values(regions: DataFrame, track: DataFrame, aggregate: Column, keys: list[str], default: float | None = None, closed: bool = False, parts: int | None = None) -> DataFrame:
    """Per row of regions, equal ones each, an aggregate of the values inside, which passes nulls over; ``default`` where there is none. ``parts``: partitions of the join and of the groups, the session's number if not given."""
    rows = regions.repartition(parts, *keys) if parts else regions
    each = points_in(collapsed(rows), track, BIN, closed, how="left", parts=parts)
    each = each.repartition(parts, *keys) if parts else each
    out = expanded(each.groupBy(*keys, "__n").agg(aggregate.alias("value")))
    return out if default is None else out.withColumn("value", F.coalesce("value", F.lit(default)))
