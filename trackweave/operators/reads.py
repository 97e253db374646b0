"""Sequenced tags: duplicates, overlaps with regions, pairing."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import overlap_pairs


def merge_duplicates(tags: DataFrame) -> DataFrame:
    """Tags (chrom, strand, pos) with the number of copies at each place."""
    return tags.groupBy("chrom", "strand", "pos").agg(F.count(F.lit(1)).alias("count"))


def tag_spans(tags: DataFrame, width: int) -> DataFrame:
    """Tags as intervals: plus tags reach ahead of their 5' end, minus tags back."""
    plus = F.col("strand") == "+"
    return tags.select("chrom", "strand", "pos", F.when(plus, F.col("pos")).otherwise(F.col("pos") - width).alias("start"), F.when(plus, F.col("pos") + width).otherwise(F.col("pos")).alias("end"))


def tags_in_regions(regions: DataFrame, tags: DataFrame, width: int, size: int = 1 << 12) -> DataFrame:
    """Regions that tags overlap with the list of the tags' starts and strands, in order: chrom, start, end, tags."""
    pairs = overlap_pairs(regions.select("chrom", "start", "end"), tag_spans(tags, width), size)
    return pairs.groupBy("chrom", "start", "end").agg(F.array_sort(F.collect_list(F.struct(F.col("b_start").alias("at"), F.col("b_strand").alias("strand")))).alias("tags"))


def best_pairs(hits: DataFrame, distance: int, most: int = 200) -> DataFrame:
    """Placed read pairs: hits (pair, side, chrom, pos, strand, errors) of the left and right reads.

    Of the combinations on one chromosome with opposite strands, scored by the deviation from ``distance`` plus the errors, the best below ``most`` counts if
    it is the only one with its score: pair, chrom, pos (midpoint), score.
    """
    left = hits.filter("side = 'L'").select("pair", "chrom", F.col("pos").alias("lp"), F.col("strand").alias("ls"), F.col("errors").alias("le"))
    right = hits.filter("side = 'R'").select("pair", "chrom", F.col("pos").alias("rp"), F.col("strand").alias("rs"), F.col("errors").alias("re"))
    score = F.abs(F.abs(F.col("rp") - F.col("lp")) - distance) + F.col("le") + F.col("re")
    both = left.join(right, ["pair", "chrom"]).filter("ls <> rs").withColumn("score", score).filter(F.col("score") < most)
    best = W.partitionBy("pair")
    ranked = both.withColumn("r", F.rank().over(best.orderBy("score"))).withColumn("ties", F.sum((F.col("r") == 1).cast("int")).over(best))
    return ranked.filter("r = 1 and ties = 1").select("pair", "chrom", F.floor((F.col("lp") + F.col("rp")) / 2).cast("long").alias("pos"), "score")


def pair_quality(hits: DataFrame, low: int = 50, high: int = 500) -> DataFrame:
    """Per pair the combinations whose right read starts between ``low`` and ``high`` after the left one; unique: exactly one."""
    left = hits.filter("side = 'L'").select("pair", "chrom", F.col("pos").alias("lp"))
    right = hits.filter("side = 'R'").select("pair", "chrom", F.col("pos").alias("rp"))
    gap = F.col("rp") - F.col("lp")
    n = left.join(right, ["pair", "chrom"]).filter((gap > low) & (gap < high)).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    return hits.select("pair").distinct().join(n, "pair", "left").select("pair", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) == 1).alias("is_unique"))
