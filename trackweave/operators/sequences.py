"""Reads sampled from sequences, and enrichment of motif hits in regions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probability import minus_ten_log10, poisson_upper
from ..functions.strings import reverse_complement
from ..sources.shared import stored_rows
from .ranges import dealt_to, merge_intervals, overlap_pairs


def sample_reads(sequences: DataFrame, size: int, window: int = 1000, seed: int = 1, mate: int | None = None) -> DataFrame:
    """One read of ``size`` per window of each sequence (name, sequence), at a place that a hash of name and window gives: name, start, read.

    Reads with N are left out. With ``mate`` each read also has the reverse complement of the read that ends ``mate`` after its start.
    """
    n = F.length("sequence")
    spots = sequences.select("name", "sequence", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / window), F.lit(0)).cast("int"))).alias("w"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "name", F.col("w").cast("string"))), 1, 8), 16, 10).cast("long")
    start = (F.col("w") * window + u % window).cast("int")
    reads = spots.withColumn("start", start).select("name", "start", F.upper(F.expr(f"substring(sequence, start + 1, {size})")).alias("read"), F.upper(F.expr(f"substring(sequence, start + {(mate or size) - size} + 1, {size})")).alias("far"))
    reads = reads.filter((F.length("read") == size) & ~F.col("read").contains("N"))
    if mate is None:
        return reads.drop("far")
    return reads.filter((F.length("far") == size) & ~F.col("far").contains("N")).withColumn("mate", reverse_complement(F.col("far"))).drop("far")


def motif_enrichment(regions: DataFrame, background: DataFrame, hits: DataFrame, width: int = 5, size: int = 1 << 12, parts: int | None = None) -> DataFrame:
    """Per motif of hits (motif, chrom, pos): hits in the merged regions and in the merged background, fold change per base, Poisson upper p and score.

    motif, num, ref, fold, p, score; the expected number is the background's rate over the regions' length, with at least one background hit. Hits that repeat count once.
    Regions and background are merged together, as chromosomes of two sides, once, and met by the hits in one join. ``parts``: partitions of each step, the session's number if not given.
    """
    spans = hits.select("motif", "chrom", F.col("pos").alias("start"), (F.col("pos") + width).alias("end"))
    sides = [x.select(F.struct(F.lit(i).alias("side"), "chrom").alias("chrom"), "start", "end") for i, x in enumerate((regions, background))]
    merged = stored_rows(merge_intervals(sides[0].unionByName(sides[1]), parts=parts).select("chrom.side", "chrom.chrom", "start", "end"))
    met = dealt_to(overlap_pairs(spans, merged, size, parts=parts).select("motif", "chrom", "start", "b_side"), parts, "motif", "chrom", "start")
    once = met.groupBy("motif", "chrom", "start").agg(F.max((F.col("b_side") == 0).cast("long")).alias("num"), F.max((F.col("b_side") == 1).cast("long")).alias("ref"))
    counts = once.groupBy("motif").agg(F.sum("num").alias("num"), F.sum("ref").alias("ref"))
    length = F.col("end") - F.col("start")
    lengths = F.broadcast(merged.agg(F.sum(F.when(F.col("side") == 0, length)).alias("len"), F.sum(F.when(F.col("side") == 1, length)).alias("ref_len")))
    rows = hits.select("motif").distinct().join(counts, "motif", "left").fillna(0, ["num", "ref"]).join(lengths, F.lit(True))
    expected = F.greatest("ref", F.lit(1)) * F.col("len") / F.col("ref_len")
    out = rows.withColumns({"fold": F.col("num") / expected, "p": F.when(F.col("num") == 0, 1.0).otherwise(poisson_upper(F.col("num") - 1, expected))})
    return out.select("motif", "num", "ref", "fold", "p", minus_ten_log10(F.col("p")).alias("score"))
