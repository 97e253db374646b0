"""Writers: rows become lines of text by column expressions; tables go to Parquet or the catalogue."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import TILE, bin_of, with_bins


def tab(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("NA")) for c in columns]).alias("value")


def bed_lines(df: DataFrame) -> DataFrame:
    return df.select(tab(*[c for c in ("chrom", "start", "end", "name", "score", "strand") if c in df.columns]))


def gff_lines(track: DataFrame, span: int, shift: int = 0, source: str = ".", feature: str = ".") -> DataFrame:
    start = F.col("pos") - shift
    return track.select(tab("chrom", F.lit(source), F.lit(feature), start, start + span - 1, F.col("value"), F.lit("."), F.lit("."), F.lit(".")))


def wiggle_lines(track: DataFrame, span: int, shift: int = 0, digits: int = 4, tile: int = TILE) -> DataFrame:
    """Lines (chrom, tile, place, value) in order: a declaration per tile of a chromosome (place null), then its points."""
    tiled = track.withColumn("tile", bin_of(F.col("pos"), tile))
    head = tiled.select("chrom", "tile").distinct().select("chrom", "tile", F.lit(None).cast("long").alias("place"), F.concat(F.lit("variableStep chrom="), "chrom", F.lit(f" span={span}")).alias("value"))
    body = tiled.select("chrom", "tile", F.col("pos").alias("place"), F.concat_ws("\t", (F.col("pos") - shift).cast("string"), F.format_string(f"%.{digits}f", "value")).alias("value"))
    return head.unionByName(body)


def write_wiggle(track: DataFrame, path: str, span: int, shift: int = 0) -> None:
    """One folder of text whose parts, in order, are the file; each part is a wiggle file of its own, of whole tiles."""
    wiggle_lines(track, span, shift).repartitionByRange("chrom", "tile").sortWithinPartitions("chrom", "tile", "place").select("value").write.text(path)


def write_tag_wiggle(tags: DataFrame, path: str, width: int, tile: int = TILE, parts: int | None = None) -> None:
    """Tags (chrom, strand, pos) as wiggle of positions, strand=0 for plus and 1 for minus; each of ``parts`` parts (the session's number if not given) holds whole tiles of a strand under their own declaration."""
    tiled = tags.select("chrom", "strand", bin_of(F.col("pos"), tile).alias("tile"), "pos")
    head = tiled.select("chrom", "strand", "tile").distinct().withColumns({"pos": F.lit(None).cast("long"), "value": F.concat(F.lit("variableStep chrom="), "chrom", F.lit(f" span={width} strand="), F.when(F.col("strand") == "-", "1").otherwise("0"))})
    both = head.unionByName(tiled.withColumn("value", F.col("pos").cast("string")))
    both.repartitionByRange(*([parts] if parts else []), "chrom", "strand", "tile").sortWithinPartitions("chrom", "strand", "tile", "pos").select("value").write.text(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.text(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, nullValue="NA")


def write_by_chrom(df: DataFrame, path: str, place: str = "start") -> None:
    """Parquet in one folder per chromosome, so that reading one chromosome reads only its files; a chromosome is written by many tasks, each a range of ``place``."""
    df.repartitionByRange("chrom", place).write.partitionBy("chrom").parquet(path)


def save_intervals(df: DataFrame, name: str, size: int, buckets: int, path: str | None = None) -> None:
    """A table of intervals (chrom, start, end, ...) in folders of chromosomes and buckets of bins ``size`` wide, with a row per bin that an interval touches.

    Tables of the same size and number of buckets are joined by :func:`saved_overlaps` without moving a row, and a chromosome is one folder.
    """
    rows = with_bins(df, size).withColumn("place", F.concat_ws(":", "chrom", "bin"))
    writer = rows.repartition(buckets, "place").write.partitionBy("chrom").bucketBy(buckets, "place").sortBy("place")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def saved_overlaps(spark: SparkSession, a: str, b: str, size: int, chrom: str | None = None) -> DataFrame:
    """Pairs of overlapping intervals of two saved tables: all columns of a, those of b as b_<name>."""
    x, y = (spark.table(t) if chrom is None else spark.table(t).filter(F.col("chrom") == chrom) for t in (a, b))
    right = y.select(*[F.col(c).alias(f"b_{c}") for c in y.columns])
    first = bin_of(F.greatest("start", "b_start"), size)
    pairs = x.join(right.hint("merge"), F.col("place") == F.col("b_place")).filter((F.col("b_start") < F.col("end")) & (F.col("start") < F.col("b_end")) & (F.col("bin") == first))
    return pairs.select(*[c for c in x.columns if c not in ("bin", "place")], *[c for c in right.columns if c not in ("b_chrom", "b_bin", "b_place")])


def save_jdbc(df: DataFrame, url: str, table: str, mode: str = "errorifexists", **options: str) -> None:
    """To a database; array columns as comma lists."""
    lists = {f.name: F.array_join(F.col(f.name).cast("array<string>"), ",") for f in df.schema if f.dataType.typeName() == "array"}
    df.withColumns(lists).write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def save(df: DataFrame, name: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).saveAsTable(name)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def motif_lines(motifs: DataFrame) -> DataFrame:
    """(id, place, value): matrix rows of each motif as text lines."""
    rows = motifs.select("id", F.posexplode("pwm").alias("i", "r"))
    return rows.select("id", F.col("i").alias("place"), F.concat_ws("\t", (F.col("i") + 1).cast("string"), *[F.format_string("%.3f", f"r.{b}") for b in "acgt"]).alias("value"))


def motif_text(motifs: DataFrame, source: str = "") -> DataFrame:
    """(id, value): each motif (id, factors, species, pwm) as one text of the sectioned format."""
    rows = F.array_join(F.transform("pwm", lambda r, i: F.concat_ws("\t", (i + 1).cast("string"), *[F.format_string("%.6f", r[b]) for b in "acgt"])), "\n")
    named = F.when(F.size("factors") > 0, F.array_join("factors", "\n")).otherwise("N/A")
    parts = [F.lit("#Position Probability Weight Matrix:\n\tA\tC\tG\tT\n"), rows, F.lit(f"\n#Source:\n{source or 'N/A'}\n#Factor Name:\n"), named, F.lit("\n#Species:\n"), F.coalesce("species", F.lit("N/A"))]
    return motifs.select("id", F.concat(*parts).alias("value"))


def write_motifs(motifs: DataFrame, path: str, source: str = "") -> None:
    """One folder id=<id> with a file of the sectioned format for each motif."""
    motif_text(motifs, source).write.partitionBy("id").text(path)


def fasta_lines(df: DataFrame, name: str = "name", sequence: str = "sequence") -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(sequence)).alias("value"))
