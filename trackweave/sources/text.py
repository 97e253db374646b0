"""Readers of text formats. Lines are parsed by column expressions; where a line depends on earlier ones, splits of a file are read apart and pass on what they end with."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.strings import standard_chromosome
from ..operators.binning import bin_values

# BED columns and types in order.
BED = ["chrom", "start", "end", "name", "score", "strand", "thickStart", "thickEnd", "itemRgb", "blockCount", "blockSizes", "blockStarts"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, value): lines with the byte at which their split of the file begins; ids count the lines of a split one by one.

    Files are cut as ``spark.sql.files.maxPartitionBytes`` says; the order of a file's lines is that of (block, id). A compressed file is one split.
    """
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def numbered_lines(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(file, line, value): lines that are not empty, with their place in the file, from 0; ``whole``: the files of the folder, in the order of their names, are one.

    Splits number their lines on from the counts of the splits before: one row per split is counted and sent to all tasks, so that lines stay where they are read, and no file is read by one task.
    """
    rows = split_lines(spark, path)
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    order = W.partitionBy(F.lit(0)).orderBy("file", "block") if whole else W.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("file", "block", (before - F.col("least")).alias("shift"))
    return rows.filter("value <> ''").join(F.broadcast(shift), ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("line"), "value")


def with_records(rows: DataFrame, begins: Column, parts: int | None = None) -> DataFrame:
    """Split lines with ``record``: how many lines of the file up to this one begin a record; splits count on from the ones before. Splits are dealt to ``parts`` tasks, the session's number if not given."""
    by = W.partitionBy("file", "block").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    flagged = rows.withColumn("begins", F.coalesce(begins, F.lit(False)).cast("long"))
    dealt = flagged.repartitionByRange(parts, "file", "block") if parts else flagged
    counts = flagged.groupBy("file", "block").agg(F.sum("begins").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = dealt.withColumn("record", F.sum("begins").over(by))
    return inner.join(F.broadcast(counts.select("file", "block", before.alias("before"))), ["file", "block"]).select(*rows.columns, (F.col("record") + F.col("before")).alias("record"))


def content_lines(df: DataFrame) -> DataFrame:
    v = F.trim("value")
    return df.filter((v != "") & ~v.startswith("#") & ~v.startswith("track") & ~v.startswith("browser"))


def long_list(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED of 3 to 12 columns: missing ones are null, starts below 0 become 0, block lists are arrays, Roman chromosomes get their usual name."""
    f = F.split(F.trim("value"), r"\s+")
    rows = content_lines(lines(spark, path)).select(f.alias("f")).filter(F.size("f") >= 3)
    kinds = {"start": "long", "end": "long", "score": "double", "thickStart": "long", "thickEnd": "long", "blockCount": "int"}
    columns = []
    for i, name in enumerate(BED):
        c = F.get("f", F.lit(i))
        if name in ("blockSizes", "blockStarts"):
            columns.append(long_list(c).alias(name))
        elif name == "start":
            columns.append(F.greatest(c.cast("long"), F.lit(0)).alias(name))
        elif name == "chrom":
            columns.append(standard_chromosome(c).alias(name))
        else:
            columns.append((c.try_cast(kinds[name]) if name in kinds else c).alias(name))
    return rows.select(*columns)


def read_bed_tags(spark: SparkSession, path: str) -> DataFrame:
    """Tags of a BED file: chrom, strand, pos (start of plus, end of minus tags; no strand: plus); other strands are an error."""
    f = F.split(F.trim("value"), r"\s+")
    rows = content_lines(lines(spark, path)).select(f.alias("f"))
    strand = F.when(F.size("f") < 6, "+").otherwise(F.get("f", F.lit(5)))
    pos = F.when(strand == "+", F.get("f", F.lit(1)).cast("long")).when(strand == "-", F.get("f", F.lit(2)).cast("long")).otherwise(F.raise_error(F.concat(F.lit("unknown strand: "), strand)).cast("long"))
    return rows.select(F.get("f", F.lit(0)).alias("chrom"), strand.alias("strand"), pos.alias("pos"))


def read_eland(spark: SparkSession, path: str) -> DataFrame:
    """Tags of ELAND result lines with one best hit (U0, U1, U2): forward pos - 1, reverse pos + length - 1."""
    f = F.split("value", "\t")
    rows = lines(spark, path).select(f.alias("f")).filter(F.get("f", F.lit(2)).isin("U0", "U1", "U2"))
    forward = F.get("f", F.lit(8)) == "F"
    pos = F.get("f", F.lit(7)).cast("long")
    return rows.select(
        F.regexp_replace(F.get("f", F.lit(6)), r"\.fa$", "").alias("chrom"),
        F.when(forward, "+").otherwise("-").alias("strand"),
        F.when(forward, pos - 1).otherwise(pos + F.length(F.get("f", F.lit(1))) - 1).alias("pos"),
    )


def eland_hits(value: Column) -> Column:
    """Hits of an ELAND multi line (name, sequence, x:y:z, chr.fa:posStrandErrors,...) as array<struct<chrom, pos, strand, errors>>; a hit without chromosome has the last one's."""
    f = F.split(value, "\t")
    parts = F.split(F.get(f, F.lit(3)), ",")
    named = F.transform(parts, lambda x, i: F.struct(F.when(x.contains(":"), F.regexp_extract(x, r"^(.*?)(?:\.fa)?:", 1)).alias("chrom"), F.regexp_extract(x, r"(\d+)[FR](\d+)$", 1).cast("long").alias("pos"), F.regexp_extract(x, r"\d+([FR])\d+$", 1).alias("fr"), F.regexp_extract(x, r"[FR](\d+)$", 1).cast("int").alias("errors")))
    carried = F.transform(named, lambda h, i: F.struct(F.element_at(F.filter(F.transform(F.slice(named, 1, i + 1), lambda q: q.chrom), lambda c: c.isNotNull()), -1).alias("chrom"), h.pos.alias("pos"), F.when(h.fr == "F", "+").otherwise("-").alias("strand"), h.errors.alias("errors")))
    return F.when(F.get(f, F.lit(3)).isNotNull() & (F.get(f, F.lit(3)) != ""), carried)


def read_eland_multi(spark: SparkSession, path: str) -> DataFrame:
    """Tags of ELAND multi lines that have exactly one hit."""
    f = F.split("value", "\t")
    hits = F.aggregate(F.split(F.get(f, F.lit(2)), ":"), F.lit(0), lambda s, x: s + F.coalesce(x.try_cast("int"), F.lit(0)))
    rows = lines(spark, path).filter(F.get(f, F.lit(2)).rlike(r"^\d+:\d+:\d+$")).filter(hits == 1)
    one = rows.select(F.length(F.get(f, F.lit(1))).alias("n"), F.get(eland_hits(F.col("value")), F.lit(0)).alias("h"))
    return one.select("h.chrom", "h.strand", F.when(F.col("h.strand") == "+", F.col("h.pos") - 1).otherwise(F.col("h.pos") + F.col("n") - 1).alias("pos"))


def read_eland_pairs(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Hits of the N-th lines of two ELAND multi files: pair, side, chrom, pos, strand, errors. A folder is one file, its parts in the order of their names; both may be cut unlike."""

    def side(path: str, name: str) -> DataFrame:
        rows = numbered_lines(spark, path, whole=True).select(F.col("line").cast("long").alias("pair"), F.explode(eland_hits(F.col("value"))).alias("h"))
        return rows.select("pair", F.lit(name).alias("side"), "h.chrom", "h.pos", "h.strand", "h.errors")

    return side(left, "L").unionByName(side(right, "R"))


def wiggle_points(rows: DataFrame) -> DataFrame:
    """(chrom, pos, value) of wiggle lines (file, block, id, value): variableStep and fixedStep; a fixedStep value stands at start + step * (its number - 1).

    Lines are read in order inside their split. What a split begins with, the last declaration and the number of values since, comes from one row per split, so that a
    file may be cut anywhere. Values before the first declaration of a file are left out.
    """
    v = F.trim("value")
    body = rows.filter(~v.startswith("track") & ~v.startswith("#") & ~v.startswith("browser") & (v != ""))
    declared = v.startswith("variableStep") | v.startswith("fixedStep")

    def field(name: str, pattern: str) -> Column:
        return F.regexp_extract(v, rf"{name}=({pattern})", 1)

    said = F.struct(
        field("chrom", r"\S+").alias("chrom"), v.startswith("fixedStep").alias("fixed"),
        F.coalesce(field("start", r"\d+").try_cast("long"), F.lit(0)).alias("start"), F.coalesce(field("step", r"\d+").try_cast("long"), F.lit(1)).alias("step"),
    )
    rows = body.select("file", "block", "id", F.when(declared, said).alias("said"), (~declared).cast("long").alias("one"), F.when(~declared, F.split(v, r"\s+")).alias("f"))
    # per split: its last declaration, all values and those after it
    last = rows.groupBy("file", "block").agg(F.max_by("said", F.when(F.col("said").isNotNull(), F.col("id"))).alias("said"), F.max(F.when(F.col("said").isNotNull(), F.col("id"))).alias("at"), F.sum("one").alias("n"))
    since = rows.join(last.select("file", "block", "at"), ["file", "block"]).filter("at is not null and id > at").groupBy("file", "block").agg(F.sum("one").alias("rest"))
    upto = W.partitionBy("file").orderBy("block")
    spine = last.join(since, ["file", "block"], "left").withColumn("total", F.sum("n").over(upto.rowsBetween(W.unboundedPreceding, 0)))
    opened = F.when(F.col("said").isNotNull(), F.struct("said", (F.col("total") - F.coalesce("rest", F.lit(0))).alias("values")))
    earlier = F.last(opened, True).over(upto.rowsBetween(W.unboundedPreceding, -1))
    spine = spine.select("file", "block", earlier.alias("earlier"), (F.col("total") - F.col("n")).alias("before"))
    by = W.partitionBy("file", "block").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    inner = rows.withColumns({"k": F.sum("one").over(by)})
    inner = inner.withColumn("own", F.last(F.when(F.col("said").isNotNull(), F.struct("said", F.col("k").alias("values"))), True).over(by)).filter("one = 1")
    placed = inner.join(F.broadcast(spine), ["file", "block"])
    state = F.coalesce("own.said", "earlier.said")
    nth = F.when(F.col("own").isNotNull(), F.col("k") - F.col("own.values")).otherwise(F.col("k") + F.col("before") - F.col("earlier.values")) - 1
    known = placed.select(state.alias("s"), nth.alias("nth"), "f").filter("s is not null")
    pos = F.when(F.col("s.fixed"), F.col("s.start") + F.col("s.step") * F.col("nth")).otherwise(F.get("f", F.lit(0)).try_cast("long"))
    value = F.when(F.col("s.fixed"), F.get("f", F.lit(0))).otherwise(F.get("f", F.lit(1))).try_cast("double")
    return known.select(F.col("s.chrom").alias("chrom"), pos.alias("pos"), value.alias("value")).filter("pos is not null and value is not null")


def read_wiggle(spark: SparkSession, path: str) -> DataFrame:
    return wiggle_points(split_lines(spark, path))


def read_wiggle_bins(spark: SparkSession, path: str, size: int, method: str = "median") -> DataFrame:
    """Values of wiggle files brought to one per bin of ``size`` positions: chrom, bin, value."""
    return bin_values(read_wiggle(spark, path), size, method)


def read_wiggle_tags(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """(chrom, strand, pos) of tags written as wiggle: positions without values below declarations with strand=0 (plus) or 1 (minus). ``parts``: tasks to which splits and records are dealt."""
    rows = split_lines(spark, path).filter(~F.col("value").rlike("^(track|browser|#)") & (F.trim("value") != ""))
    head = F.col("value").startswith("variableStep")
    numbered = with_records(rows, head, parts)
    said = numbered.filter(head).select("file", "record", F.regexp_extract("value", r"chrom=(\S+)", 1).alias("chrom"), F.when(F.col("value").rlike("strand=1"), "-").otherwise("+").alias("strand"))
    points = numbered.filter(~head)
    if parts:
        points, said = (x.repartition(parts, "file", "record") for x in (points, said))
    return points.join(said, ["file", "record"]).select("chrom", "strand", F.col("value").try_cast("long").alias("pos")).filter("pos is not null")


def wiggle_span(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: the span of its last declaration (1 if none)."""
    rows = numbered_lines(spark, path).filter(F.col("value").rlike(r"^(variable|fixed)Step"))
    span = F.regexp_extract("value", r"span=(\d+)", 1).try_cast("int")
    return rows.groupBy("file").agg(F.coalesce(F.max_by(span, "line"), F.lit(1)).alias("span"))


def read_ma2c(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.csv(path, sep="\t", header=True, comment="#")
    c = {x.strip(): x for x in t.columns}
    return t.select(
        F.col(f"`{c['Chr']}`").alias("chrom"), F.col(f"`{c['Start']}`").cast("long").alias("start"), F.col(f"`{c['End']}`").cast("long").alias("end"), F.col(f"`{c['Summit']}`").cast("long").alias("summit"),
        F.col(f"`{c['MA2Cscore']}`").cast("double").alias("score"), F.col(f"`{c['-10*log10(PValue)']}`").cast("double").alias("pvalue"), F.col(f"`{c['FDR']}`").try_cast("double").alias("fdr"),
    ).filter("chrom is not null and start is not null")


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """MAT peaks by position: chrom, start, end, peak position, MAT score, p-value, FDR."""
    f = F.split("value", "\t")
    rows = content_lines(lines(spark, path)).select(f.alias("f")).filter(F.get("f", F.lit(1)).try_cast("long").isNotNull())

    def at(i: int, kind: str) -> Column:
        return F.get("f", F.lit(i)).try_cast(kind)

    return rows.select(F.get("f", F.lit(0)).alias("chrom"), at(1, "long").alias("start"), at(2, "long").alias("end"), at(8, "long").alias("summit"), at(5, "double").alias("score"), at(4, "double").alias("pvalue"), at(6, "double").alias("fold"), at(7, "double").alias("fdr"))


def read_macs(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.csv(path, sep="\t", header=True, comment="#")
    names = {"chr": "chrom", "start": "start", "end": "end", "summit": "summit", "tags": "tags", "-10*log10(pvalue)": "pvalue", "fold_enrichment": "fold", "FDR(%)": "fdr"}
    kinds = {"start": "long", "end": "long", "summit": "long", "tags": "long", "pvalue": "double", "fold": "double", "fdr": "double"}
    columns = [F.col(f"`{a}`").cast(kinds.get(b, "string")).alias(b) for a, b in names.items() if a in t.columns]
    return t.select(*columns, F.lit(0.0).alias("score"))


PEAK_FORMATS = {"bed": read_bed, "ma2c": read_ma2c, "mat": read_mat, "macs": read_macs}


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, comment="#", nullValue="NA")


def read_matrix(spark: SparkSession, path: str, location: str = "location") -> DataFrame:
    """A tab-delimited matrix with header and NA; its location chrom.start.end becomes three columns."""
    t = spark.read.csv(path, sep="\t", header=True, nullValue="NA", inferSchema=True)
    f = F.split(location, r"\.")
    return t.withColumns({"chrom": F.get(f, F.lit(0)), "start": F.get(f, F.lit(1)).cast("long"), "end": F.get(f, F.lit(2)).cast("long")})


def read_chrom_lengths(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    return lines(spark, path).filter("trim(value) <> ''").select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("length"))


def read_gene_names(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(grp, name): the first word of each line, grouped by file."""
    return spark.read.text(paths).select(F.input_file_name().alias("grp"), F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).alias("name")).filter("name <> ''")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """Tab-delimited gene table: name, chrom, strand, txStart, txEnd, cdsStart, cdsEnd, exonCount, exonStarts, exonEnds (comma lists)."""
    kind = "name string, chrom string, strand string, txStart long, txEnd long, cdsStart long, cdsEnd long, exonCount int, exonStarts string, exonEnds string"
    t = spark.read.csv(path, sep="\t", schema=kind, comment="#")
    return t.withColumns({"exonStarts": long_list(F.col("exonStarts")), "exonEnds": long_list(F.col("exonEnds"))})


MOST_NAMES = 1000


def read_genes_jdbc(spark: SparkSession, url: str, table: str, names: DataFrame | None = None, chroms: list[str] | None = None, parts: int = 1, **options: str) -> DataFrame:
    """The same from a database, read in ``parts`` ranges of txStart, the bounds of which the database is asked for.

    The chromosomes, and the ``names`` (column name) if they are MOST_NAMES at most, go to the database as conditions; more names limit what was read by a semi-join.
    """
    source = {"url": url, **options}
    if parts > 1:
        ends = spark.read.format("jdbc").options(**source, query=f'SELECT MIN("txStart") AS "lo", MAX("txStart") AS "hi" FROM {table}').load().first()
        if ends.lo is not None and ends.hi > ends.lo:
            source |= {"partitionColumn": "txStart", "lowerBound": str(ends.lo), "upperBound": str(ends.hi), "numPartitions": str(parts)}
    t = spark.read.format("jdbc").options(**source, dbtable=table).load()
    if chroms is not None:
        t = t.filter(F.col("chrom").isin(chroms))
    if names is not None:
        few = [r.name for r in names.select("name").distinct().limit(MOST_NAMES + 1).collect()]
        t = t.filter(F.col("name").isin(few)) if len(few) <= MOST_NAMES else t.join(names.select("name"), "name", "left_semi")
    return t.withColumns({"exonStarts": long_list(F.col("exonStarts").cast("string")), "exonEnds": long_list(F.col("exonEnds").cast("string"))})


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence) per entry."""
    parts = spark.read.option("lineSep", ">").text(path).filter("trim(value) <> ''")
    head = F.substring_index("value", "\n", 1)
    return parts.select(F.get(F.split(F.trim(head), r"\s+"), F.lit(0)).alias("name"), F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "").alias("sequence"))


def fastq_to_fasta(numbered: DataFrame) -> DataFrame:
    """(file, line, value) of FASTQ entries of four lines as FASTA lines, in order."""
    kept = numbered.filter((F.col("line") % 4) < 2)
    return kept.select("file", "line", F.when(F.col("line") % 4 == 0, F.concat(F.lit(">"), F.substring("value", 2, 1 << 30))).otherwise(F.col("value")).alias("value"))


def gff_to_bed(df: DataFrame) -> DataFrame:
    """BED rows of GFF lines (value); start - 1, strand + by default, malformed lines left out."""
    f = F.split("value", "\t")
    start, end = F.get(f, F.lit(3)).try_cast("long"), F.get(f, F.lit(4)).try_cast("long")
    rows = df.filter(~F.col("value").startswith("#")).select(
        F.get(f, F.lit(0)).alias("chrom"), (start - 1).alias("start"), end.alias("end"), F.coalesce(F.get(f, F.lit(8)), F.lit(".")).alias("name"),
        F.coalesce(F.get(f, F.lit(5)).try_cast("double"), F.lit(0.0)).alias("score"), F.when(F.get(f, F.lit(6)).isin("+", "-"), F.get(f, F.lit(6))).otherwise("+").alias("strand"),
    )
    return rows.filter("start is not null and end is not null")


# Fields of a metadata record, in order.
NDD_FIELDS = ["Index", "Factor", "Organism", "Assembly", "Cell", "Platform", "Status", "Raw", "XLS", "Wiggle", "Lab", "Paper", "Condition", "GEO", "PubMED", "Type", "Comment", "Submit"]


def parse_key_values(numbered: DataFrame, fields: list[str]) -> DataFrame:
    """One row per file of ``key = value`` lines (file, line, value): the named fields, NA where missing; # starts a comment."""
    text = F.trim(F.regexp_replace("value", "#.*$", ""))
    key, value = F.lower(F.trim(F.substring_index(text, "=", 1))), F.trim(F.expr("substring(trim(regexp_replace(value, '#.*$', '')), instr(trim(regexp_replace(value, '#.*$', '')), '=') + 1)"))
    rows = numbered.filter(text.contains("=")).select("file", key.alias("key"), value.alias("v"))
    wide = rows.groupBy("file").pivot("key", [f.lower() for f in fields]).agg(F.first("v"))
    return wide.select("file", *[F.when(F.coalesce(F.col(f.lower()), F.lit("")) == "", "NA").otherwise(F.col(f.lower())).alias(f) for f in fields])


def read_ndd(spark: SparkSession, path: str, fields: list[str] = NDD_FIELDS) -> DataFrame:
    return parse_key_values(numbered_lines(spark, path), fields)
