"""Text formats: rows of the tables become files of each format and are read back."""

import uuid

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import ranges as R
from ..sources import motifs as M
from ..sources import sinks as K
from ..sources import text as X
from ..sources.shared import shared_path, stored_csv, stored_lines
from . import views as V
from .views import query


@query("""SELECT chrom, start, "end", CAST(line AS VARCHAR) AS name, score, CASE WHEN status = 'O' THEN '+' ELSE '-' END AS strand FROM v_regions""")
def bed_files(spark, sf):
    r = V.regions(spark, sf).select("chrom", "start", "end", F.col("line").alias("name"), "score", F.when(F.col("status") == "O", "+").otherwise("-").alias("strand"))
    return X.read_bed(spark, stored_lines(K.bed_lines(r))).select("chrom", "start", "end", "name", "score", "strand")


@query("""SELECT name, chrom, txStart AS start, txEnd AS "end", strand, cdsStart AS thick_start, cdsEnd AS thick_end, CAST(len(exonStarts) AS INTEGER) AS blocks,
CAST(list_sum(exonEnds) - list_sum(exonStarts) AS BIGINT) AS covered, exonStarts[3] - txStart AS last_block FROM v_genes""")
def typed_bed_files(spark, sf):
    """BED of twelve columns, with block sizes and starts as lists."""
    g = V.genes(spark, sf)
    sizes = F.array_join(F.zip_with("exonEnds", "exonStarts", lambda e, s: (e - s).cast("string")), ",")
    starts = F.array_join(F.transform("exonStarts", lambda s: (s - F.col("txStart")).cast("string")), ",")
    lines = g.select(K.tab("chrom", "txStart", "txEnd", "name", F.lit(0), "strand", "cdsStart", "cdsEnd", F.lit("0,0,0"), F.size("exonStarts"), sizes, starts))
    b = X.read_bed(spark, stored_lines(lines))
    covered = F.aggregate("blockSizes", F.lit(0).cast("long"), lambda s, x: s + x)
    return b.select("name", "chrom", "start", "end", "strand", F.col("thickStart").alias("thick_start"), F.col("thickEnd").alias("thick_end"), F.col("blockCount").alias("blocks"), covered.alias("covered"), F.get("blockStarts", F.lit(2)).alias("last_block"))


@query("SELECT chrom, strand, CASE WHEN strand = '+' THEN pos ELSE pos + 25 END AS pos FROM v_tags")
def bed_tag_files(spark, sf):
    lines = V.tags(spark, sf).select(K.tab("chrom", "pos", F.col("pos") + 25, F.lit("."), F.lit("."), "strand"))
    return X.read_bed_tags(spark, stored_lines(lines))


ELAND_SQL = "SELECT chrom, strand, CASE WHEN strand = '+' THEN pos - 1 ELSE pos + 3 END AS pos FROM v_tags"


@query(f"{ELAND_SQL} WHERE tag_id % 4 < 3")
def eland_result_files(spark, sf):
    """Result lines with one best hit; every fourth tag has none."""
    t = V.tags(spark, sf)
    kind = F.when(F.col("tag_id") % 4 < 3, F.concat(F.lit("U"), (F.col("tag_id") % 4).cast("string"))).otherwise("NM")
    lines = t.select(K.tab("tag_id", F.lit("ACGT"), kind, F.lit(1), F.lit(0), F.lit(0), F.concat("chrom", F.lit(".fa")), "pos", F.when(F.col("strand") == "+", "F").otherwise("R")))
    return X.read_eland(spark, stored_lines(lines))


@query(f"{ELAND_SQL} WHERE tag_id % 5 <> 0")
def eland_multi_files(spark, sf):
    """Multi lines with exactly one hit; every fifth tag has two."""
    hit = F.concat("chrom", F.lit(".fa:"), F.col("pos").cast("string"), F.when(F.col("strand") == "+", "F").otherwise("R"), F.lit("0"))
    twice = F.col("tag_id") % 5 == 0
    lines = V.tags(spark, sf).select(K.tab("tag_id", F.lit("ACGT"), F.when(twice, "2:0:0").otherwise("1:0:0"), F.when(twice, F.concat(hit, F.lit(",7F0"))).otherwise(hit)))
    return X.read_eland_multi(spark, stored_lines(lines))


@query("SELECT chrom, pos, round(value, 4) AS value FROM v_track")
def wiggle_files(spark, sf):
    path = shared_path(spark, "wiggle")
    K.write_wiggle(V.track(spark, sf), path, 10)
    return X.read_wiggle(spark, path)


@query("""SELECT p_type AS chrom, p_partkey // 500 * 5000 + 10 * (row_number() OVER (PARTITION BY p_type, p_partkey // 500 ORDER BY p_partkey) - 1) AS pos, CAST(p_size AS DOUBLE) AS value FROM part""")
def fixed_step_files(spark, sf):
    """fixedStep blocks of 500 parts; values stand at steps of 10 from the start that each block declares."""
    p = V.table(spark, sf, "part").select("p_type", F.floor(F.col("p_partkey") / 500).alias("block"), F.col("p_partkey").alias("place"), F.col("p_size").cast("string").alias("value"))
    heads = p.select("p_type", "block").distinct().select("p_type", "block", F.lit(-1).cast("long").alias("place"), F.concat(F.lit("fixedStep chrom="), "p_type", F.lit(" start="), (F.col("block") * 5000).cast("string"), F.lit(" step=10 span=10")).alias("value"))
    both = p.unionByName(heads.withColumn("value", F.expr("replace(value, p_type, translate(p_type, ' ', '_'))")))
    path = stored_lines(both.repartitionByRange("p_type", "block").sortWithinPartitions("p_type", "block", "place"))
    return X.read_wiggle(spark, path).withColumn("chrom", F.translate("chrom", "_", " "))


@query("""SELECT chrom, pos // 1000 AS bin, median(round(value, 4)) AS value FROM v_track GROUP BY ALL""")
def wiggle_bin_files(spark, sf):
    """Wiggle files read as one median per bin of 1000 positions."""
    path = shared_path(spark, "wiggle")
    K.write_wiggle(V.track(spark, sf), path, 10)
    return X.read_wiggle_bins(spark, path, 1000)


@query("""SELECT chrom, strand, pos, CAST(count(*) AS BIGINT) AS n, sum(l_quantity)::DOUBLE AS score FROM (SELECT l_returnflag AS chrom, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_orderkey * 25 + l_linenumber AS pos, l_quantity FROM lineitem)
WHERE l_quantity > 10 GROUP BY ALL""")
def binary_scan_files(spark, sf):
    """Scan hits written as binary files of fixed records and read back in ranges of them, above a cut-off."""
    hits = V.table(spark, sf, "lineitem").selectExpr("l_returnflag AS chrom", "CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand", "l_orderkey * 25 + l_linenumber AS pos", "l_quantity AS score")
    path, n = shared_path(spark, "scan"), V.parts(spark, sf)
    M.write_scan(hits, path, ["A", "N", "R"], n)
    return M.read_scan(spark, path, ["A", "N", "R"], 10.0).repartition(n, "chrom", "strand", "pos").groupBy("chrom", "strand", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS pair, side, chrom, pos, strand, CAST(errors AS INTEGER) AS errors FROM (
SELECT *, 'L' AS side, l_returnflag AS chrom, l_partkey AS pos, '+' AS strand, l_linenumber % 3 AS errors FROM lineitem UNION ALL SELECT *, 'R', l_linestatus, l_suppkey, '-', 0 FROM lineitem)""")
def eland_pair_files(spark, sf):
    """The hits of the N-th lines of two files; a table that gives each line's number its tag is joined back."""
    path, n = {}, V.parts(spark, sf)
    tag = F.expr("l_orderkey * 10 + l_linenumber")
    rows = V.table(spark, sf, "lineitem").repartitionByRange(n, "l_orderkey", "l_linenumber").sortWithinPartitions("l_orderkey", "l_linenumber")
    for side, hit in (("L", ("l_returnflag", "l_partkey", F.lit("F"), (F.col("l_linenumber") % 3).cast("string"))), ("R", ("l_linestatus", "l_suppkey", F.lit("R"), F.lit("0")))):
        chrom, pos, strand, errors = hit
        path[side] = stored_lines(rows.select(K.tab(tag, F.lit("ACGT"), F.lit("1:0:0"), F.concat(chrom, F.lit(".fa:"), F.col(pos).cast("string"), strand, errors))))
    names = X.numbered_lines(spark, path["L"], whole=True).select(F.col("line").alias("pair"), F.substring_index("value", "\t", 1).cast("long").alias("tag"))
    return X.read_eland_pairs(spark, path["L"], path["R"]).repartition(n, "pair").join(names.repartition(n, "pair"), "pair").select(F.col("tag").alias("pair"), "side", "chrom", "pos", "strand", "errors")


@query("""SELECT chrom, start, "end", summit, score, pvalue, fdr FROM v_peaks""")
def ma2c_files(spark, sf):
    p = V.peaks(spark, sf)
    names = {"chrom": "Chr", "start": "Start", "end": "End", "summit": "Summit", "score": "MA2Cscore", "pvalue": "-10*log10(PValue)", "fdr": "FDR"}
    return X.read_ma2c(spark, stored_csv(p.select(*[F.col(a).alias(b) for a, b in names.items()])))


@query("""SELECT chrom, start, "end", summit, fold AS score, pvalue, total_p AS fold, fdr FROM v_peaks""")
def mat_files(spark, sf):
    p = V.peaks(spark, sf)
    return X.read_mat(spark, stored_lines(p.select(K.tab("chrom", "start", "end", "name", "pvalue", "fold", "total_p", "fdr", "summit", F.col("end") - F.col("start")))))


@query("""SELECT chrom, start, "end", summit, name AS tags, pvalue, fold, fdr, 0.0::DOUBLE AS score FROM v_peaks""")
def macs_files(spark, sf):
    names = {"chrom": "chr", "start": "start", "end": "end", "summit": "summit", "name": "tags", "pvalue": "-10*log10(pvalue)", "fold": "fold_enrichment", "fdr": "FDR(%)"}
    return X.read_macs(spark, stored_csv(V.peaks(spark, sf).select(*[F.col(a).alias(b) for a, b in names.items()])))


@query("SELECT name, chrom, strand, txStart AS tx_start, cdsEnd AS cds_end, CAST(3 AS INTEGER) AS exons, CAST(list_sum(exonStarts) AS BIGINT) AS starts, CAST(list_sum(exonEnds) AS BIGINT) AS ends FROM v_genes")
def gene_table_files(spark, sf):
    g = V.genes(spark, sf)
    lists = [F.concat(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(",")) for c in ("exonStarts", "exonEnds")]
    t = X.read_genes(spark, stored_lines(g.select(K.tab("name", "chrom", "strand", "txStart", "txEnd", "cdsStart", "cdsEnd", F.size("exonStarts"), *lists))))
    sums = [F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x).alias(n) for c, n in (("exonStarts", "starts"), ("exonEnds", "ends"))]
    return t.select("name", "chrom", "strand", F.col("txStart").alias("tx_start"), F.col("cdsEnd").alias("cds_end"), F.col("exonCount").alias("exons"), *sums)


@query("SELECT 'list' || p_size % 2 AS list, 'g' || p_partkey AS name FROM part")
def gene_name_files(spark, sf):
    p = V.table(spark, sf, "part")
    paths = [stored_lines(p.filter(F.col("p_size") % 2 == i).select(F.concat(F.lit(" g"), F.col("p_partkey").cast("string"), F.lit("\tnote")).alias("value"))) for i in (0, 1)]
    names = X.read_gene_names(spark, paths)
    return names.select(F.when(F.col("grp").contains(paths[0].rsplit("/", 1)[-1]), "list0").otherwise("list1").alias("list"), "name")


@query("SELECT chrom, length FROM v_lengths")
def chrom_length_files(spark, sf):
    return X.read_chrom_lengths(spark, stored_lines(V.lengths(spark, sf).select(F.concat_ws(" ", "chrom", F.col("length").cast("string")).alias("value"))))


@query("SELECT 'g' || p_partkey AS name, translate(upper(p_name), ' ', '') AS sequence FROM part")
def fasta_files(spark, sf):
    p = V.table(spark, sf, "part").select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("name"), F.translate(F.upper("p_name"), " ", "\n").alias("sequence"))
    return X.read_fasta(spark, stored_lines(K.fasta_lines(p)))


@query("SELECT '>r' || p_partkey AS value FROM part UNION ALL SELECT upper(p_name) FROM part")
def fastq_files(spark, sf):
    entry = F.concat(F.lit("@r"), F.col("p_partkey").cast("string"), F.lit("\n"), F.upper("p_name"), F.lit("\n+\n"), F.lit("@"))
    path = stored_lines(V.table(spark, sf, "part").select(entry.alias("value")))
    return X.fastq_to_fasta(X.numbered_lines(spark, path)).select("value")


@query("""SELECT event_id, coalesce(nullif(regexp_extract(props, '"k": *(-?[0-9]+)', 1), ''), 'NA') AS "Index", event_type AS "Factor", 'NA' AS "Lab" FROM events""")
def metadata_records(spark, sf):
    """Records of ``key = value`` lines with comments, one per event; fields that a record lacks are NA."""
    e = V.table(spark, sf, "events")
    k = F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1)
    text = F.array(F.lit("# a record"), F.concat(F.lit("index= "), k), F.concat(F.lit("Factor ="), "event_type", F.lit(" # kind")), F.lit("no pair"))
    numbered = e.select(F.col("event_id").cast("string").alias("file"), F.posexplode(text).alias("line", "value"))
    return X.parse_key_values(numbered, ["Index", "Factor", "Lab"]).withColumn("file", F.col("file").cast("long")).withColumnRenamed("file", "event_id")


@query("SELECT l_returnflag AS chrom, l_orderkey * 100 AS start, l_orderkey * 100 + l_linenumber AS \"end\", CASE WHEN l_linenumber <> 3 THEN l_discount END AS x FROM lineitem")
def histone_matrix_files(spark, sf):
    m = V.table(spark, sf, "lineitem").select(F.concat_ws(".", "l_returnflag", (F.col("l_orderkey") * 100).cast("string"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("string")).alias("location"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("x"))
    return X.read_matrix(spark, stored_csv(m)).select("chrom", "start", "end", F.col("x").cast("double").alias("x"))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS segment FROM customer")
def metadata_table_files(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("segment"))
    path = stored_lines(c.select(K.tab("c_custkey", "c_name", "segment")))
    return X.read_table(spark, path, "c_custkey long, c_name string, segment string")


@query("""SELECT chrom, pos - 6 AS start, pos - 5 + 9 AS "end", round(value, 4) AS score FROM v_track""")
def gff_files(spark, sf):
    """A track as GFF lines of spans of 10 from 5 before each point, read back as BED rows."""
    path = stored_lines(K.gff_lines(V.track(spark, sf), 10, shift=5))
    return X.gff_to_bed(X.lines(spark, path)).select("chrom", "start", "end", F.round("score", 4).alias("score"))


@query("SELECT chrom, count(*) AS n, round(sum(score), 2) AS total FROM v_regions WHERE chrom = 'A' GROUP BY ALL")
def one_chromosome_files(spark, sf):
    """Intervals in one folder per chromosome, of which one is read."""
    path = shared_path(spark, "parts")
    K.write_by_chrom(V.regions(spark, sf), path)
    return spark.read.parquet(path).filter("chrom = 'A'").groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 2).alias("total"))


@query("SELECT chrom, strand, pos, count(*) AS n FROM v_tags GROUP BY ALL")
def tag_wiggle_files(spark, sf):
    """Tags as wiggle of positions by strand."""
    path, n = shared_path(spark, "wiggle"), V.parts(spark, sf)
    K.write_tag_wiggle(V.tags(spark, sf), path, 25, 50_000, n)
    return X.read_wiggle_tags(spark, path, n).repartition(n, "chrom", "strand", "pos").groupBy("chrom", "strand", "pos").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT a.chrom, a.start, a."end", count(*) AS n, CAST(sum(least(a."end", b."end") - greatest(a.start, b.start)) AS BIGINT) AS shared FROM (SELECT chrom, start, "end" FROM v_regions WHERE line % 2 = 0) a JOIN (SELECT chrom, start, "end" FROM v_regions WHERE line % 2 = 1) b
ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" GROUP BY ALL""")
def saved_interval_join(spark, sf):
    """Two tables saved in folders of chromosomes and buckets of bins, joined where their rows lie."""
    r, n = V.regions(spark, sf), V.parts(spark, sf)
    names = [f"intervals_{uuid.uuid4().hex}" for _ in range(2)]
    for i, name in enumerate(names):
        K.save_intervals(r.filter(F.col("line") % 2 == i).select("chrom", "start", "end"), name, 4096, n, shared_path(spark, "saved"))
    pairs = K.saved_overlaps(spark, *names, 4096).repartition(n, "chrom", "start", "end")
    return pairs.groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("end", "b_end") - F.greatest("start", "b_start")).alias("shared"))


@query("""SELECT translate(a.chrom, ' ', '_') AS chrom, count(*) AS n, CAST(sum(least(a."end", b."end") - greatest(a.start, b.start)) AS BIGINT) AS shared FROM v_peaks a JOIN v_peaks b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" AND a.fold >= 12 AND b.fold < 12 GROUP BY ALL""")
def overlap_of_bed_files(spark, sf):
    """Two BED files joined where they overlap."""
    p = V.peaks(spark, sf).withColumn("chrom", F.translate("chrom", " ", "_"))
    a, b = (X.read_bed(spark, stored_lines(K.bed_lines(p.filter(w).select("chrom", "start", "end")))).select("chrom", "start", "end") for w in ("fold >= 12", "fold < 12"))
    both = R.overlap_pairs(a, b, 1 << 14)
    return both.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("end", "b_end") - F.greatest("start", "b_start")).alias("shared"))


@query("""SELECT p_partkey, CAST(p_size % 2 = 0 AND p_size % 3 = 0 AS BOOLEAN) AS x_and, CAST(p_size % 2 = 0 OR p_size % 3 = 0 AS BOOLEAN) AS x_or, CAST((p_size % 2 = 0) <> (p_size % 3 = 0) AS BOOLEAN) AS x_xor, p_size % 2 <> 0 AS x_not,
CASE WHEN p_size % 3 = 0 THEN p_partkey END AS chosen FROM part""")
def mask_arrays(spark, sf):
    p = V.table(spark, sf, "part")
    a, b = F.array(F.expr("p_size % 2 = 0")), F.array(F.expr("p_size % 3 = 0"))
    first = F.lit(0)
    return p.select("p_partkey", F.get(A.both(a, b), first).alias("x_and"), F.get(A.either(a, b), first).alias("x_or"), F.get(A.exactly_one(a, b), first).alias("x_xor"), F.get(A.negated(a), first).alias("x_not"), F.get(A.pick_where(F.array("p_partkey"), b), first).alias("chosen"))
