"""Readers, writers and streams on small files."""

import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from trackweave import plans
from trackweave.functions import pwm as P
from trackweave.operators import windows as O
from trackweave.sources import motifs as M
from trackweave.sources import sinks as K
from trackweave.sources import text as X
from trackweave.streaming.regions import stream_bins, stream_peaks, stream_regions


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(p)


def test_bed(spark, tmp_path):
    path = put(tmp_path, "a.bed", "track name=x\n# c\nI\t-5\t20\tp\t3.5\t+\n\nchr2 7 9\nchr3\t1\t50\tn\t0\t-\t1\t50\t0\t2\t10,20,\t0,30\n")
    rows = X.read_bed(spark, path).collect()
    assert [(r.chrom, r.start, r.end, r.strand) for r in rows] == [("chrI", 0, 20, "+"), ("chr2", 7, 9, None), ("chr3", 1, 50, "-")]
    assert rows[2].blockSizes == [10, 20] and rows[2].blockStarts == [0, 30]
    tags = X.read_bed_tags(spark, put(tmp_path, "t.bed", "c\t1\t26\t.\t.\t+\nc\t2\t27\t.\t.\t-\nc\t9\t34\n")).collect()
    assert [(t.strand, t.pos) for t in tags] == [("+", 1), ("-", 27), ("+", 9)]


def test_wiggle(spark, tmp_path):
    path = put(tmp_path, "a.wig", "track x\nvariableStep chrom=c1 span=5\n10\t1.5\n3 2\nfixedStep chrom=c2 start=100 step=10 span=7\n1\n2\n\n3\n")
    assert sorted(map(tuple, X.read_wiggle(spark, path).collect())) == [("c1", 3, 2.0), ("c1", 10, 1.5), ("c2", 100, 1.0), ("c2", 110, 2.0), ("c2", 120, 3.0)]
    assert X.wiggle_span(spark, path).first().span == 7
    out = str(tmp_path / "out")
    K.write_wiggle(X.read_wiggle(spark, path), out, 7)
    back = "\n".join(x.read_text().strip() for x in sorted((tmp_path / "out").glob("part-*")) if x.stat().st_size)
    again = X.read_wiggle(spark, put(tmp_path, "b.wig", back))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, X.read_wiggle(spark, path).collect()))


@pytest.fixture
def cut_at(spark):
    """Cuts files into splits of so many bytes."""

    def set_(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield set_
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def wiggle_by_hand(text):
    out, state = [], None
    for line in text.splitlines():
        f = line.split()
        if not f or f[0] in ("track", "#"):
            continue
        if f[0] in ("variableStep", "fixedStep"):
            d = dict(x.split("=") for x in f[1:])
            state = [f[0] == "fixedStep", d["chrom"], int(d.get("start", 0)), int(d.get("step", 1))]
        elif state and state[0]:
            out.append((state[1], state[2], float(f[0])))
            state[2] += state[3]
        elif state:
            out.append((state[1], int(f[0]), float(f[1])))
    return sorted(out)


@pytest.mark.parametrize("size", [17, 64, 301, 4096, 65536])
def test_files_cut_anywhere_give_the_same_rows(spark, tmp_path, cut_at, size):
    r = random.Random(5)
    text = ["9", "track x"]
    for block in range(60 if size > 64 else 12):
        fixed = r.random() < 0.6
        text.append(f"fixedStep chrom=c{r.randint(1, 3)} start={r.randint(0, 10**6)} step={r.randint(1, 30)}" if fixed else f"variableStep chrom=c{r.randint(1, 3)} span=5")
        for i in range(r.choice([0, 1, 5, 200 if size > 64 else 20])):
            text += [""] * (r.random() < 0.05) + ["# note"] * (r.random() < 0.05)
            text.append(f"{r.randint(0, 99)}" if fixed else f"{block * 1000 + i}\t{r.randint(0, 99)}")
    wig, ends = "\n".join(text) + "\n", ["r\n", "\n"]
    fastq = "".join(f"@r{i}\n{'ACGT' * r.randint(1, 9)}\n+\n{'@I' * r.randint(1, 9)}\n" for i in range(300 if size > 64 else 30))
    left = "".join(f"n{i}\tA\t1:0:0\tchr1.fa:{i}F0\n" for i in range(300 if size > 64 else 30))
    a, b, c = put(tmp_path, "a.wig", wig), put(tmp_path, "b.fq", fastq), put(tmp_path, "c.txt", left)
    d = put(tmp_path, "d.txt", left.replace("F0", "R1").replace("n", ends[1]))
    cut_at(size)
    splits = X.split_lines(spark, a).select("block").distinct().count()
    assert splits > len(wig) // size // 2 or size > len(wig)
    assert sorted(map(tuple, X.read_wiggle(spark, a).collect())) == wiggle_by_hand(wig)
    fasta = [x.value for x in X.fastq_to_fasta(X.numbered_lines(spark, b)).orderBy("line").collect()]
    assert fasta == [(">" + x[1:] if i % 4 == 0 else x) for i, x in enumerate(fastq.splitlines()) if i % 4 < 2]
    pairs = X.read_eland_pairs(spark, c, d).collect()
    assert sorted((p.pair, p.pos) for p in pairs if p.side == "L") == [(i, i) for i in range(left.count("\n"))]
    assert all(p.pair == 2 * p.pos + 1 for p in pairs if p.side == "R")
    # several files at once
    both = tmp_path / "both"
    both.mkdir()
    put(both, "1", wig)
    put(both, "2", "3\n" + wig)
    assert sorted(map(tuple, X.read_wiggle(spark, str(both)).collect())) == sorted(wiggle_by_hand(wig) * 2)


def test_eland(spark, tmp_path):
    result = X.read_eland(spark, put(tmp_path, "r", "n\tACGT\tU0\t1\t0\t0\tchr1.fa\t10\tF\nn\tACGT\tU1\t1\t0\t0\tchr1.fa\t10\tR\nn\tACGT\tR0\t2\t0\t0\n"))
    assert [tuple(r) for r in result.collect()] == [("chr1", "+", 9), ("chr1", "-", 13)]
    multi = X.read_eland_multi(spark, put(tmp_path, "m", "n\tACGTA\t1:0:0\tchr2.fa:50R1\nn\tACGTA\t1:1:0\tchr2.fa:50R1,60F0\nn\tACGTA\tNM\n"))
    assert [tuple(r) for r in multi.collect()] == [("chr2", "-", 54)]
    pairs = X.read_eland_pairs(spark, put(tmp_path, "l", "n\tA\t1:0:0\tchr1.fa:5F0,9R1,chr2.fa:7F2\n"), put(tmp_path, "q", "n\tA\t1:0:0\tchr1.fa:50R0\n"))
    assert sorted((r.side, r.chrom, r.pos, r.strand, r.errors) for r in pairs.collect()) == [("L", "chr1", 5, "+", 0), ("L", "chr1", 9, "-", 1), ("L", "chr2", 7, "+", 2), ("R", "chr1", 50, "-", 0)]


def test_peak_tables(spark, tmp_path):
    ma2c = X.read_ma2c(spark, put(tmp_path, "a.xls", "Chr\tStart\tEnd\tSummit\tLength\tName\tMA2Cscore\t-10*log10(PValue)\tFDR\nchrI\t1\t9\t4\t8\tp\t2.5\t35.5\t8.1\n")).collect()
    assert [(r.chrom, r.start, r.summit, r.pvalue) for r in ma2c] == [("chrI", 1, 4, 35.5)]
    mat = X.read_mat(spark, put(tmp_path, "b.xls", "Chr\tSt\tEnd\nchr1\t5\t9\tn\t60.1\t3.8\t2.9\t2.7\t4\t4\n#x\n")).collect()
    assert [(r.chrom, r.start, r.score, r.pvalue, r.fold, r.fdr, r.summit) for r in mat] == [("chr1", 5, 3.8, 60.1, 2.9, 2.7, 4)]
    macs = X.read_macs(spark, put(tmp_path, "c.xls", "chr\tstart\tend\tsummit\ttags\t-10*log10(pvalue)\tfold_enrichment\tFDR(%)\nc\t1\t2\t3\t4\t5.5\t6.5\t7.5\n")).collect()
    assert [(r.chrom, r.tags, r.fdr, r.score) for r in macs] == [("c", 4, 7.5, 0.0)]


def test_lists_and_records(spark, tmp_path):
    ndd = X.read_ndd(spark, put(tmp_path, "a.ndd", "# c\nIndex= 7\nFactor = ER alpha\nGEO=GPL1:GSE2\nnonsense\n")).first()
    assert (ndd.Index, ndd.Factor, ndd.GEO, ndd.Lab) == ("7", "ER alpha", "GPL1:GSE2", "NA")
    assert [tuple(r) for r in X.read_chrom_lengths(spark, put(tmp_path, "s", "chr1 100\nchr2\t50\n")).collect()] == [("chr1", 100), ("chr2", 50)]
    genes = X.read_genes(spark, put(tmp_path, "g", "n\tc\t+\t1\t9\t2\t8\t2\t1,5,\t3,9,\n")).first()
    assert genes.exonStarts == [1, 5] and genes.exonEnds == [3, 9]
    fasta = X.read_fasta(spark, put(tmp_path, "f", ">a x\nAC\nGT\n>b\nTT\n")).collect()
    assert sorted(map(tuple, fasta)) == [("a", "ACGT"), ("b", "TT")]
    matrix = X.read_matrix(spark, put(tmp_path, "m", "location\tx\nchrI.5.9\tNA\nchrI.9.12\t2\n")).collect()
    assert [(r.chrom, r.start, r.x) for r in matrix] == [("chrI", 5, None), ("chrI", 9, 2)]
    fq = X.fastq_to_fasta(X.numbered_lines(spark, put(tmp_path, "q", "@r1\nACGT\n+\n@@@@\n@r2\nTT\n+\nII\n"))).orderBy("line")
    assert [r.value for r in fq.collect()] == [">r1", "ACGT", ">r2", "TT"]
    gff = X.gff_to_bed(spark.createDataFrame([("c\ts\tf\t5\t9\t.\t-\t.\tn",), ("broken",)], "value string")).collect()
    assert [(r.chrom, r.start, r.end, r.strand) for r in gff] == [("c", 4, 9, "-")]


def test_motifs(spark, tmp_path):
    own = M.read_motifs(spark, put(tmp_path, "M1.motif", "#Matrix:\n\tA\tC\tG\tT\tCon.\tDeg.\n1\t0.2\t0.4\t0.4\t0.0\tS\tS\n2\t0\t1\t0\t0\tC\tC\n#Factor Name:\nMyoD\n#Species:\nmouse\n"))
    row = own.select("id", "factors", "species", P.consensus(F.col("pwm")).alias("c"), P.degenerate(F.col("pwm")).alias("d"), P.information(F.get("pwm", F.lit(1))).alias("i")).first()
    assert (row.id, row.factors, row.species, row.c, row.d, row.i) == ("M1", ["MyoD"], "mouse", "SC", "SC", 2.0)
    jaspar = M.read_motifs(spark, put(tmp_path, "j", ">MA1 X\nA [1 2]\nC [3 4]\nG [5 6]\nT [7 8]\n"), "jaspar").first()
    assert jaspar.id == "MA1" and [tuple(r) for r in jaspar.pwm] == [(1, 3, 5, 7), (2, 4, 6, 8)]
    transfac = M.read_motifs(spark, put(tmp_path, "t", "AC  M7\nBF  T1; f; x\nP0 A C G T\n01 1 2 3 4 N\n02 4 3 2 1 N\n//\n"), "transfac").first()
    assert transfac.id == "M7" and len(transfac.pwm) == 2


TRANSFAC = """VV a table
AC  M001
XX
NA  C/EBP (x)
BF  T1; f; Species: human, Homo sapiens.
BF  T2; g; Species: mouse, human.
P0      C    A    G    T
01      1    1    2    0   N
02      0    4    0    0   A
RX  PUBMED: 123.
//
AC  M002
NA  Sp1/Sp2:Sp3
P0 A C G T
01 2 0 0 2 W
//
"""
RAW = "Accession Number\nM9\nFactor name\nA&B/C(D)\nFactors\nT00001; C; Species: rat, Rattus norvegicus. T00002; other; Species: dog.\nBinding Matrix\nA C G T cons\n1 1 2 0 N\n0 0 0 3 T\n\nend\n"
BULYK = "junk\nAbc_primary\textra\nA:\t1\t0\nC:\t1\t0\n\nG:\t2\t0\nT:\t0\t5\nDef_x\nA:\t3\nC:\t0\nG:\t0\nT:\t1\n"


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_motif_records(spark, tmp_path, cut_at, size):
    cut_at(size)

    def read(name, text, kind):
        rows = M.read_motif_records(spark, put(tmp_path, name, text), kind).orderBy("record").collect()
        return [(r.id, r.factors, r.species, r.source, [tuple(p) for p in r.pwm]) for r in rows]

    assert read("t.dat", TRANSFAC, "transfac") == [
        ("M001", ["C/EBP", "x"], ["human", "Homo sapiens", "mouse"], "123", [(0.25, 0.25, 0.5, 0.0), (1.0, 0.0, 0.0, 0.0)]),
        ("M002", ["Sp1", "Sp2", "Sp3"], [], None, [(0.5, 0.0, 0.0, 0.5)]),
    ]
    assert read("r.txt", RAW, "transfac_raw") == [("M9", ["A/B", "C", "D"], ["rat", "Rattus norvegicus"], None, [(0.25, 0.25, 0.5, 0.0), (0.0, 0.0, 0.0, 1.0)])]
    assert read("m.FOX.txt", "T G C A\n1 0 2 1 1\n2 4 0 0 0\n", "dfci") == [("DFCI.FOX", ["FOX"], [], None, [(0.25, 0.25, 0.5, 0.0), (0.0, 0.0, 0.0, 1.0)])]
    assert read("b.txt", BULYK, "bulyk") == [("MB0001", ["Abc"], [], None, [(0.25, 0.25, 0.5, 0.0), (0.0, 0.0, 0.0, 1.0)]), ("MB0002", ["Def"], [], None, [(0.75, 0.0, 0.0, 0.25)])]


def test_motif_files_round_trip(spark, tmp_path):
    pwm = "array<struct<a:double,c:double,g:double,t:double>>"
    given = spark.createDataFrame([("M1", ["F1", "F2"], "mouse", [(0.25, 0.25, 0.5, 0.0)]), ("M2", [], None, [(0.0, 1.0, 0.0, 0.0), (0.5, 0.0, 0.0, 0.5)])], f"id string, factors array<string>, species string, pwm {pwm}")
    out = str(tmp_path / "motifs")
    K.write_motifs(given, out, "made")
    for name, factors in (("M1", ["F1", "F2"]), ("M2", ["N/A"])):
        got = M.read_motifs(spark, f"{out}/id={name}").first()
        want = given.filter(F.col("id") == name).first()
        assert got.factors == factors and got.pwm == want.pwm


def test_tags_and_tables(spark, tmp_path):
    tags = [("c", "+", 5), ("c", "-", 5), ("c", "+", 5), ("d", "-", 90_000), ("c", "+", 70_000)]
    out = str(tmp_path / "tags")
    K.write_tag_wiggle(spark.createDataFrame(tags, "chrom string, strand string, pos long"), out, 25, 1000)
    assert sorted(map(tuple, X.read_wiggle_tags(spark, out).collect())) == sorted(tags)
    r = random.Random(8)
    rows = [(r.choice("ab"), s, s + r.randint(1, 300)) for s in r.sample(range(20_000), 400)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long")
    for name in ("left_saved", "right_saved"):
        K.save_intervals(df, name, 128, 3, str(tmp_path / name))
    pairs = K.saved_overlaps(spark, "left_saved", "right_saved", 128)
    assert pairs.count() == sum(a[0] == b[0] and a[1] < b[2] and b[1] < a[2] for a in rows for b in rows)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    only = K.saved_overlaps(spark, "left_saved", "right_saved", 128, "a")
    assert only.count() == sum(a[0] == b[0] == "a" and a[1] < b[2] and b[1] < a[2] for a in rows for b in rows)
    files = [f for f in spark.table("left_saved").filter("chrom = 'a'").select(F.input_file_name()).distinct().toPandas().iloc[:, 0]]
    assert files and all("chrom=a" in f for f in files)
    for name in ("left_saved", "right_saved"):
        K.drop(spark, name)
    K.write_by_chrom(df, str(tmp_path / "by"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "by")).select("chrom", "start", "end").collect())) == sorted(rows)


def test_genes_in_a_database(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = "jdbc:derby:memory:genes;create=true"
    genes = [(f"g{i}", f"chr{i % 3}", "+", i * 10, i * 10 + 9, i * 10, i * 10 + 9, 2, [i, i + 5], [i + 2, i + 9]) for i in range(60)]
    kind = "name string, chrom string, strand string, txStart long, txEnd long, cdsStart long, cdsEnd long, exonCount int, exonStarts array<long>, exonEnds array<long>"
    K.save_jdbc(spark.createDataFrame(genes[:40], kind), url, "genes", createTableColumnTypes="name VARCHAR(64), chrom VARCHAR(64)")
    K.save_jdbc(spark.createDataFrame(genes[40:], kind), url, "genes", "append")
    names = spark.createDataFrame([("g3",), ("g6",), ("g7",), ("g3",)], "name string")
    whole = X.read_genes_jdbc(spark, url, "genes", parts=4)
    assert whole.rdd.getNumPartitions() == 4 and sorted(map(tuple, whole.select(*[c.split()[0] for c in kind.split(", ")]).collect())) == sorted(genes)
    some = X.read_genes_jdbc(spark, url, "genes", names, ["chr0"], 2)
    assert sorted(r.name for r in some.collect()) == ["g3", "g6"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(name" in plan.replace("*", "").replace(" ", "") and "Join" not in plan


def test_binary_scan(spark, tmp_path):
    head = bytearray(256)
    head[0:4] = struct.pack("<i", 256)
    head[128:132] = struct.pack("<i", 272)
    body = struct.pack("<ifif", 11, 5.0, -21, 1.0) + struct.pack("<if", -31, 9.0)
    got = M.read_scan(spark, put(tmp_path, "x.bin", bytes(head) + body), ["chr1", "chr2"], 2.0)
    assert sorted((r.chrom, r.strand, r.pos, r.score) for r in got.collect()) == [("chr1", "+", 10, 5.0), ("chr2", "-", 30, 9.0)]
    r = random.Random(6)
    rows = [(r.choice("abc"), r.choice("+-"), r.randint(0, 2**31 - 3), float(r.randint(1, 9))) for _ in range(3000)]
    out = str(tmp_path / "scans")
    assert M.write_scan(spark.createDataFrame(rows, "chrom string, strand string, pos long, score double"), out, ["c", "x", "a", "b"]) == 3000
    for most in (8, 20, 4096, 1 << 25):
        back = M.read_scan(spark, out, ["c", "x", "a", "b"], 2.0, most)
        assert sorted(map(tuple, back.drop("file").collect())) == sorted(x for x in rows if x[3] > 2) if most != 8 else back.limit(9).count() == 9
    assert M.scan_ranges(b"", 0, ["a"]) == [] and M.scan_ranges(b"\x04\0\0\0", 23, ["a"], 9) == [("a", 4, 12), ("a", 12, 20)]
    assert M.write_scan(spark.createDataFrame([], "chrom string, strand string, pos long, score double"), out + "0", ["a"]) == 0


def test_streams(spark, tmp_path):
    rows = [("a", f"2024-01-01 {h:02d}:{m:02d}:00", float(v)) for h, m, v in ((0, 0, 5), (0, 30, 9), (3, 0, 7), (9, 0, 1), (23, 0, 6))]
    df = spark.createDataFrame(rows, "event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, want in (("regions", stream_regions(stream, 4), 2), ("bins", stream_bins(stream), 3)):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == want


def test_streamed_peaks_in_any_order(spark, tmp_path):
    r = random.Random(3)
    at = {(k, p): float(r.randint(0, 9)) for k in "ab" for p in r.sample(range(0, 40_000), 300)}
    rows = [(k, p, v) for (k, p), v in at.items()]
    kind = "event_type string, ts timestamp, value double"
    # three batches whose rows overlap in time by less than the lateness
    for i, (lo, hi) in enumerate(((0, 15_000), (15_000, 30_000), (30_000, 40_001))):
        part = [x for x in rows if lo <= x[1] + (500 if x[1] % 2 else 0) < hi or hi == 40_001 and x[1] + 500 >= hi]
        df = spark.createDataFrame(part, "event_type string, s long, value double").select("event_type", F.timestamp_seconds("s").alias("ts"), "value")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        q = stream_peaks(stream, 4, min_length=30, max_gap=120, late="20 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    points = spark.createDataFrame(rows, "chrom string, pos long, value double")
    want = sorted(map(tuple, O.call_peaks(points, 4, min_length=30, max_gap=120).collect()))
    assert len(got) > 20 and set(got) <= set(want)
    open_from = max(p for _, p, _ in rows) - 1200
    assert [w for w in want if w[2] - 1 + 120 < open_from] == got


@pytest.mark.parametrize("name", ["streamed_regions", "streamed_hourly_bins"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_streams_emit_what_is_open_at_the_end(spark, name, sf):
    folder, whole = SF.replace("sf0.001", sf), plans.SQL[name]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = sorted(c.sql(whole).fetchall())
    got = sorted(map(tuple, plans.QUERIES[name](spark, folder).collect()))
    assert [(*r[:2], r[3]) for r in got] == [(*r[:2], r[3]) for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-4)


def test_known_genomes(spark):
    from trackweave.sources.genomes import chromosome_lengths

    assert {g: chromosome_lengths(spark, g).groupBy().sum("length").first()[0] for g in ("hg18", "mm8")} == {"hg18": 3080436051, "mm8": 2644093988}
    with pytest.raises(ValueError, match="unknown genome"):
        chromosome_lengths(spark, "none")
