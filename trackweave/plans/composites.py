"""Whole analyses: peak calling, replicate correlation, enrichment of overlaps, matrix commands."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probability import hypergeometric_upper, minus_ten_log10, normal_quantile, poisson_upper
from ..operators import aggregates as A
from ..operators import binning as B
from ..operators import ranges as R
from ..operators import windows as O
from ..sources.shared import stored_csv, stored_lines
from ..sources.sinks import bed_lines
from ..sources.text import read_bed, read_matrix
from . import views as V
from .views import query, rounded

GENOME = 2_600_000.0


def local_scores(treat: DataFrame, control: DataFrame, genome: float, space: int = 50, width: int = 3600, method: str = "poisson") -> DataFrame:
    """chrom, pos, value, expected, score: the treatment against the largest of three expectations.

    Background: its total / ``genome`` * ``space``; control within width / 2 and within 50 on either side, times
    space * ratio / width (or / 100), where ratio = totals of treatment / control.
    """
    total = F.broadcast(treat.agg(F.sum("value").alias("t")).join(control.agg(F.sum("value").alias("c")), F.lit(True)))
    near = O.sliding_sum(treat, control, 50, 50).withColumnRenamed("total", "near")
    far = O.sliding_sum(treat, control, width // 2, width // 2).select("chrom", "pos", F.col("total").alias("far"))
    both = near.join(far, ["chrom", "pos"]).join(total, F.lit(True))
    ratio = F.col("t") / F.col("c")
    expected = F.greatest(F.col("t") / genome * space, F.coalesce("far", F.lit(0.0)) * space * ratio / width, F.coalesce("near", F.lit(0.0)) * space * ratio / 100)
    rows = both.select("chrom", "pos", "value", expected.alias("expected"))
    scores = {
        "poisson": minus_ten_log10(poisson_upper(F.floor("value").cast("long"), F.col("expected"))),
        "diff": F.col("value") - F.col("expected"),
        "fc": F.when(F.col("expected") != 0, F.col("value") / F.col("expected")),
    }
    return rows.withColumn("score", scores[method])


EXPECTED = """SELECT a.chrom, a.pos, a.value, greatest(t / 2600000.0::DOUBLE * 50, coalesce(f, 0) * 50 * (t / c) / 3600, coalesce(n, 0) * 50 * (t / c) / 100) AS expected FROM v_treat a,
(SELECT (SELECT sum(value) FROM v_treat) AS t, (SELECT sum(value) FROM v_control) AS c),
LATERAL (SELECT sum(value) AS f, sum(value) FILTER (WHERE b.pos BETWEEN a.pos - 50 AND a.pos + 50) AS n FROM v_control b WHERE b.chrom = a.chrom AND b.pos BETWEEN a.pos - 1800 AND a.pos + 1800)"""


@query(f"SELECT chrom, pos, value, round(expected, 6) AS expected, round(value - expected, 6) AS score FROM ({EXPECTED})")
def treatment_control_difference(spark, sf):
    return rounded(local_scores(V.treat(spark, sf), V.control(spark, sf), GENOME, method="diff"), "expected", "score")


@query(f"SELECT chrom, pos, value, round(expected, 6) AS expected, round(value / nullif(expected, 0), 6) AS score FROM ({EXPECTED})")
def treatment_control_fold(spark, sf):
    return rounded(local_scores(V.treat(spark, sf), V.control(spark, sf), GENOME, method="fc"), "expected", "score")


@query(f"""SELECT chrom, pos, round(CASE WHEN p < 1e-290 THEN 2900 ELSE abs(-10 * log10(least(p, 1))) END, 4) AS score FROM (SELECT chrom, pos, (SELECT sum(exp(-expected + i * ln(expected) - lgamma(i + 1))) FROM range(CAST(floor(value) AS BIGINT) + 1, CAST(floor(value) AS BIGINT) + 400) z(i)) AS p FROM ({EXPECTED}))""")
def treatment_control_scores(spark, sf):
    return rounded(local_scores(V.treat(spark, sf), V.control(spark, sf), GENOME).select("chrom", "pos", F.abs(F.least("score", F.lit(2900.0))).alias("score")), "score", digits=4)


@query(f"""SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY pos) AS s FROM (
SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 5000 THEN 0 ELSE 1 END AS fresh FROM ({EXPECTED}) WHERE value - expected >= 10))
GROUP BY chrom, s HAVING max(pos) - min(pos) + 1 >= 200""")
def call_peaks_with_control(spark, sf):
    scores = local_scores(V.treat(spark, sf), V.control(spark, sf), GENOME, method="diff").select("chrom", "pos", F.col("score").alias("value"))
    return O.call_peaks(scores, 10, min_length=200, max_gap=5000, tile=200_000).select("chrom", "start", "end", "n")


@query("""SELECT * FROM (WITH s AS (SELECT any_value(md) AS md, stddev_samp(x) AS dev FROM (SELECT md, unnest([value, 2 * md - value]) AS x FROM (
  SELECT value, median(value) OVER () AS md FROM (SELECT value, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS i FROM v_track) WHERE i % 10 = 0) WHERE value < md)),
z AS (SELECT chrom, pos, (value - md) / dev AS value FROM v_track, s WHERE (value - md) / dev >= 1.6448536269514722)
SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", arg_min(pos, (-value, pos)) AS summit, round(max(value), 6) AS score, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY pos) AS s FROM (
  SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 3000 THEN 0 ELSE 1 END AS fresh FROM z)) GROUP BY chrom, s HAVING max(pos) - min(pos) + 1 >= 300)""")
def call_peaks_from_null_model(spark, sf):
    """Regions above the score whose chance under the mirrored null model is 0.05."""
    t = V.track(spark, sf)
    null = F.broadcast(A.null_model(t, 10))
    z = t.join(null, F.lit(True)).select("chrom", "pos", ((F.col("value") - F.col("median")) / F.col("deviation")).alias("value"))
    cut = F.broadcast(spark.range(1).select(normal_quantile(F.lit(0.95)).alias("cut")))
    high = z.join(cut, F.col("value") >= F.col("cut")).drop("cut")
    return rounded(O.call_peaks(high, float("-inf"), min_length=300, max_gap=3000, tile=200_000), "score")


@query("""SELECT chrom, pos, value FROM v_track WHERE value >= 75""")
def naive_calls(spark, sf):
    return V.track(spark, sf).filter("value >= 75")


@query("""SELECT count(*) AS n, round(corr(a.v, b.v), 6) AS r FROM (SELECT chrom, pos // 3600 AS k, avg(value) AS v FROM v_treat GROUP BY ALL) a JOIN (SELECT chrom, pos // 3600 AS k, avg(value) AS v FROM v_control GROUP BY ALL) b ON a.chrom = b.chrom AND a.k = b.k""")
def replicate_correlation(spark, sf):
    a, b = (t.groupBy("chrom", R.bin_of(F.col("pos"), 3600).alias("k")).agg(F.avg("value").alias(v)) for t, v in ((V.treat(spark, sf), "x"), (V.control(spark, sf), "y")))
    return rounded(a.join(b, ["chrom", "k"]).agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r")), "r")


BINNED = """SELECT t, chrom, CAST(floor(pos / 7200) AS BIGINT) AS bin, avg(value) AS v FROM (SELECT chrom, pos, max(value) AS value, 't' || user_id % 4 AS t FROM v_points GROUP BY ALL) GROUP BY ALL"""


@query(f"SELECT a.t AS a, b.t AS b, count(*) AS n, round(corr(a.v, b.v), 6) AS r FROM ({BINNED}) a JOIN ({BINNED}) b ON a.chrom = b.chrom AND a.bin = b.bin AND a.t < b.t GROUP BY ALL")
def track_correlation_matrix(spark, sf):
    p = V.points(spark, sf).withColumn("track", F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string"))).groupBy("track", "chrom", "pos").agg(F.max("value").alias("value"))
    bins = p.groupBy("track", "chrom", R.bin_of(F.col("pos"), 7200).alias("pos")).agg(F.avg("value").alias("value"))
    return rounded(A.correlation_matrix(bins), "r")


@query("""SELECT count(*) AS n, round(corr(x, y), 6) AS r FROM (SELECT chrom, (rn - 1) // 5 AS g, avg(x) AS x, avg(y) AS y FROM (SELECT a.chrom, a.pos, a.v AS x, b.v AS y, row_number() OVER (PARTITION BY a.chrom ORDER BY a.pos) AS rn
FROM (SELECT chrom, pos // 600 AS pos, avg(value) AS v FROM v_treat GROUP BY ALL) a JOIN (SELECT chrom, pos // 600 AS pos, avg(value) AS v FROM v_control GROUP BY ALL) b ON a.chrom = b.chrom AND a.pos = b.pos) GROUP BY ALL)""")
def stepped_correlation(spark, sf):
    a, b = (t.groupBy("chrom", R.bin_of(F.col("pos"), 600).alias("pos")).agg(F.avg("value").alias(v)) for t, v in ((V.treat(spark, sf), "x"), (V.control(spark, sf), "y")))
    both = O.numbered(a.join(b, ["chrom", "pos"]), ["chrom"], R.bin_of(F.col("pos"), 4096), "pos").withColumn("g", F.floor(F.col("nth") / 5))
    steps = both.groupBy("chrom", "g").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return rounded(steps.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r")), "r")


@query("""SELECT x, y, m, n, round((SELECT sum(exp(lgamma(x + 1) - lgamma(i + 1) - lgamma(x - i + 1) + lgamma(n - x + 1) - lgamma(y - i + 1) - lgamma(n - x - y + i + 1) - lgamma(n + 1) + lgamma(y + 1) + lgamma(n - y + 1))) FROM range(m + 1, least(x, y) + 1) z(i)), 8) AS p
FROM (SELECT count(*) FILTER (WHERE score >= 250000) AS x, count(*) FILTER (WHERE fold >= 15) AS y, count(*) FILTER (WHERE score >= 250000 AND fold >= 15) AS m, count(*) AS n FROM v_peaks)""")
def overlap_enrichment(spark, sf):
    """Chance of a larger overlap of two sets of peaks drawn from all."""
    c = V.peaks(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= 250_000).alias("x"), F.count_if(F.col("fold") >= 15).alias("y"), F.count_if((F.col("score") >= 250_000) & (F.col("fold") >= 15)).alias("m"))
    return c.withColumn("p", F.round(hypergeometric_upper(F.col("m"), F.col("x"), F.col("n") - F.col("x"), F.col("y")), 8))


def merged_sql(view: str) -> str:
    return f"""(SELECT chrom, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM (
SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {view})) GROUP BY chrom, g)"""


@query(f"""SELECT * FROM (WITH a AS {merged_sql("(SELECT chrom, txStart AS start, txEnd AS \"end\" FROM v_genes)")}, b AS {merged_sql("v_gene_peaks")},
c AS (SELECT (SELECT CAST(sum("end" - start) AS BIGINT) FROM a) AS x, (SELECT CAST(sum("end" - start) AS BIGINT) FROM b) AS y,
(SELECT CAST(coalesce(sum(least(a."end", b."end") - greatest(a.start, b.start)), 0) AS BIGINT) FROM a JOIN b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end") AS m, (SELECT 10000 * count(*) FROM part) AS n)
SELECT m AS common, x - m AS only_first, y - m AS only_second, n AS size, round((SELECT sum(exp(lgamma(x + 1) - lgamma(i + 1) - lgamma(x - i + 1) + lgamma(n - x + 1) - lgamma(y - i + 1) - lgamma(n - x - y + i + 1) - lgamma(n + 1) + lgamma(y + 1) + lgamma(n - y + 1))) FROM range(m + 1, least(x, y) + 1) z(i)), 4) AS enriched FROM c)""")
def base_pair_overlap(spark, sf):
    """Base pairs that two sets of intervals share, those of one only, and the chance of more in common on a random genome of this size."""
    a, b = R.merge_intervals(V.genes(spark, sf).select("chrom", F.col("txStart").alias("start"), F.col("txEnd").alias("end"))), R.merge_intervals(V.gene_peaks(spark, sf))
    x, y = (t.agg(F.sum(F.col("end") - F.col("start")).alias(n)) for t, n in ((a, "x"), (b, "y")))
    m = R.covered_bases(a.drop("n"), b, 1 << 14).agg(F.coalesce(F.sum("covered"), F.lit(0)).alias("m"))
    size = V.table(spark, sf, "part").agg((F.count(F.lit(1)) * 10_000).alias("n"))
    c = x.join(F.broadcast(y), F.lit(True)).join(F.broadcast(m), F.lit(True)).join(F.broadcast(size), F.lit(True))
    p = hypergeometric_upper(F.col("m"), F.col("x"), F.col("n") - F.col("x"), F.col("y"))
    return c.select(F.col("m").alias("common"), (F.col("x") - F.col("m")).alias("only_first"), (F.col("y") - F.col("m")).alias("only_second"), F.col("n").alias("size"), F.round(p, 4).alias("enriched"))


@query("""SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", max(value) AS score FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY pos) AS s FROM (
SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 3000 THEN 0 ELSE 1 END AS fresh FROM v_track WHERE value >= 60)) GROUP BY chrom, s HAVING max(pos) - min(pos) + 1 >= 300""")
def naive_peak_regions(spark, sf):
    """Regions called at a raw cut-off, written as BED lines and read back."""
    found = O.call_peaks(V.track(spark, sf), 60, min_length=300, max_gap=3000, tile=200_000).withColumn("name", F.lit("p"))
    return read_bed(spark, stored_lines(bed_lines(found))).select("chrom", "start", "end", "score")


MATRIX = "SELECT l_orderkey || '.' || l_linenumber AS id, l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem"


@query(f"""SELECT name, round(sum(v), 4) AS total, round(avg(v), 6) AS average, median(v) AS middle, round(stddev_samp(v), 6) AS deviation, round(avg(v) + stddev_samp(v), 6) AS cutoff FROM (
SELECT unnest(['q', 'd', 't']) AS name, unnest([q, d, t]) AS v FROM ({MATRIX})) GROUP BY name""")
def column_statistics(spark, sf):
    m = V.table(spark, sf, "lineitem").selectExpr("l_quantity AS q", "l_discount AS d", "l_tax AS t")
    return rounded(rounded(A.column_statistics(m, ["q", "d", "t"]), "average", "deviation", "cutoff"), "total", digits=4)


@query(f"SELECT id, CAST(q >= 45 AS INTEGER) + CAST(d >= 0.09::DOUBLE AS INTEGER) + CAST(t >= 0.07::DOUBLE AS INTEGER) AS calls FROM ({MATRIX}) WHERE CAST(q >= 45 AS INTEGER) + CAST(d >= 0.09::DOUBLE AS INTEGER) + CAST(t >= 0.07::DOUBLE AS INTEGER) >= 2")
def combined_calls(spark, sf):
    """Rows of a matrix in which at least two of three columns reach their threshold."""
    calls = (F.col("l_quantity") >= 45).cast("int") + (F.col("l_discount") >= 0.09).cast("int") + (F.col("l_tax") >= 0.07).cast("int")
    return V.table(spark, sf, "lineitem").select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("id"), calls.alias("calls")).filter("calls >= 2")


@query(f"SELECT id || ',' || CAST(q AS INTEGER) AS row FROM ({MATRIX})")
def organise_columns(spark, sf):
    return V.table(spark, sf, "lineitem").select(F.concat(F.concat_ws(".", "l_orderkey", "l_linenumber"), F.lit(","), F.col("l_quantity").cast("int").cast("string")).alias("row"))


@query("""SELECT * FROM (WITH m AS (SELECT l_returnflag AS chrom, l_orderkey * 100 + l_linenumber * 10 AS start, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS q FROM lineitem),
c AS (SELECT avg(q) + stddev_samp(q) AS cutoff FROM m), f AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY chrom ORDER BY start) <= 100 THEN 0 ELSE 1 END AS fresh FROM m, c WHERE q >= cutoff)
SELECT chrom, min(start) AS start, max(start) + 10 AS "end", max(q) AS score FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start) AS s FROM f) GROUP BY chrom, s HAVING max(start) - min(start) + 10 >= 20)""")
def matrix_regions(spark, sf):
    """A matrix with missing values, written and read as a file: regions of one column above its mean plus deviation."""
    place = F.expr("l_orderkey * 100 + l_linenumber * 10")
    rows = V.table(spark, sf, "lineitem").select(F.concat_ws(".", "l_returnflag", place, place + 10).alias("location"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("q"))
    return A.matrix_regions(read_matrix(spark, stored_csv(rows)), "q", 10, min_length=20, max_gap=100).select("chrom", "start", "end", "score")


@query("""SELECT * FROM (WITH m AS (SELECT l_returnflag AS chrom, l_orderkey * 100 + l_linenumber * 10 AS start, CAST(l_quantity >= 30 AS INTEGER) + CAST(l_discount >= 0.05::DOUBLE AS INTEGER) + coalesce(CAST(CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END >= 0.04::DOUBLE AS INTEGER), 0) AS calls FROM lineitem),
f AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY chrom ORDER BY start) <= 100 THEN 0 ELSE 1 END AS fresh FROM m WHERE calls >= 2)
SELECT chrom, min(start) AS start, max(start) + 10 AS "end", CAST(max(calls) AS DOUBLE) AS most, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start) AS s FROM f) GROUP BY chrom, s HAVING max(start) - min(start) + 10 >= 20)""")
def combined_call_regions(spark, sf):
    """Regions of rows in which at least two of three columns reach their threshold; missing values do not."""
    m = V.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("chrom"), F.expr("l_orderkey * 100 + l_linenumber * 10").alias("start"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax")).alias("t"))
    called = A.combined_regions(m, {"q": 30, "d": 0.05, "t": 0.04}, 2, 10, min_length=20, max_gap=100)
    return called.select("chrom", "start", "end", F.col("score").alias("most"), "n")


_CENTRED = """(SELECT chrom, start, "end", CAST(floor((start + "end") / 2.0) AS BIGINT) AS c FROM v_gene_peaks)"""


@query(f"""SELECT coalesce(chrom, 'whole') AS chrom, CAST(sum(k) AS BIGINT) AS points, CAST(sum(n) AS BIGINT) AS n, round(sum(k) / sum(n), 6) AS share FROM (
SELECT g.chrom, k, n FROM (SELECT chrom, CAST(sum((c - start) // 100 + ("end" - c) // 100 + 1) AS BIGINT) AS k FROM {_CENTRED} GROUP BY chrom) r JOIN (SELECT chrom, count(DISTINCT CAST(round(pos / 100.0::DOUBLE) AS BIGINT)) AS n FROM v_coords GROUP BY chrom) g ON g.chrom = r.chrom) GROUP BY ROLLUP (chrom)""")
def region_background(spark, sf):
    """Share of the genome's grid points that lie in regions of interest, by chromosome and whole."""
    return rounded(B.region_background(V.gene_peaks(spark, sf), V.coords(spark, sf), 100), "share")


@query("""SELECT CAST(b AS BIGINT) AS bin, b * 4.0::DOUBLE AS start, coalesce(n, 0) AS n, round(coalesce(n, 0) * 0.8::DOUBLE / max(coalesce(n, 0)) OVER (), 6) AS height FROM (SELECT unnest(range(0, 25)) AS b)
LEFT JOIN (SELECT CAST(floor(value / 4.0) AS BIGINT) AS k, count(*) AS n FROM v_track WHERE value >= 0 AND value < 100 GROUP BY ALL) ON k = b""")
def plot_histogram(spark, sf):
    """Histogram rows with bar heights scaled to 0.8."""
    h = A.histogram(V.track(spark, sf), "value", 0.0, 100.0, 25)
    return h.join(F.broadcast(h.agg(F.max("n").alias("m"))), F.lit(True)).select("bin", "start", "n", F.round(F.col("n") * 0.8 / F.col("m"), 6).alias("height"))


@query("""SELECT chrom, start, "end", CAST(round((least(greatest(score, 50000), 300000) - 50000) * 15 / 250000.0::DOUBLE) AS BIGINT) AS level FROM v_peaks""")
def plot_chromosome_levels(spark, sf):
    """Peaks as rectangles with scores clipped to limits and quantised to 16 levels."""
    from ..functions.arrays import quantised

    return V.peaks(spark, sf).select("chrom", "start", "end", quantised(F.col("score"), 50_000, 300_000, 16).alias("level"))


@query("""SELECT count(*) FILTER (WHERE fold >= 2 AND num > 3) AS kept, count(*) AS motifs FROM (SELECT m, num, (num / greatest(ref, 1)) * (2000.0::DOUBLE / 1000) AS fold FROM (SELECT o_custkey % 50 AS m, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS num, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS ref FROM orders GROUP BY ALL))""")
def motif_enrichment_filter(spark, sf):
    o = V.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("m")).agg(F.count_if(F.expr("o_orderkey % 3 = 0")).alias("num"), F.count_if(F.expr("o_orderkey % 3 = 1")).alias("ref"))
    fold = F.col("num") / F.greatest("ref", F.lit(1)) * 2.0
    return o.agg(F.count_if((fold >= 2) & (F.col("num") > 3)).alias("kept"), F.count(F.lit(1)).alias("motifs"))


@query("""SELECT chrom, round(avg(n), 6) AS expected, max(n) AS most, count(*) AS windows FROM (SELECT chrom, nth, coalesce(n, 0) AS n FROM (SELECT chrom, unnest(range(0, (m - 1) // 600 + 1)) AS nth FROM (SELECT chrom, max(pos) + 25 AS m FROM v_tags GROUP BY ALL))
LEFT JOIN (SELECT chrom AS c, pos // 600 AS k, count(*) AS n FROM v_tags WHERE pos + 25 <= pos // 600 * 600 + 500 GROUP BY ALL) ON c = chrom AND k = nth) GROUP BY chrom""")
def window_statistics(spark, sf):
    t = V.tags(spark, sf).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 25).alias("end"))
    sizes = t.groupBy("chrom").agg(F.max("end").alias("length"))
    w = B.window_counts(t, sizes, 500, 100)
    return rounded(w.groupBy("chrom").agg(F.avg("n").alias("expected"), F.max("n").alias("most"), F.count(F.lit(1)).alias("windows")), "expected")
