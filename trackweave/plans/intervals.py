"""Interval queries: filters, overlaps, range joins, merging, top-k, set operations."""

from pyspark.sql import functions as F

from ..functions.strings import chromosome_key
from ..operators import aggregates as A
from ..operators import filters as L
from ..operators import profiles as P
from ..operators import ranges as R
from ..operators import reads as T
from . import views as V
from .views import query, rounded

PEAK = ["chrom", "start", "end", "name"]


@query('SELECT chrom, start, "end", name FROM v_peaks WHERE pvalue >= 50 AND pvalue < 120')
def filter_pvalue(spark, sf):
    return L.filter_pvalue(V.peaks(spark, sf), 50, 120).select(*PEAK)


@query('SELECT chrom, start, "end", name FROM v_peaks WHERE score >= 100000 AND score < 200000')
def filter_score(spark, sf):
    return L.filter_score(V.peaks(spark, sf), 100_000, 200_000).select(*PEAK)


@query('SELECT chrom, start, "end", name FROM v_peaks WHERE fold >= 10')
def filter_fold(spark, sf):
    return L.filter_fold(V.peaks(spark, sf), 10).select(*PEAK)


@query('SELECT chrom, start, "end", name FROM v_peaks WHERE fdr > 1 AND fdr <= 5')
def filter_fdr(spark, sf):
    return L.filter_fdr(V.peaks(spark, sf), 5, 1).select(*PEAK)


@query('SELECT chrom, start, "end", name FROM v_peaks WHERE score >= (SELECT min(score) FROM (SELECT score FROM v_peaks ORDER BY score DESC LIMIT 500))')
def top_peaks_by_score(spark, sf):
    return L.top_by_score(V.peaks(spark, sf), 500).select(*PEAK)


@query('SELECT chrom, start, "end", name FROM v_peaks WHERE score <= (SELECT max(score) FROM (SELECT score FROM v_peaks ORDER BY score LIMIT 300))')
def lowest_peaks_by_score(spark, sf):
    return L.top_by_score(V.peaks(spark, sf), 300, descending=False).select(*PEAK)


@query("SELECT min(score) AS cutoff FROM (SELECT score FROM v_peaks ORDER BY score DESC LIMIT 500)")
def score_cutoff_for_n_peaks(spark, sf):
    return L.score_cutoff(V.peaks(spark, sf), 500)


@query("SELECT name, summit FROM v_peaks ORDER BY score DESC, name LIMIT 100")
def top_summits(spark, sf):
    return V.peaks(spark, sf).orderBy(F.desc("score"), "name").limit(100).select("name", "summit")


@query("""SELECT coalesce(chrom, 'whole') AS chrom, count(*) AS n, CAST(sum("end" - start) AS BIGINT) AS bases, round(avg(fold), 6) AS mean_fold, greatest(max(fold), 0) AS max_fold,
greatest(max(score), 0) AS max_score, least(min(score), 100000) AS min_score FROM v_peaks GROUP BY ROLLUP (chrom)""")
def peak_totals(spark, sf):
    out = A.with_whole(
        V.peaks(spark, sf), F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"), F.avg("fold").alias("mean_fold"), F.greatest(F.max("fold"), F.lit(0.0)).alias("max_fold"),
        F.greatest(F.max("score"), F.lit(0.0)).alias("max_score"), F.least(F.min("score"), F.lit(100000.0)).alias("min_score"),
    )
    return rounded(out, "mean_fold")


ISLANDS = """SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {t})"""


@query(f'SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n FROM ({ISLANDS.format(t="v_peaks")}) GROUP BY chrom, island')
def merge_intervals(spark, sf):
    return R.merge_intervals(V.peaks(spark, sf), 50_000)


@query(f'SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n, arg_min(summit, (-score, start, "end", summit)) AS summit, max(score) AS score, round(sum(total_p), 5) AS total_p FROM ({ISLANDS.format(t="v_peaks")}) GROUP BY chrom, island')
def merge_peaks(spark, sf):
    return rounded(R.merge_peaks(V.peaks(spark, sf), 50_000), "total_p", digits=5)


@query(f'SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n FROM ({ISLANDS.format(t="(SELECT chrom, start, \"end\" FROM v_peaks WHERE name % 2 = 0 UNION ALL SELECT chrom, start + 30, \"end\" + 30 FROM v_peaks WHERE name % 3 = 0)")}) GROUP BY chrom, island')
def replicate_union(spark, sf):
    p = V.peaks(spark, sf)
    second = p.filter("name % 3 = 0").select("chrom", (F.col("start") + 30).alias("start"), (F.col("end") + 30).alias("end"))
    return R.merge_intervals(p.filter("name % 2 = 0").select("chrom", "start", "end").unionByName(second), 50_000)


def halves(spark, sf):
    r = V.regions(spark, sf)
    return r.filter("line % 2 = 1").select("chrom", "start", "end", "score"), r.filter("line % 2 = 0").select("chrom", "start", "end", "score")


HALVES = """a AS (SELECT chrom, start, "end", score FROM v_regions WHERE line % 2 = 1), b AS (SELECT chrom, start, "end", score FROM v_regions WHERE line % 2 = 0)"""


def with_halves(sql: str) -> str:
    return f"SELECT * FROM (WITH {HALVES} {sql})"


@query(with_halves("""SELECT DISTINCT a.chrom, a.start, a."end", a.score FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND b.start < a."end" AND a.start < b."end")"""))
def overlapping_regions(spark, sf):
    a, b = halves(spark, sf)
    return R.overlapping(a.distinct(), b, 64)


@query("""SELECT * FROM (WITH r AS (SELECT chrom, start // 3000 * 3000 AS start, start // 3000 * 3000 + line * 100 AS "end", line FROM v_regions), a AS (SELECT chrom, start, "end" FROM r WHERE line <> 2), b AS (SELECT chrom, start + 250 AS start, "end" + 250 AS "end" FROM r WHERE line = 2)
SELECT a.chrom, a.start, a."end", count(*) AS n FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND b.start < a."end" AND a.start < b."end") GROUP BY ALL)""")
def overlapping_rows(spark, sf):
    """Regions of which many are equal: each counts."""
    start = F.floor(F.col("start") / 3000) * 3000
    r = V.regions(spark, sf).select("chrom", start.alias("start"), (start + F.col("line") * 100).alias("end"), "line")
    b = r.filter("line = 2").select("chrom", (F.col("start") + 250).alias("start"), (F.col("end") + 250).alias("end"))
    return R.overlapping(r.filter("line <> 2").select("chrom", "start", "end"), b, 64).groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT * FROM (WITH r AS (SELECT chrom, start // 900 * 900 AS start, start // 900 * 900 + line * 100 AS "end", line FROM v_regions)
SELECT r.chrom, start, "end", round(total, 4) AS total, count(*) AS n FROM r JOIN (SELECT d.*, coalesce(sum(value), 0) AS total FROM (SELECT DISTINCT chrom, start, "end" FROM r) d LEFT JOIN v_signal s ON s.chrom = d.chrom AND s.pos >= d.start AND s.pos < d."end" GROUP BY ALL) t USING (chrom, start, "end") GROUP BY ALL)""")
def total_of_repeated_regions(spark, sf):
    """The total inside each region; regions repeat, and none takes another's values."""
    start = F.floor(F.col("start") / 900) * 900
    r = V.regions(spark, sf).select("chrom", start.alias("start"), (start + F.col("line") * 100).alias("end"))
    values = P.region_values(r, V.signal(spark, sf), F.sum("value"), ["chrom", "start", "end"], 0.0)
    return rounded(values.groupBy("chrom", "start", "end").agg(F.max("value").alias("total"), F.count(F.lit(1)).alias("n")), "total", digits=4)


@query("""SELECT * FROM (WITH a AS (SELECT chrom, start, CASE WHEN start % 1000000 < 100 THEN start + 3000000 ELSE "end" END AS "end" FROM v_regions WHERE line % 2 = 0), b AS (SELECT chrom, start, CASE WHEN start % 5000000 BETWEEN 500 AND 599 THEN start + 100000000 ELSE "end" END AS "end" FROM v_regions WHERE line % 2 = 1)
SELECT a.chrom, a.start, a."end", count(*) AS n, CAST(sum(least(a."end", b."end") - greatest(a.start, b.start)) AS BIGINT) AS shared FROM a JOIN b ON a.chrom = b.chrom AND b.start < a."end" AND a.start < b."end" GROUP BY ALL)""")
def mixed_interval_join(spark, sf):
    """Intervals of a few positions beside ones as long as a chromosome, on both sides: odd lines against even ones."""
    r = V.regions(spark, sf)
    a = r.filter("line % 2 = 0").select("chrom", "start", F.when(F.expr("start % 1000000 < 100"), F.col("start") + 3_000_000).otherwise(F.col("end")).alias("end"))
    b = r.filter("line % 2 = 1").select("chrom", "start", F.when(F.expr("start % 5000000 BETWEEN 500 AND 599"), F.col("start") + 100_000_000).otherwise(F.col("end")).alias("end"))
    pairs = R.overlap_pairs(a, b, 64)
    return pairs.groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("end", "b_end") - F.greatest("start", "b_start")).alias("shared"))


@query(with_halves("""SELECT count(*) AS n FROM (SELECT DISTINCT a.chrom, a.start, a."end", a.score FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND b.start < a."end" AND a.start < b."end"
AND (least(a."end", b."end") - greatest(a.start, b.start) + 1) / (b."end" - b.start) > 0.5::DOUBLE))"""))
def overlap_count_with_cover(spark, sf):
    a, b = halves(spark, sf)
    return R.overlapping(a.distinct(), b, 64, 0.5).agg(F.count(F.lit(1)).alias("n"))


@query(with_halves("""SELECT a.chrom, a.start, a."end", b.start AS b_start, b."end" AS b_end FROM a JOIN b ON a.chrom = b.chrom AND b.start < a."end" AND a.start < b."end" """))
def interval_join(spark, sf):
    a, b = halves(spark, sf)
    return R.overlap_pairs(a, b, 64).select("chrom", "start", "end", "b_start", "b_end")


@query(with_halves(f"""SELECT x.chrom, x.start, x."end", CAST(sum(least(x."end", y."end") - greatest(x.start, y.start)) AS BIGINT) AS covered FROM
(SELECT chrom, min(start) AS start, max("end") AS "end" FROM ({ISLANDS.format(t="a")}) GROUP BY chrom, island) x JOIN
(SELECT chrom, min(start) AS start, max("end") AS "end" FROM ({ISLANDS.format(t="b")}) GROUP BY chrom, island) y
ON x.chrom = y.chrom AND y.start < x."end" AND x.start < y."end" GROUP BY ALL"""))
def covered_bases(spark, sf):
    a, b = halves(spark, sf)
    n = V.parts(spark, sf)
    left, right = (R.merge_intervals(x, 50_000, n).select("chrom", "start", "end") for x in (a, b))
    return R.covered_bases(left, right, 128, levels=False, parts=n)


@query("""SELECT r.chrom, r.start, r."end", max(value) AS value FROM (SELECT DISTINCT chrom, start, "end" FROM v_regions) r LEFT JOIN v_signal s ON s.chrom = r.chrom AND s.pos BETWEEN r.start AND r."end" GROUP BY ALL""")
def extract_max_values(spark, sf):
    n = V.parts(spark, sf)
    r = V.regions(spark, sf).select("chrom", "start", "end").repartition(n, "chrom", "start", "end").distinct()
    return P.region_values(r, V.signal(spark, sf), F.max("value"), ["chrom", "start", "end"], closed=True, parts=n)


@query("""SELECT r.chrom, r.start, r."end", string_agg((pos - r.start) || ':' || CAST(floor(value) AS BIGINT), ',' ORDER BY pos) AS points FROM (SELECT DISTINCT chrom, start, "end" FROM v_regions) r JOIN v_signal s ON s.chrom = r.chrom AND s.pos BETWEEN r.start AND r."end" GROUP BY ALL""")
def extract_position_values(spark, sf):
    r = V.regions(spark, sf).select("chrom", "start", "end").distinct()
    got = R.points_in(r, V.signal(spark, sf), 128).groupBy("chrom", "start", "end").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("p"))
    return got.select("chrom", "start", "end", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x.pos - F.col("start"), F.floor(x.value).cast("long"))), ",").alias("points"))


@query("""SELECT r.chrom, r.start, r."end", round(median(value), 6) AS value FROM (SELECT DISTINCT chrom, start, "end" FROM v_regions) r JOIN v_signal s ON s.chrom = r.chrom AND s.pos BETWEEN r.start AND r."end" GROUP BY ALL""")
def extract_median_values(spark, sf):
    r = V.regions(spark, sf).select("chrom", "start", "end").distinct()
    return rounded(R.points_in(r, V.signal(spark, sf), 128).groupBy("chrom", "start", "end").agg(F.median("value").alias("value")), "value")


@query("""SELECT r.chrom, r.start, r."end", round(list_avg(CASE WHEN len(v) > 2 THEN v[2:len(v) - 1] ELSE v END), 6) AS value FROM (SELECT r.chrom, r.start, r."end", list(value ORDER BY value) FILTER (WHERE value IS NOT NULL) AS v FROM (SELECT DISTINCT chrom, start, "end" FROM v_gene_peaks) r
LEFT JOIN v_gene_signal s ON s.chrom = r.chrom AND s.pos >= r.start AND s.pos < r."end" GROUP BY ALL) r""")
def trimmed_means(spark, sf):
    """A function of one's own as reducer: the mean without the smallest and the largest value."""

    def trimmed(values):
        return sorted(values)[1:-1] if len(values) > 2 else values

    n = V.parts(spark, sf)
    r = V.gene_peaks(spark, sf).select("chrom", "start", "end").repartition(n, "chrom", "start", "end").distinct()
    how = A.reducer(lambda v: sum(trimmed(v)) / len(trimmed(v)))
    return rounded(P.region_values(r, V.gene_signal(spark, sf), how, ["chrom", "start", "end"], parts=n), "value")


@query("""SELECT r.chrom, r.start, r."end", coalesce(max(value), 0.0::DOUBLE) AS value FROM (SELECT DISTINCT chrom, start, "end" FROM v_regions) r LEFT JOIN v_signal s ON s.chrom = r.chrom AND s.pos >= r.start AND s.pos < r."end" GROUP BY ALL""")
def scan_scores(spark, sf):
    n = V.parts(spark, sf)
    r = V.regions(spark, sf).select("chrom", "start", "end").repartition(n, "chrom", "start", "end").distinct()
    return P.region_values(r, V.signal(spark, sf), F.max("value"), ["chrom", "start", "end"], default=0.0, parts=n)


@query("""SELECT s.chrom, count(*) AS points, sum(CASE WHEN EXISTS (SELECT 1 FROM v_regions r WHERE r.chrom = s.chrom AND s.pos BETWEEN r.start AND r."end") THEN 1 ELSE 0 END)::BIGINT AS inside FROM v_signal s GROUP BY s.chrom""")
def points_in_regions(spark, sf):
    s = V.signal(spark, sf)
    inside = R.points_in(V.regions(spark, sf).select("chrom", "start", "end"), s, 128).select("chrom", "pos").distinct().groupBy("chrom").agg(F.count(F.lit(1)).alias("inside"))
    return s.groupBy("chrom").agg(F.count(F.lit(1)).alias("points")).join(inside, "chrom", "left").select("chrom", "points", F.coalesce("inside", F.lit(0)).alias("inside"))


@query("""SELECT s.chrom, s.pos, a.before, b.after FROM (SELECT chrom, pos FROM v_signal) s
ASOF LEFT JOIN (SELECT DISTINCT chrom, start AS before FROM v_regions) a ON a.chrom = s.chrom AND s.pos >= a.before
ASOF LEFT JOIN (SELECT DISTINCT chrom, start AS after FROM v_regions) b ON b.chrom = s.chrom AND s.pos < b.after""")
def nearest_starts(spark, sf):
    marks = V.regions(spark, sf).select("chrom", F.col("start").alias("pos")).distinct()
    return R.nearest(V.signal(spark, sf).select("chrom", "pos"), marks, 20_000)


@query("SELECT chrom, strand, pos, count(*) AS count FROM v_tags GROUP BY ALL")
def merge_duplicate_tags(spark, sf):
    return T.merge_duplicates(V.tags(spark, sf))


@query("SELECT chrom, strand, count(*) AS total, count(DISTINCT pos) AS places FROM v_tags GROUP BY ALL")
def tag_totals(spark, sf):
    return V.tags(spark, sf).groupBy("chrom", "strand").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("pos").alias("places"))


@query("""SELECT r.chrom, r.start, r."end", count(*) AS n, string_agg(t.s || t.strand, ',' ORDER BY t.s, t.strand) AS tags FROM (SELECT DISTINCT chrom, start, "end" FROM v_regions) r
JOIN (SELECT chrom, strand, CASE WHEN strand = '+' THEN pos * 4 ELSE pos * 4 - 25 END AS s FROM v_tags) t ON t.chrom = r.chrom AND t.s < r."end" AND r.start < t.s + 25 GROUP BY ALL""")
def tags_in_regions(spark, sf):
    r = V.regions(spark, sf).select("chrom", "start", "end").distinct()
    t = V.tags(spark, sf).withColumn("pos", F.col("pos") * 4)
    got = T.tags_in_regions(r, t, 25, 64)
    return got.select("chrom", "start", "end", F.size("tags").cast("long").alias("n"), F.array_join(F.transform("tags", lambda x: F.concat(x["at"].cast("string"), x.strand)), ",").alias("tags"))


@query("SELECT chrom, pos FROM v_treat INTERSECT SELECT chrom, pos FROM v_control")
def common_positions(spark, sf):
    return V.treat(spark, sf).select("chrom", "pos").intersect(V.control(spark, sf).select("chrom", "pos"))


@query("SELECT a.chrom, a.pos, a.value AS x, b.value AS y FROM v_treat a JOIN v_control b ON a.chrom = b.chrom AND a.pos = b.pos")
def position_equi_join(spark, sf):
    return V.treat(spark, sf).withColumnRenamed("value", "x").join(V.control(spark, sf).withColumnRenamed("value", "y"), ["chrom", "pos"])


@query("SELECT chrom FROM v_treat WHERE value > 60 INTERSECT SELECT chrom FROM v_control WHERE value > 60")
def common_chromosomes(spark, sf):
    return V.treat(spark, sf).filter("value > 60").select("chrom").intersect(V.control(spark, sf).filter("value > 60").select("chrom"))


@query("""SELECT CAST(row_number() OVER (ORDER BY kind, number NULLS FIRST, letters, tail, chrom) AS BIGINT) AS nth, chrom FROM (SELECT *, CASE WHEN body = '' THEN 4 WHEN num <> '' THEN (CASE WHEN tail = '' THEN 0 ELSE 2 END) ELSE (CASE WHEN tail = '' THEN 1 ELSE 3 END) END AS kind, TRY_CAST(num AS BIGINT) AS number FROM (
SELECT chrom, body, regexp_extract(body, '^(\\d+)', 1) AS num, regexp_extract(body, '^([A-Za-z]+)', 1) AS letters, regexp_extract(body, '^(?:\\d+|[A-Za-z]+)(.*)$', 1) AS tail FROM (
SELECT chrom, regexp_extract(chrom, '^chr(.+)$', 1) AS body FROM (SELECT DISTINCT CASE WHEN o_custkey % 5 = 0 THEN 'chr' || o_custkey % 23 WHEN o_custkey % 5 = 1 THEN 'chr' || chr(CAST(65 + o_custkey % 26 AS INTEGER)) WHEN o_custkey % 5 = 2 THEN 'chr' || o_custkey % 9 || '_random' ELSE 'scaffold' || o_custkey % 4 END AS chrom FROM orders))))""")
def natural_chromosome_order(spark, sf):
    from pyspark.sql import Window as W

    names = V.table(spark, sf, "orders").selectExpr("CASE WHEN o_custkey % 5 = 0 THEN concat('chr', o_custkey % 23) WHEN o_custkey % 5 = 1 THEN concat('chr', char(65 + o_custkey % 26)) WHEN o_custkey % 5 = 2 THEN concat('chr', o_custkey % 9, '_random') ELSE concat('scaffold', o_custkey % 4) END AS chrom").distinct()
    return names.select(F.row_number().over(W.orderBy(*chromosome_key(F.col("chrom")))).cast("long").alias("nth"), "chrom")


@query("""SELECT chrom, count(*) AS total, CAST(sum(CASE WHEN value <= -1 THEN 1 ELSE 0 END) AS BIGINT) AS lowest, CAST(sum(CASE WHEN value > -1 AND value <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN value > 10 AND value <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS high,
CAST(sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) AS BIGINT) AS highest FROM v_track GROUP BY chrom""")
def probes_in_ranges(spark, sf):
    v = F.col("value")
    return V.track(spark, sf).groupBy("chrom").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(v <= -1).alias("lowest"), F.count_if((v > -1) & (v <= 10)).alias("low"), F.count_if((v > 10) & (v <= 30)).alias("high"), F.count_if(v > 30).alias("highest")
    )


@query("""SELECT chrom, points, inside, round(inside * 100.0::DOUBLE / points, 4) AS percent FROM (SELECT s.chrom, count(*) AS points, count(*) FILTER (WHERE p.chrom IS NOT NULL) AS inside FROM v_gene_signal s
LEFT JOIN (SELECT DISTINCT s.chrom, s.pos FROM v_gene_signal s JOIN v_gene_peaks k ON k.chrom = s.chrom AND s.pos BETWEEN k.start AND k."end") p ON p.chrom = s.chrom AND p.pos = s.pos GROUP BY s.chrom)""")
def probes_in_peaks(spark, sf):
    s, n = V.gene_signal(spark, sf), V.parts(spark, sf)
    hit = R.points_in(V.gene_peaks(spark, sf).select("chrom", "start", "end"), s, 1 << 13, parts=n).select("chrom", "pos").repartition(n, "chrom", "pos").distinct().withColumn("hit", F.lit(1))
    out = s.join(hit, ["chrom", "pos"], "left").groupBy("chrom").agg(F.count(F.lit(1)).alias("points"), F.count("hit").alias("inside"))
    return out.withColumn("percent", F.round(F.col("inside") * 100.0 / F.col("points"), 4))


@query("""SELECT pair, count(*) AS n, count(*) = 1 AS is_unique FROM (SELECT l.l_orderkey AS pair FROM lineitem l JOIN lineitem r ON l.l_orderkey = r.l_orderkey AND l.l_returnflag = r.l_returnflag
WHERE l.l_linenumber % 2 = 1 AND r.l_linenumber % 2 = 0 AND r.l_partkey - l.l_partkey > 50 AND r.l_partkey - l.l_partkey < 500) GROUP BY pair
UNION ALL SELECT DISTINCT l_orderkey, 0, false FROM lineitem WHERE l_orderkey NOT IN (SELECT l.l_orderkey FROM lineitem l JOIN lineitem r ON l.l_orderkey = r.l_orderkey AND l.l_returnflag = r.l_returnflag
WHERE l.l_linenumber % 2 = 1 AND r.l_linenumber % 2 = 0 AND r.l_partkey - l.l_partkey > 50 AND r.l_partkey - l.l_partkey < 500)""")
def read_pair_quality(spark, sf):
    return T.pair_quality(read_hits(spark, sf).select("pair", "side", "chrom", "pos"))


def read_hits(spark, sf):
    return V.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS pair", "CASE WHEN l_linenumber % 2 = 1 THEN 'L' ELSE 'R' END AS side", "l_returnflag AS chrom", "l_partkey AS pos", "CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand", "cast(l_quantity as bigint) % 3 AS errors"
    )


@query("""SELECT pair, chrom, CAST(floor((lp + rp) / 2.0) AS BIGINT) AS pos, score FROM (SELECT *, count(*) FILTER (WHERE r = 1) OVER (PARTITION BY pair) AS ties FROM (SELECT *, rank() OVER (PARTITION BY pair ORDER BY score) AS r FROM (
SELECT l.l_orderkey AS pair, l.l_returnflag AS chrom, l.l_partkey AS lp, r.l_partkey AS rp, abs(abs(r.l_partkey - l.l_partkey) - 200) + CAST(l.l_quantity AS BIGINT) % 3 + CAST(r.l_quantity AS BIGINT) % 3 AS score
FROM lineitem l JOIN lineitem r ON l.l_orderkey = r.l_orderkey AND l.l_returnflag = r.l_returnflag AND l.l_linenumber % 2 = 1 AND r.l_linenumber % 2 = 0 AND l.l_suppkey % 2 <> r.l_suppkey % 2) WHERE score < 200)) WHERE r = 1 AND ties = 1""")
def paired_end_tags(spark, sf):
    return T.best_pairs(read_hits(spark, sf), 200)
