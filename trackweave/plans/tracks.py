"""Track queries: filters, summaries, regions, extrema, bins, samplers."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import binning as B
from ..operators import filters as L
from ..operators import ranges as R
from ..operators import windows as O
from ..operators.selection import medians
from ..sources.sinks import gff_lines
from . import views as V
from .views import query, rounded


@query("""SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", arg_min(pos, (-value, pos)) AS summit, max(value) AS score, count(*) AS n
FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY pos) AS s FROM (
  SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 3000 THEN 0 ELSE 1 END AS fresh FROM v_track WHERE value >= 20))
GROUP BY chrom, s HAVING max(pos) - min(pos) + 1 >= 300""")
def call_peaks(spark, sf):
    return O.call_peaks(V.track(spark, sf), 20, min_length=300, max_gap=3000, tile=200_000)


@query("""SELECT chrom, min(pos) AS start, max(pos) + 10 AS "end", arg_min(pos, (-value, pos)) AS summit, max(value) AS score, count(*) AS n
FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY pos) AS s FROM (
  SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 2000 THEN 0 ELSE 1 END AS fresh FROM v_track WHERE value BETWEEN 5 AND 40))
GROUP BY chrom, s HAVING max(pos) - min(pos) + 10 >= 200""")
def call_peaks_limited(spark, sf):
    return O.call_peaks(V.track(spark, sf), 5, up_limit=40, min_length=200, max_gap=2000, span=10, tile=300_000)


@query("SELECT chrom, pos, value FROM v_track WHERE value > 30")
def filter_track_above(spark, sf):
    return L.above(V.track(spark, sf), 30)


@query("SELECT chrom, pos, value FROM v_track WHERE value < 5")
def filter_track_below(spark, sf):
    return L.below(V.track(spark, sf), 5)


@query("SELECT chrom, pos, value FROM v_track WHERE chrom = 'click'")
def extract_chromosome(spark, sf):
    return V.track(spark, sf).filter("chrom = 'click'")


@query("SELECT chrom, pos, value FROM v_track WHERE pos BETWEEN 1704500000 AND 1705000000")
def positions_in_range(spark, sf):
    return V.track(spark, sf).filter(F.col("pos").between(1704500000, 1705000000))


@query("SELECT chrom, pos, max(value) AS value FROM v_points GROUP BY ALL")
def remove_redundant(spark, sf):
    return O.remove_redundant(V.points(spark, sf))


@query("SELECT round(sum(value), 4) AS total, max(value) AS highest, min(value) AS lowest, round(avg(value), 6) AS average, round(stddev_samp(value), 6) AS deviation FROM v_track")
def track_summary(spark, sf):
    return rounded(rounded(A.summary(V.track(spark, sf)), "average", "deviation"), "total", digits=4)


@query("""SELECT round(any_value(md), 6) AS median, round(stddev_samp(x), 6) AS deviation FROM (
  SELECT md, unnest([value, 2 * md - value]) AS x FROM (
    SELECT value, median(value) OVER () AS md FROM (SELECT value, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS i FROM v_track) WHERE i % 10 = 0)
  WHERE value < md)""")
def null_model_summary(spark, sf):
    return rounded(A.null_model(V.track(spark, sf), 10), "median", "deviation")


@query("""SELECT coalesce(chrom, 'whole') AS chrom, count(*) AS n, max(value) AS highest, min(value) AS lowest, round(avg(value), 6) AS average, max(pos) AS last FROM v_track GROUP BY ROLLUP (chrom)""")
def track_statistics_by_chromosome(spark, sf):
    out = A.with_whole(V.track(spark, sf), F.count(F.lit(1)).alias("n"), F.max("value").alias("highest"), F.min("value").alias("lowest"), F.avg("value").alias("average"), F.max("pos").alias("last"))
    return rounded(out, "average")


@query("SELECT round(median(m), 6) AS pseudomedian FROM (SELECT median(value) AS m FROM v_track GROUP BY chrom)")
def pseudomedian(spark, sf):
    per_chrom = medians(V.track(spark, sf), ["chrom"], "value", "m")
    return rounded(medians(per_chrom, [], "m", "pseudomedian"), "pseudomedian")


@query("""SELECT b AS bin, b * 5.0::DOUBLE AS start, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 20)) AS b) LEFT JOIN
(SELECT CAST(floor(value / 5.0) AS BIGINT) AS k, count(*) AS n FROM v_track WHERE value >= 0 AND value < 100 GROUP BY ALL) ON k = b""")
def track_histogram(spark, sf):
    return A.histogram(V.track(spark, sf), "value", 0.0, 100.0, 20)


@query("""SELECT min(value) FILTER (WHERE i = c) AS low, min(value) FILTER (WHERE i = n - 1 - c) AS high FROM (
SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n, CAST(floor(count(*) OVER () * 2 / 200.0) AS BIGINT) AS c FROM v_track)""")
def middle_98_percent(spark, sf):
    return A.middle_percent(V.track(spark, sf), "value", 98)


@query("SELECT chrom, CAST(floor(pos / 36000) AS BIGINT) AS bin, round(median(value), 6) AS value FROM v_track GROUP BY ALL")
def bin_median(spark, sf):
    return rounded(B.bin_values(V.track(spark, sf), 36_000, "median"), "value")


@query("SELECT chrom, CAST(floor(pos / 9000000) AS BIGINT) AS bin, median(value) AS value FROM v_track GROUP BY ALL")
def wide_bin_median(spark, sf):
    """Medians of bins wider than a tile, by selection."""
    return B.bin_values(V.track(spark, sf), 9_000_000, "median")


@query("SELECT chrom, CAST(floor(pos / 36000) AS BIGINT) AS bin, arg_max(value, pos) AS value FROM v_track GROUP BY ALL")
def bin_last(spark, sf):
    return B.bin_values(V.track(spark, sf), 36_000, "last")


@query("""SELECT l.chrom, b * 7200 AS start, least((b + 1) * 7200, length) AS "end", round(v, 6) AS value
FROM (SELECT chrom, length, unnest(range(0, (length - 1) // 7200 + 1)) AS b FROM v_lengths) l
LEFT JOIN (SELECT chrom, CAST(floor(pos / 7200) AS BIGINT) AS k, avg(value) AS v FROM v_shifted GROUP BY ALL) s ON s.chrom = l.chrom AND k = b""")
def bedgraph_bins(spark, sf):
    return rounded(B.bedgraph_bins(V.shifted(spark, sf), V.lengths(spark, sf), 7200, "mean"), "value")


@query("""SELECT chrom, s AS start, least(s + 50000, length) AS "end", CAST(s // 20000 AS INTEGER) AS nth FROM (SELECT chrom, length, unnest(range(0, length, 20000)) AS s FROM v_lengths)""")
def bin_chromosome(spark, sf):
    return B.chromosome_windows(V.lengths(spark, sf), 50_000, 20_000)


@query("SELECT DISTINCT chrom, CAST(round(pos / 3600) AS BIGINT) * 3600 + 1 AS pos FROM v_track")
def genome_grid(spark, sf):
    return B.genome_grid(V.track(spark, sf), 3600)


@query("SELECT chrom, CAST(round(pos / 3600) AS BIGINT) * 3600 + 1 AS pos, arg_min(value, pos) AS value FROM (SELECT * FROM v_track) GROUP BY chrom, CAST(round(pos / 3600) AS BIGINT)")
def first_value_per_grid(spark, sf):
    return B.first_per_grid(V.track(spark, sf), 3600)


@query("""SELECT DISTINCT g.chrom, t.pos, t.value FROM (SELECT chrom, unnest(range(min(pos), max(pos) + 1, 5000)) AS g FROM v_track GROUP BY chrom) g
ASOF JOIN v_track t ON g.chrom = t.chrom AND g.g <= t.pos""")
def next_value_on_grid(spark, sf):
    return B.next_on_grid(V.track(spark, sf), 5000, 300_000)


@query("""SELECT chrom, start, "end", unnest(range(c - b * 40, c + a * 40 + 1, 40)) AS pos FROM (
SELECT chrom, start, "end", c, CAST(floor((c - start) / 40.0) AS BIGINT) AS b, CAST(floor(("end" - c) / 40.0) AS BIGINT) AS a FROM (
SELECT chrom, start, "end", CAST(floor((start + "end") / 2.0) AS BIGINT) AS c FROM v_peaks))""")
def peak_grid(spark, sf):
    return B.peak_grid(V.peaks(spark, sf), 40)


@query("""SELECT chrom, pos, value FROM v_track UNION ALL
SELECT chrom, unnest(range(pos + 4000, nxt, 4000)) AS pos, 0.0::DOUBLE AS value FROM (SELECT chrom, pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS nxt FROM v_track) WHERE nxt - pos > 4000""")
def fill_gaps(spark, sf):
    return B.fill_gaps(V.track(spark, sf), 4000)


@query("""SELECT chrom, pos AS start, least(pos + 500, coalesce(nxt, pos + 500)) AS "end", value FROM (SELECT *, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS nxt FROM v_track)
UNION ALL SELECT chrom, pos + 500, nxt, 0.0::DOUBLE FROM (SELECT *, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS nxt FROM v_track) WHERE nxt > pos + 500""")
def zero_filled_bedgraph(spark, sf):
    return B.zero_filled_segments(V.track(spark, sf), 500)


@query("SELECT median(gap) AS gap FROM (SELECT lead(pos) OVER (PARTITION BY chrom ORDER BY pos) - pos AS gap FROM v_track) WHERE gap IS NOT NULL")
def median_gap(spark, sf):
    return B.median_gap(V.track(spark, sf))


@query("""SELECT a.chrom, a.pos, a.value, round(coalesce(sum(b.value), 0), 4) AS total FROM v_treat a LEFT JOIN v_control b ON a.chrom = b.chrom AND b.pos BETWEEN a.pos - 1800 AND a.pos + 1800 GROUP BY ALL""")
def sliding_control_sum(spark, sf):
    out = O.sliding_sum(V.treat(spark, sf), V.control(spark, sf), 1800, 1800)
    return rounded(out.withColumn("total", F.coalesce("total", F.lit(0.0))), "total", digits=4)


@query("""SELECT a.chrom, a.pos, CAST(sum(b.value) AS DOUBLE) AS total FROM v_track a JOIN (SELECT chrom, pos, CASE WHEN pos % 97 = 0 THEN 1e16 WHEN pos % 89 = 0 THEN 'inf'::DOUBLE ELSE pos % 8 END AS value FROM v_track) b
ON a.chrom = b.chrom AND b.pos BETWEEN a.pos - 40 AND a.pos + 900 GROUP BY a.chrom, a.pos, a.value HAVING count(*) FILTER (WHERE b.value > 100) < 2""")
def sliding_sum_of_unequal(spark, sf):
    """Windows of values of which some are 1e16 or infinite beside small whole numbers; windows with two such are left out, as their totals depend on the order."""
    t = V.track(spark, sf)
    value = F.when(F.col("pos") % 97 == 0, 1e16).when(F.col("pos") % 89 == 0, float("inf")).otherwise((F.col("pos") % 8).cast("double"))
    odd = t.select("chrom", "pos", value.alias("value"))
    large = O.sliding_sum(t, odd.select("chrom", "pos", (F.col("value") > 100).cast("double").alias("value")), 40, 900).filter("total < 2")
    return O.sliding_sum(t, odd, 40, 900).join(large.select("chrom", "pos"), ["chrom", "pos"]).select("chrom", "pos", "total")


@query("SELECT chrom, pos, round(sum(value) OVER (PARTITION BY chrom ORDER BY pos), 4) AS running FROM v_track")
def running_sum(spark, sf):
    return rounded(O.running_total(V.track(spark, sf), 200_000).select("chrom", "pos", "running"), "running", digits=4)


@query("SELECT chrom, pos, pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS step FROM v_track")
def position_differences(spark, sf):
    near = R.with_neighbours(V.track(spark, sf), ("pos",), 200_000)
    return near.select("chrom", "pos", (F.col("pos") - F.col("prev.pos")).alias("step"))


@query("""SELECT chrom, pos, round(coalesce(v, (lag(v) OVER w + lead(v) OVER w) / 2), 6) AS value FROM (SELECT chrom, pos, CASE WHEN pos % 7 = 0 THEN NULL ELSE value END AS v FROM v_track) WINDOW w AS (PARTITION BY chrom ORDER BY pos)""")
def fill_missing_values(spark, sf):
    holes = V.track(spark, sf).withColumn("value", F.when(F.col("pos") % 7 != 0, F.col("value")))
    return rounded(O.fill_missing(holes), "value")


def greedy_extrema_sql(sign: int) -> str:
    """Candidates in order, and a state that is the last chosen one: a close higher one replaces it, a distant one begins the next."""
    return f"""(WITH RECURSIVE s AS (SELECT chrom, pos, value FROM (SELECT *, lead(value) OVER (PARTITION BY chrom ORDER BY pos) AS nv FROM v_track) WHERE nv IS NULL OR nv <> value),
c AS (SELECT chrom, pos, value, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS i FROM (
SELECT *, lag(value) OVER (PARTITION BY chrom ORDER BY pos) AS pv, lead(value) OVER (PARTITION BY chrom ORDER BY pos) AS nv FROM s) WHERE (value - pv) * {sign} > 0 AND (value - nv) * {sign} > 0),
r AS (SELECT chrom, i, pos, value, 1 AS g FROM c WHERE i = 1 UNION ALL
SELECT c.chrom, c.i, CASE WHEN fresh OR higher THEN c.pos ELSE r.pos END, CASE WHEN fresh OR higher THEN c.value ELSE r.value END, r.g + CAST(fresh AS INTEGER)
FROM r JOIN c ON c.chrom = r.chrom AND c.i = r.i + 1, LATERAL (SELECT c.pos - r.pos > 4000 AS fresh, (c.value - r.value) * {sign} > 0 AS higher) t)
SELECT chrom, arg_max(pos, i) AS pos, arg_max(value, i) AS value FROM r GROUP BY chrom, g)"""


@query(f"SELECT * FROM {greedy_extrema_sql(1)}")
def find_peaks(spark, sf):
    return O.local_extrema(V.track(spark, sf), 4000)


@query(f"SELECT * FROM {greedy_extrema_sql(-1)}")
def find_valleys(spark, sf):
    return O.local_extrema(V.track(spark, sf), 4000, peaks=False)


@query("""SELECT * FROM (WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start, "end") AS i FROM v_peaks),
r AS (SELECT chrom, i, start AS kept FROM n WHERE i = 1 UNION ALL SELECT n.chrom, n.i, CASE WHEN n.start - kept > 300 THEN n.start ELSE kept END FROM r JOIN n ON n.chrom = r.chrom AND n.i = r.i + 1)
SELECT n.chrom, n.start, n."end", n.score FROM (SELECT chrom, min(i) AS i FROM r GROUP BY chrom, kept) k JOIN n ON n.chrom = k.chrom AND n.i = k.i)""")
def downsample_peaks(spark, sf):
    return O.thin_out(V.peaks(spark, sf), 300)


@query("""SELECT chrom, pos, round(sum(value), 6) AS value FROM (SELECT * FROM v_treat UNION ALL SELECT * FROM v_control) GROUP BY ALL""")
def add_tracks(spark, sf):
    a, b = V.treat(spark, sf), V.control(spark, sf).withColumnRenamed("value", "other")
    both = a.join(b, ["chrom", "pos"], "full_outer")
    return rounded(both.select("chrom", "pos", (F.coalesce("value", F.lit(0.0)) + F.coalesce("other", F.lit(0.0))).alias("value")), "value")


@query("SELECT chrom, start, bin, round(z, 5) AS z FROM (SELECT chrom, bin * 7200 AS start, bin, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS z FROM (SELECT chrom, CAST(floor(pos / 7200) AS BIGINT) AS bin, avg(value) AS v FROM v_shifted GROUP BY ALL))")
def normalise_bins(spark, sf):
    bins = B.bin_values(V.shifted(spark, sf), 7200, "mean")
    return rounded(A.z_scores(bins, "value").select("chrom", (F.col("bin") * 7200).alias("start"), "bin", "z"), "z", digits=5)


@query("SELECT round(avg(value), 6) AS average, round(stddev_samp(value) * 1.96::DOUBLE / sqrt(count(*)), 6) AS half_width FROM v_track")
def confidence_interval(spark, sf):
    return rounded(A.confidence_95(V.track(spark, sf), "value"), "average", "half_width")


@query("""SELECT CAST(b AS INTEGER) AS bin, round(v, 6) AS value, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 6)) AS b) LEFT JOIN (
SELECT len(list_filter([0, 10, 20, 35, 50, 80, 1000], lambda e: value >= e)) - 1 AS k, avg(pos % 1000) AS v, count(*) AS n FROM v_track GROUP BY ALL) ON k = b""")
def binned_means(spark, sf):
    rows = V.track(spark, sf).withColumn("y", F.col("pos") % 1000)
    return rounded(B.binned(rows, "value", "y", [0, 10, 20, 35, 50, 80, 1000], "mean"), "value")


@query("""SELECT chrom, nth, coalesce(n, 0) AS n FROM (SELECT chrom, unnest(range(0, (m - 1) // 600 + 1)) AS nth FROM (SELECT chrom, max(pos) + 25 AS m FROM v_tags GROUP BY ALL))
LEFT JOIN (SELECT chrom AS c, pos // 600 AS k, count(*) AS n FROM v_tags WHERE pos + 25 <= pos // 600 * 600 + 500 GROUP BY ALL) ON c = chrom AND k = nth""")
def window_tag_counts(spark, sf):
    tags = V.tags(spark, sf).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 25).alias("end"))
    sizes = tags.groupBy("chrom").agg(F.max("end").alias("length"))
    return B.window_counts(tags, sizes, 500, 100)


@query("""SELECT r.id AS nth, l.chrom, spot - b AS start, least(spot - b + 1000, length) AS "end" FROM (
  SELECT id, CAST(floor(CAST(CAST('0x' || substr(md5('1|' || id), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE * (SELECT sum(length) FROM v_lengths)) AS BIGINT) AS spot FROM range(200) t(id)) r
JOIN (SELECT chrom, length, CAST(coalesce(sum(length) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM v_lengths) l ON spot >= b AND spot < b + length""")
def random_regions(spark, sf):
    return B.random_regions(spark, V.lengths(spark, sf), 200, 1000)


@query("""SELECT chrom, strand, pos, tag_id FROM (SELECT *, row_number() OVER (PARTITION BY chrom, strand ORDER BY md5('1|' || pos || '|' || tag_id), pos, tag_id) AS i, count(*) OVER (PARTITION BY chrom, strand) AS n FROM v_tags) WHERE i <= floor(n * 0.1::DOUBLE)""")
def sample_tags(spark, sf):
    return B.sample_tags(V.tags(spark, sf), 0.1)


@query("SELECT chrom, pos, value FROM v_track")
def wiggle_reformat(spark, sf):
    return V.track(spark, sf).orderBy("chrom", "pos")


@query("""SELECT chrom, pos - 5 AS start, pos - 5 + 9 AS "end", round(value, 4) AS value FROM v_track""")
def track_as_gff(spark, sf):
    f = F.split("value", "\t")
    lines = gff_lines(V.track(spark, sf), 10, shift=5)
    return lines.select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(3)).cast("long").alias("start"), F.get(f, F.lit(4)).cast("long").alias("end"), F.round(F.get(f, F.lit(5)).cast("double"), 4).alias("value"))


@query(f"SELECT *, 'peak' AS kind FROM {greedy_extrema_sql(1)} WHERE value > 40 UNION ALL SELECT *, 'valley' FROM {greedy_extrema_sql(-1)} WHERE value < 5")
def refine_peaks(spark, sf):
    """Peaks above one level and valleys below another."""
    t = V.track(spark, sf)
    high, low = O.local_extrema(t, 4000).filter("value > 40"), O.local_extrema(t, 4000, peaks=False).filter("value < 5")
    return high.withColumn("kind", F.lit("peak")).unionByName(low.withColumn("kind", F.lit("valley")))


@query("""SELECT chrom, pos, value FROM v_track WHERE value BETWEEN (SELECT min(value) FILTER (WHERE i = CAST(floor((n - 1) * 25 / 100.0) AS BIGINT)) FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM v_track))
AND (SELECT min(value) FILTER (WHERE i = CAST(floor((n - 1) * 75 / 100.0) AS BIGINT)) FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM v_track))""")
def middle_half(spark, sf):
    return L.percentile_part(V.track(spark, sf), "value", 25, 75)
