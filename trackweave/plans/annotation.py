"""Gene queries: annotation of coordinates, summaries, enrichment, nearest sites, profiles."""

from pyspark.sql import functions as F

from ..operators import annotate as N
from ..operators import filters as L
from ..operators import profiles as P
from ..operators import ranges as R
from . import views as V
from .views import query, rounded

# pairs of coordinates and genes in the genes' search windows, and their reduction per coordinate
WINDOWS = """w AS (SELECT *, greatest(txStart - 3000, before) AS ws, least(txEnd + 3000, after) AS we FROM (
  SELECT g.*, coalesce((SELECT arg_max(e.txEnd, e.nth) FROM o e WHERE e.chrom = g.chrom AND e.nth < g.nth AND e.txEnd < g.txStart), 0) AS before,
         coalesce((SELECT min(e.txStart) FROM o e WHERE e.chrom = g.chrom AND e.txStart > g.txEnd), (SELECT max(e.txEnd) FROM o e WHERE e.chrom = g.chrom) + 1000000) AS after FROM o g))"""
PAIRS = f"""o AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY txStart, txEnd, name) AS nth FROM v_genes), {WINDOWS},
p AS (SELECT c.chrom, c.pos, w.*  EXCLUDE (chrom), CASE WHEN strand = '+' THEN '+' ELSE '-' END AS s FROM v_coords c JOIN w ON w.chrom = c.chrom AND c.pos BETWEEN ws AND we),
k AS (SELECT *, CASE WHEN s = '+' AND pos < txStart AND pos >= txStart - 3000 THEN txStart - pos WHEN s = '-' AND pos >= txEnd AND pos < txEnd + 3000 THEN txEnd - pos END AS up,
  CASE WHEN s = '+' AND pos >= txEnd AND pos < txEnd + 3000 THEN pos - txEnd WHEN s = '-' AND pos < txStart AND pos >= txStart - 3000 THEN txStart - pos END AS dn,
  CASE WHEN pos >= txStart AND pos < txEnd THEN
    CASE WHEN exon IS NULL THEN 4 WHEN pos >= cdsStart AND pos < cdsEnd THEN 3 WHEN (s = '+' AND pos < cdsStart) OR (s = '-' AND pos >= cdsEnd) THEN 1 ELSE 2 END END AS code
  FROM (SELECT *, CASE WHEN pos >= exonStarts[3] AND pos < exonEnds[3] THEN 3 WHEN pos >= exonStarts[2] AND pos < exonEnds[2] THEN 2 WHEN pos >= exonStarts[1] AND pos < exonEnds[1] THEN 1 END AS exon FROM p)),
q AS (SELECT *, CASE WHEN s = '+' THEN pos - txStart + 1 ELSE txEnd - pos + 1 END AS off, txEnd - txStart + 1 AS len,
  exonEnds[1] - exonStarts[1] AS l1, exonEnds[2] - exonStarts[2] AS l2, exonEnds[3] - exonStarts[3] AS l3 FROM k),
r AS (SELECT *, l1 + l2 + l3 AS cl, CASE WHEN s = '+' THEN pos - exonStarts[exon] + CASE exon WHEN 1 THEN 0 WHEN 2 THEN l1 ELSE l1 + l2 END ELSE exonEnds[exon] - pos + CASE exon WHEN 1 THEN l2 + l3 WHEN 2 THEN l3 ELSE 0 END END AS coff FROM q),
a AS (SELECT chrom, pos, max(up) FILTER (WHERE up < 0) AS m, min(up) FILTER (WHERE up > 0) AS pl, min(dn) FILTER (WHERE dn > 0) AS dn, min(code) AS code,
  arg_max(least(CAST(floor(off / round(len / 3.0::DOUBLE)) AS BIGINT) + 1, 3), nth) FILTER (WHERE code IS NOT NULL) AS rel3, arg_max(least(CAST(floor(off / round(len / 5.0::DOUBLE)) AS BIGINT) + 1, 5), nth) FILTER (WHERE code IS NOT NULL) AS rel5,
  arg_max(least(CAST(floor(coff / round(cl / 3.0::DOUBLE)) AS BIGINT) + 1, 3), nth) FILTER (WHERE code = 3) AS cds3, arg_max(least(CAST(floor(coff / round(cl / 5.0::DOUBLE)) AS BIGINT) + 1, 5), nth) FILTER (WHERE code = 3) AS cds5 FROM r GROUP BY ALL),
t AS (SELECT c.chrom, c.pos, coalesce(least(abs(m), pl), 0) AS promoter, CASE WHEN abs(m) + pl <= 5000 THEN abs(m) + pl ELSE 0 END AS bipromoter, coalesce(dn, 0) AS downstream, CAST(coalesce(code, 0) AS BIGINT) AS gene,
  coalesce(rel3, 0) AS rel3, coalesce(rel5, 0) AS rel5, coalesce(cds3, 0) AS cds3, coalesce(cds5, 0) AS cds5, CAST(0 AS BIGINT) AS roi FROM v_coords c LEFT JOIN a ON a.chrom = c.chrom AND a.pos = c.pos)"""


def annotated_sql(body: str) -> str:
    return f"SELECT * FROM (WITH {PAIRS} {body})"


def annotated(spark, sf):
    return N.annotate(V.coords(spark, sf), V.genes(spark, sf))


@query(annotated_sql("SELECT * FROM t"))
def annotate(spark, sf):
    return annotated(spark, sf)


def level(column: str, levels: int, largest: int) -> str:
    return f"CASE WHEN {column} = 0 THEN 0 ELSE CAST(floor(greatest({column} - 1, 1) * {levels} / {largest}.0::DOUBLE) AS BIGINT) + 1 END"


_COUNTS = ", ".join(
    [f"CAST(sum(CASE WHEN {level(c, n, m)} BETWEEN 1 AND {i} THEN 1 ELSE 0 END) AS BIGINT) AS {c}{i}" for c, n, m in (("promoter", 3, 3000), ("bipromoter", 2, 5000), ("downstream", 3, 3000)) for i in range(1, n + 1)]
    + [f"CAST(sum(CAST(gene = {i} AS BIGINT)) AS BIGINT) AS gene{i}" for i in range(1, 5)]
    + ["CAST(sum(CAST(gene > 0 AS BIGINT)) AS BIGINT) AS gene5", "CAST(sum(roi) AS BIGINT) AS roi"]
    + [f"CAST(sum(CAST({n}{k} = {i} AS BIGINT)) AS BIGINT) AS {n}{k}_{i}" for k in (3, 5) for n in ("rel", "cds") for i in range(1, k + 1)]
)
SUMMARY = f"SELECT coalesce(chrom, 'whole') AS chrom, count(*) AS n, {_COUNTS} FROM t GROUP BY ROLLUP (chrom)"


@query(annotated_sql(SUMMARY))
def annotation_summary(spark, sf):
    return N.summarise(annotated(spark, sf))


@query(annotated_sql(f"SELECT chrom, round(promoter3 / n, 6) AS promoter3, round(downstream3 / n, 6) AS downstream3, round(gene5 / n, 6) AS gene5 FROM ({SUMMARY})"))
def annotation_shares(spark, sf):
    return rounded(N.shares(N.summarise(annotated(spark, sf))).select("chrom", "promoter3", "downstream3", "gene5"), "promoter3", "downstream3", "gene5")


@query(annotated_sql(f"""SELECT chrom, CASE WHEN p = 1 THEN 'promoter1' WHEN d = 1 THEN 'downstream1' WHEN p = 2 THEN 'promoter2' WHEN d = 2 THEN 'downstream2' WHEN p = 3 THEN 'promoter3' WHEN d = 3 THEN 'downstream3' WHEN gene > 0 THEN 'gene' || gene ELSE 'enhancer' END AS site, count(*) AS n
FROM (SELECT chrom, gene, {level("promoter", 3, 3000)} AS p, {level("downstream", 3, 3000)} AS d FROM t) GROUP BY ALL"""))
def site_distribution(spark, sf):
    return N.site_distribution(annotated(spark, sf))


@query(annotated_sql("SELECT chrom, e AS edge, CAST(sum(CASE WHEN promoter < e THEN 1 ELSE 0 END) AS BIGINT) AS n FROM t, (SELECT unnest([500, 1000, 1500, 2000, 2500, 3000]::BIGINT[]) AS e) WHERE promoter > 0 GROUP BY ALL"))
def cumulative_promoters(spark, sf):
    return N.cumulative_distances(annotated(spark, sf), "promoter", [500, 1000, 1500, 2000, 2500, 3000])


@query(annotated_sql("""SELECT chrom, 700::BIGINT AS distance, round(y0 + 200 * (y1 - y0) / 500.0::DOUBLE, 6) AS share FROM (SELECT chrom, CAST(count(*) FILTER (WHERE promoter BETWEEN 1 AND 499) AS DOUBLE) / count(*) AS y0, CAST(count(*) FILTER (WHERE promoter BETWEEN 1 AND 999) AS DOUBLE) / count(*) AS y1 FROM t GROUP BY chrom)"""))
def interpolated_background(spark, sf):
    a = annotated(spark, sf)
    n = a.groupBy("chrom").agg(F.count(F.lit(1)).alias("all"))
    tabled = N.cumulative_distances(a, "promoter", [500, 1000]).join(n, "chrom").select("chrom", F.col("edge").alias("distance"), (F.col("n") / F.col("all")).alias("share"))
    return rounded(N.interpolated_background(tabled, 700), "share")


@query(annotated_sql(f"""SELECT chrom, name, n, k, round(CASE WHEN pb >= k / n THEN least(1, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(pb) + (n - i) * ln(1 - pb))) FROM range(0, k + 1) z(i)))
ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(pb) + (n - i) * ln(1 - pb))) FROM range(k + 1, n + 1) z(i)) END, 8) AS p FROM (
SELECT s.chrom, s.n, x.name, x.k, x.pb FROM (SELECT *, (SELECT promoter3 / n FROM ({SUMMARY}) WHERE chrom = 'whole') AS bp, (SELECT gene5 / n FROM ({SUMMARY}) WHERE chrom = 'whole') AS bg FROM ({SUMMARY}) WHERE chrom <> 'whole') s,
LATERAL (SELECT unnest(['promoter3', 'gene5']) AS name, unnest([promoter3, gene5]) AS k, unnest([bp, bg]) AS pb) x)"""))
def enrichment_p_values(spark, sf):
    s = N.summarise(annotated(spark, sf))
    whole = N.shares(s.filter("chrom = 'whole'"))
    mine = s.filter("chrom <> 'whole'")
    background = mine.select("chrom").join(F.broadcast(whole.drop("chrom")), F.lit(True))
    out = N.enrichment(mine, background, ["promoter3", "gene5"])
    return out.select("chrom", "name", "n", "k", F.round("p", 8).alias("p"))


NEAREST = """SELECT g.chrom, g.name, CASE WHEN strand = '+' THEN s - b1 ELSE a1 - s END AS start_up, CASE WHEN strand = '+' THEN a1 - s ELSE s - b1 END AS start_down, CASE WHEN strand = '+' THEN e - b2 ELSE a2 - e END AS end_up, CASE WHEN strand = '+' THEN a2 - e ELSE e - b2 END AS end_down FROM (
SELECT x.*, (SELECT max(c) FROM m WHERE m.chrom = x.chrom AND c <= s) AS b1, (SELECT min(c) FROM m WHERE m.chrom = x.chrom AND c > s) AS a1, (SELECT max(c) FROM m WHERE m.chrom = x.chrom AND c <= e) AS b2, (SELECT min(c) FROM m WHERE m.chrom = x.chrom AND c > e) AS a2
FROM (SELECT chrom, name, strand, CASE WHEN strand = '+' THEN txStart ELSE txEnd END AS s, CASE WHEN strand = '+' THEN txEnd ELSE txStart END AS e FROM v_genes) x) g""".replace("FROM m WHERE m.chrom", """FROM (SELECT DISTINCT chrom, CAST(floor((start + "end") / 2.0) AS BIGINT) AS c FROM v_gene_peaks) m WHERE m.chrom""")


@query(NEAREST)
def nearest_sites(spark, sf):
    return N.nearest_sites(V.genes(spark, sf), V.gene_peaks(spark, sf)).select("chrom", "name", "start_up", "start_down", "end_up", "end_down")


SECTIONS = """SELECT x.chrom, x.name, section, round(coalesce((SELECT sum(least(x.e, p."end") - greatest(x.s, p.start)) FROM v_gene_peaks p WHERE p.chrom = x.chrom AND p.start < x.e AND x.s < p."end"), 0) / (e - s), 6) AS share FROM (
SELECT chrom, name, unnest([CASE WHEN strand = '+' THEN 'body1' ELSE 'body3' END, 'body2', CASE WHEN strand = '+' THEN 'body3' ELSE 'body1' END, 'start', 'end']) AS section,
unnest([txStart, txStart + t, txStart + 2 * t, CASE WHEN strand = '+' THEN txStart - 3000 ELSE txEnd - 3000 END, CASE WHEN strand = '+' THEN txEnd ELSE txStart - 3000 END]) AS s0,
greatest(s0, 0) AS s, unnest([txStart + t, txStart + 2 * t, txEnd, CASE WHEN strand = '+' THEN txStart + 3000 ELSE txEnd + 3000 END, CASE WHEN strand = '+' THEN txEnd + 3000 ELSE txStart END]) AS e
FROM (SELECT *, (txEnd - txStart) // 3 AS t FROM v_genes)) x WHERE e > s""".replace("greatest(s0, 0) AS s, ", "").replace("x.s,", "greatest(x.s0, 0),").replace("x.s <", "greatest(x.s0, 0) <").replace("(e - s)", "(e - greatest(s0, 0))").replace("e > s", "e > greatest(s0, 0)")


@query(SECTIONS)
def section_coverage(spark, sf):
    return rounded(N.section_coverage(V.genes(spark, sf), V.gene_peaks(spark, sf)), "share").select("chrom", "name", "section", "share")


def renamed(spark, sf):
    """The genes under three names only."""
    return V.genes(spark, sf).withColumn("name", F.concat(F.lit("g"), (F.col("p_size") % 3).cast("string")))


@query(f"""SELECT n.chrom, 'g' || p_size % 3 AS name, start_up, start_down, end_up, end_down FROM ({NEAREST}) n JOIN v_genes g ON g.name = n.name""")
def nearest_sites_of_namesakes(spark, sf):
    return N.nearest_sites(renamed(spark, sf), V.gene_peaks(spark, sf)).select("chrom", "name", "start_up", "start_down", "end_up", "end_down")


@query(f"""SELECT n.chrom, 'g' || p_size % 3 AS name, section, share FROM ({SECTIONS}) n JOIN v_genes g ON g.name = n.name""")
def section_coverage_of_namesakes(spark, sf):
    return rounded(N.section_coverage(renamed(spark, sf), V.gene_peaks(spark, sf)), "share").select("chrom", "name", "section", "share")


@query("SELECT chrom, name FROM v_genes WHERE txEnd - txStart BETWEEN 1500 AND 2200")
def genes_by_length(spark, sf):
    return L.by_gene_length(V.genes(spark, sf), 1500, 2200).select("chrom", "name")


@query("""SELECT coalesce(chrom, 'whole') AS chrom, count(*) AS n, min(txEnd - txStart) AS shortest, round(avg(txEnd - txStart), 6) AS average, max(txEnd - txStart) AS longest, CAST(sum(list_sum(list_transform(exonEnds, lambda x, i: x - exonStarts[i]))) AS BIGINT) AS exon_bases,
CAST(sum((exonStarts[2] - exonEnds[1]) + (exonStarts[3] - exonEnds[2])) AS BIGINT) AS intron_bases FROM v_genes GROUP BY ROLLUP (chrom)""")
def gene_lengths(spark, sf):
    g = V.genes(spark, sf)
    size = F.col("txEnd") - F.col("txStart")
    exon = F.aggregate(F.zip_with("exonEnds", "exonStarts", lambda e, s: e - s), F.lit(0).cast("long"), lambda t, x: t + x)
    n = F.size("exonStarts")
    intron = F.aggregate(F.zip_with(F.slice("exonStarts", 2, n - 1), F.slice("exonEnds", 1, n - 1), lambda s, e: s - e), F.lit(0).cast("long"), lambda t, x: t + x)
    sums = [F.count(F.lit(1)).alias("n"), F.min(size).alias("shortest"), F.avg(size).alias("average"), F.max(size).alias("longest"), F.sum(exon).alias("exon_bases"), F.sum(intron).alias("intron_bases")]
    return rounded(g.rollup("chrom").agg(*sums).withColumn("chrom", F.coalesce("chrom", F.lit("whole"))), "average")


@query("""SELECT g.chrom, g.name, count(s.pos) AS n FROM v_genes g LEFT JOIN v_gene_signal s ON s.chrom = g.chrom AND s.pos >= txStart AND s.pos < txEnd GROUP BY ALL""")
def points_per_gene(spark, sf):
    spans = V.genes(spark, sf).select("chrom", "name", F.col("txStart").alias("start"), F.col("txEnd").alias("end"))
    n = R.points_in(spans, V.gene_signal(spark, sf), 1 << 13, closed=False).groupBy("chrom", "name").agg(F.count(F.lit(1)).alias("n"))
    return spans.select("chrom", "name").join(n, ["chrom", "name"], "left").select("chrom", "name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT g.chrom, g.name FROM v_genes g WHERE g.name IN (SELECT 'g' || l_partkey FROM lineitem WHERE l_quantity > 49)")
def genes_in_list(spark, sf):
    names = V.table(spark, sf, "lineitem").filter("l_quantity > 49").selectExpr("concat('g', l_partkey) AS name")
    return V.genes(spark, sf).select("chrom", "name").join(names, "name", "left_semi").select("chrom", "name")


@query("SELECT DISTINCT 'g' || l_partkey * 2 AS name FROM lineitem WHERE 'g' || l_partkey * 2 NOT IN (SELECT name FROM v_genes)")
def missing_genes(spark, sf):
    names = V.table(spark, sf, "lineitem").selectExpr("concat('g', l_partkey * 2) AS name").distinct()
    return names.join(V.genes(spark, sf).select("name"), "name", "left_anti")


ANCHOR = """SELECT chrom, name, CASE WHEN strand = '+' THEN raw ELSE 40 - raw END AS bin, arr[len(arr) // 2 + 1] AS value FROM (
SELECT g.chrom, g.name, g.strand, CAST((s.pos - (anchor - 2050)) // 100 AS INTEGER) AS raw, list(s.value ORDER BY s.pos) AS arr FROM (SELECT *, CASE WHEN strand = '+' THEN txStart ELSE txEnd END AS anchor FROM v_genes) g
JOIN v_gene_signal s ON s.chrom = g.chrom AND s.pos >= anchor - 2050 AND s.pos < anchor + 2050 GROUP BY ALL)"""


@query(f"SELECT bin, round(avg(value), 6) AS value, count(*) AS n FROM ({ANCHOR}) GROUP BY bin")
def start_profile(spark, sf):
    return rounded(P.average_profile(P.anchor_bins(V.genes(spark, sf), V.gene_signal(spark, sf), parts=V.parts(spark, sf))), "value")


@query(f"SELECT bin, round(avg(value), 6) AS value, 2 * count(*) AS n FROM ({ANCHOR}) GROUP BY bin")
def start_profile_of_namesakes(spark, sf):
    """Genes of few names, each in the table twice."""
    g = renamed(spark, sf)
    return rounded(P.average_profile(P.anchor_bins(g.unionByName(g), V.gene_signal(spark, sf), parts=V.parts(spark, sf))), "value")


@query(f"SELECT CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS grp, bin, round(avg(value), 6) AS value, count(*) AS n FROM ({ANCHOR}) a JOIN v_genes g ON g.name = a.name GROUP BY ALL")
def profile_by_gene_group(spark, sf):
    g, n = V.genes(spark, sf), V.parts(spark, sf)
    groups = g.select("name", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("grp"))
    return rounded(P.average_profile(P.anchor_bins(g, V.gene_signal(spark, sf), parts=n), groups, n), "value")


@query(f"SELECT bin, round(sum(v * n) / sum(n), 6) AS value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT chrom, bin, avg(value) AS v, count(*) AS n FROM ({ANCHOR}) GROUP BY ALL) GROUP BY bin")
def weighted_profile_merge(spark, sf):
    values = P.anchor_bins(V.genes(spark, sf), V.gene_signal(spark, sf), parts=V.parts(spark, sf))
    per_chrom = values.groupBy("chrom", "bin").agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return rounded(P.merge_profiles(per_chrom), "value")


@query("""SELECT bin, round(avg(v), 6) AS value, count(*) AS n FROM (SELECT g.name, CASE WHEN strand = '+' THEN r ELSE 29 - r END AS bin, avg(value) AS v FROM (
SELECT g.name, g.strand, CAST((s.pos - txStart) * 30 // (txEnd - txStart) AS INTEGER) AS r, value FROM v_genes g JOIN v_gene_signal s ON s.chrom = g.chrom AND s.pos >= txStart AND s.pos < txEnd) g GROUP BY ALL) GROUP BY bin""")
def body_profile(spark, sf):
    return rounded(P.average_profile(P.body_bins(V.genes(spark, sf), V.gene_signal(spark, sf), 30, V.parts(spark, sf))), "value")


_JOINED = """SELECT bin, round(avg(v), 6) AS value, count(*) AS n FROM (SELECT name, CASE WHEN strand = '+' THEN r ELSE 19 - r END AS bin, avg(value) AS v FROM (
SELECT x.name, x.strand, CAST((s.pos - x.s + skip) * 20 // size AS INTEGER) AS r, value FROM ({parts}) x JOIN v_gene_signal s ON s.chrom = x.chrom AND s.pos >= x.s AND s.pos < x.e) GROUP BY ALL) GROUP BY bin"""


@query(_JOINED.format(parts="SELECT chrom, name, strand, unnest(exonStarts) AS s, unnest(exonEnds) AS e, unnest([0, 200, 400]) AS skip, 600 + (exonEnds[3] - exonStarts[3]) - 200 AS size FROM v_genes"))
def exon_profile(spark, sf):
    return rounded(P.average_profile(P.joined_exon_bins(V.genes(spark, sf), V.gene_signal(spark, sf), 20, parts=V.parts(spark, sf))), "value")


@query(_JOINED.format(parts="SELECT chrom, name, strand, unnest(exonEnds[1:2]) AS s, unnest(exonStarts[2:3]) AS e, unnest([0, 200]) AS skip, 400 AS size FROM v_genes"))
def intron_profile(spark, sf):
    return rounded(P.average_profile(P.joined_exon_bins(V.genes(spark, sf), V.gene_signal(spark, sf), 20, introns=True, parts=V.parts(spark, sf))), "value")


@query("""SELECT s.pos - (mid - 300) AS "offset", round(avg(value), 6) AS value, count(*) AS n FROM (SELECT chrom, (start + "end") // 2 AS mid FROM v_gene_peaks) r JOIN v_gene_signal s ON s.chrom = r.chrom AND s.pos >= mid - 300 AND s.pos < mid + 300 GROUP BY ALL""")
def centre_profile(spark, sf):
    return rounded(P.centre_profile(V.gene_peaks(spark, sf), V.gene_signal(spark, sf), 600), "value")


@query("SELECT chrom, pos, CAST(EXISTS (SELECT 1 FROM v_gene_peaks p WHERE p.chrom = c.chrom AND c.pos BETWEEN p.start AND p.\"end\") AS BIGINT) AS roi FROM v_coords c")
def roi_flags(spark, sf):
    c, n = V.coords(spark, sf), V.parts(spark, sf)
    hit = R.points_in(V.gene_peaks(spark, sf).select("chrom", "start", "end"), c, 1 << 13, parts=n).select("chrom", "pos").repartition(n, "chrom", "pos").distinct().withColumn("roi", F.lit(1).cast("long"))
    return c.join(hit, ["chrom", "pos"], "left").select("chrom", "pos", F.coalesce("roi", F.lit(0)).alias("roi"))
