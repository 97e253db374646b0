"""Profiles of whole genes with their sides, of joined exons and introns, and of exons by class of length."""

from pyspark.sql import functions as F

from ..operators import metagene as G
from ..operators import profiles as P
from . import views as V
from .views import query, rounded

STEP = 50
CLASSES = [(0, 300, 200), (300, 800, 500), (800, 3000, 1000)]


def fitted_sql(rows: str, trim: int = 0) -> str:
    """Key, bin and value of regions: ``rows`` has key, strand, start, end, m, pos and value, one per point."""
    return f"""(SELECT key, j AS bin, CASE WHEN any_value(k) >= any_value(m) THEN list(value ORDER BY x)[count(*) // 2 + 1] ELSE arg_max(value, x) END AS value FROM (
SELECT d.*, n - 2 * {trim} AS k, i - {trim} AS x, unnest(range(m)) AS j FROM (
SELECT r.*, coalesce(arr[len(arr) // 2 + 1], 0) AS value FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT DISTINCT key, m, "end" - start AS size, ("end" - start) // {STEP} AS n FROM ({rows}))) r LEFT JOIN (
SELECT key, CASE WHEN strand = '+' THEN raw ELSE n - 1 - raw END AS i, list(value ORDER BY pos) AS arr FROM (
SELECT *, ("end" - start) // {STEP} AS n, (pos - start) * n // ("end" - start) AS raw FROM ({rows}) WHERE pos >= start AND pos < "end") GROUP BY ALL) h ON h.key = r.key AND h.i = r.i) d)
WHERE k > 0 AND x < k AND CASE WHEN k > m THEN x >= 0 AND (x * size + {STEP // 2} * n) * m // (k * size) = j WHEN k = m THEN x = j ELSE x = -{trim} OR (x * size + {STEP // 2} * n) * m // (k * size) <= j END GROUP BY ALL)"""


def points_sql(spans: str) -> str:
    return f"""SELECT x.key, strand, x.start, x."end", m, s.pos, s.value FROM ({spans}) x JOIN v_gene_signal s ON s.chrom = x.chrom AND s.pos >= x.start AND s.pos < x."end" """


def side_sql(end: bool) -> str:
    anchor = f"CASE WHEN (strand = '+') <> {end} THEN txStart ELSE txEnd END"
    return fitted_sql(points_sql(f"""SELECT chrom, name AS key, strand, {anchor} - 2025 AS start, {anchor} + 2025 AS "end", 81 AS m FROM v_genes"""))


_GENE = fitted_sql(points_sql("""SELECT chrom, name AS key, strand, txStart - 75 AS start, txEnd + 75 AS "end", 31 AS m FROM v_genes"""), 1)


META = f"""SELECT bin, round(avg(value), 6) AS value, count(*) AS n FROM (SELECT bin - 20 AS bin, value FROM {side_sql(False)} WHERE bin BETWEEN 20 AND 39
UNION ALL SELECT bin + 20, value FROM {_GENE} UNION ALL SELECT bin - 41 + 51, value FROM {side_sql(True)} WHERE bin BETWEEN 41 AND 60) GROUP BY bin"""


@query(META)
def meta_gene_profile(spark, sf):
    return rounded(G.average_with_sides(V.genes(spark, sf), V.gene_signal(spark, sf), 1500, 2000, 1000, STEP, V.parts(spark, sf)), "value")


@query(META)
def meta_gene_profile_of_namesakes(spark, sf):
    """The same genes under one name."""
    return rounded(G.average_with_sides(V.genes(spark, sf).withColumn("name", F.lit("g")), V.gene_signal(spark, sf), 1500, 2000, 1000, STEP, V.parts(spark, sf)), "value")


def joined_sql(starts: list[str], ends: list[str]) -> str:
    """Average profile of parts moved together: gaps and shifts of up to three parts spelt out."""
    n = len(starts)
    spans = f"""SELECT chrom, name, strand, unnest(range({n})) AS part, unnest([{", ".join(f"{s} - 25" for s in starts)}]) AS start, unnest([{", ".join(f"{e} + 25" for e in ends)}]) AS "end" FROM v_genes"""
    gaps = ["0"] + [f"(g.{starts[i]} - g.{ends[i - 1]} - 50)" for i in range(1, n)]
    summed = ", ".join(" + ".join(gaps[: i + 1]) for i in range(n))
    pts = f"""SELECT x.name, x.strand, x.part, s.pos - [{summed}][x.part + 1] AS pos, s.value, g.{starts[0]} - 25 AS start, g.{ends[-1]} + 25 - [{summed}][{n}] AS "end" FROM ({spans}) x JOIN v_gene_signal s ON s.chrom = x.chrom AND s.pos >= x.start AND s.pos < x."end" JOIN v_genes g ON g.name = x.name"""
    edges = ", ".join(f"min(pos) FILTER (WHERE part = {i}) AS f{i}, max(pos) FILTER (WHERE part = {i}) AS l{i}" for i in range(3))
    moved = f"""SELECT name, [0, d1, greatest(10 - (f2 - coalesce(l1 + d1, l0)), 0)] AS d FROM (SELECT *, greatest(10 - (f1 - l0), 0) AS d1 FROM (SELECT name, {edges} FROM ({pts}) GROUP BY name))"""
    rows = f"""SELECT p.name AS key, strand, start, "end", 21 AS m, pos + d[part + 1] AS pos, value FROM ({pts}) p JOIN ({moved}) d ON d.name = p.name"""
    return f"SELECT bin, round(avg(value), 6) AS value, count(*) AS n FROM {fitted_sql(rows)} GROUP BY bin"


@query(joined_sql(["exonStarts[1]", "exonStarts[2]", "exonStarts[3]"], ["exonEnds[1]", "exonEnds[2]", "exonEnds[3]"]))
def spaced_exon_profile(spark, sf):
    return rounded(P.average_profile(G.joined_bins(V.genes(spark, sf), V.gene_signal(spark, sf), 1000, STEP, parts=V.parts(spark, sf))), "value")


@query(joined_sql(["exonEnds[1]", "exonEnds[2]"], ["exonStarts[2]", "exonStarts[3]"]))
def spaced_intron_profile(spark, sf):
    return rounded(P.average_profile(G.joined_bins(V.genes(spark, sf), V.gene_signal(spark, sf), 1000, STEP, introns=True, parts=V.parts(spark, sf))), "value")


_CLASS = "CASE " + " ".join(f"WHEN e - s >= {a} AND e - s < {b} THEN {{}}".format(f"{i}") for i, (a, b, _) in enumerate(CLASSES)) + " END"
_SIZE = f"[{', '.join(str((size + STEP) // STEP) for _, _, size in CLASSES)}]"
_PARTS = f"""SELECT chrom, {{'name': name, 'part': part, 'class': c}} AS key, strand, s - 25 AS start, e + 25 AS "end", {_SIZE}[c + 1] AS m FROM (
SELECT *, {_CLASS} AS c FROM (SELECT chrom, name, strand, unnest(range(3)) AS part, unnest(exonStarts) AS s, unnest(exonEnds) AS e FROM v_genes)) WHERE c IS NOT NULL"""


@query(f"SELECT key['class'] AS class, bin, round(avg(value), 6) AS value, count(*) AS n FROM {fitted_sql(points_sql(_PARTS))} GROUP BY ALL")
def exon_class_profile(spark, sf):
    values = G.part_bins(V.genes(spark, sf), V.gene_signal(spark, sf), CLASSES, STEP, parts=V.parts(spark, sf))
    return rounded(values.groupBy("class", "bin").agg(F.avg("value").alias("value"), F.count("value").alias("n")), "value")
