"""Sequence and matrix queries."""

from pyspark.sql import functions as F

from ..functions import pwm as P
from ..functions import strings as S
from ..operators import sequences as Q
from ..sources import motifs as M
from ..sources.shared import stored_lines
from . import views as V
from .views import query, rounded


def matrices(spark, sf):
    """Matrices of sixteen rows from the elements of the vectors, as counts."""
    e = V.table(spark, sf, "embeddings")
    rows = F.array(*[F.struct(*[(F.floor(F.abs(F.get("embedding", F.lit(4 * i + j)).cast("double")) * 20) + 1).cast("double").alias(b) for j, b in enumerate("acgt")]) for i in range(16)])
    return e.select("vec_id", rows.alias("counts")).withColumn("pwm", P.normalised(F.col("counts")))


ROWS = "SELECT vec_id, i, [floor(abs(CAST(embedding[4 * i + j] AS DOUBLE)) * 20) + 1 FOR j IN [1, 2, 3, 4]] AS c FROM embeddings, (SELECT unnest(range(0, 16))::INTEGER AS i)"
SHARES = f"SELECT vec_id, i, [x / list_sum(c) FOR x IN c] AS p FROM ({ROWS})"
CODES = "['A', 'C', 'M', 'G', 'R', 'S', 'V', 'T', 'W', 'Y', 'H', 'K', 'D', 'B', 'N']"


@query(f"SELECT vec_id, string_agg({CODES}[k], '' ORDER BY i) AS consensus FROM (SELECT vec_id, i, CAST(p[1] = m AS INTEGER) + 2 * CAST(p[2] = m AS INTEGER) + 4 * CAST(p[3] = m AS INTEGER) + 8 * CAST(p[4] = m AS INTEGER) AS k FROM (SELECT *, list_max(p) AS m FROM ({SHARES}))) GROUP BY vec_id")
def motif_consensus(spark, sf):
    return matrices(spark, sf).select("vec_id", P.consensus(F.col("pwm")).alias("consensus"))


@query(f"SELECT vec_id, string_agg({CODES}[k], '' ORDER BY i) AS code FROM (SELECT vec_id, i, CAST(p[1] >= 0.25::DOUBLE AS INTEGER) + 2 * CAST(p[2] >= 0.25::DOUBLE AS INTEGER) + 4 * CAST(p[3] >= 0.25::DOUBLE AS INTEGER) + 8 * CAST(p[4] >= 0.25::DOUBLE AS INTEGER) AS k FROM ({SHARES})) GROUP BY vec_id")
def motif_degenerate(spark, sf):
    return matrices(spark, sf).select("vec_id", P.degenerate(F.col("pwm")).alias("code"))


@query(f"SELECT vec_id, round(sum(2 + list_sum([x * log2(x) FOR x IN p])), 6) AS bits FROM ({SHARES}) GROUP BY vec_id")
def motif_information(spark, sf):
    return rounded(matrices(spark, sf).select("vec_id", P.total_information(F.col("pwm")).alias("bits")), "bits")


@query(f"SELECT vec_id, i AS position, round(p[1], 6) AS a, round(p[2], 6) AS c, round(p[3], 6) AS g, round(p[4], 6) AS t FROM ({SHARES})")
def motif_rows(spark, sf):
    return matrices(spark, sf).select("vec_id", F.posexplode("pwm").alias("position", "r")).select("vec_id", "position", *[F.round(f"r.{b}", 6).alias(b) for b in "acgt"])


@query(f"""SELECT vec_id, n, string_agg(CASE WHEN s <= c[1] / w THEN 'A' WHEN s <= (c[1] + c[2]) / w THEN 'C' WHEN s <= (c[1] + c[2] + c[3]) / w THEN 'G' ELSE 'T' END, '' ORDER BY i) AS sequence
FROM (SELECT vec_id, i, c, list_sum(c) AS w, n, (n + 0.5::DOUBLE) / 5 AS s FROM ({ROWS}), (SELECT unnest([0, 1, 2, 3, 4]) AS n)) GROUP BY vec_id, n""")
def motif_sequences(spark, sf):
    return matrices(spark, sf).select("vec_id", F.posexplode(P.sequences(F.col("counts"), 5)).alias("n", "sequence"))


def motif_rows_of(motifs):
    rows = motifs.select("record_id", F.array_join("factors", ",").alias("factors"), F.array_join("species", ",").alias("species"), F.posexplode("pwm").alias("i", "r"))
    return rounded(rows.select(F.col("record_id").alias("vec_id"), "factors", "species", "i", "r.a", "r.c", "r.g", "r.t"), *"acgt")


@query(f"""SELECT vec_id, 'F' || vec_id % 7 || ',alt,x' AS factors, 'Homo sapiens,Mus musculus' AS species, i, round(p[1], 6) AS a, round(p[2], 6) AS c, round(p[3], 6) AS g, round(p[4], 6) AS t FROM ({SHARES})""")
def transfac_files(spark, sf):
    """Matrices written as records of two-letter lines and read back by a table function."""
    line = F.transform("counts", lambda r, i: F.concat_ws(" ", F.format_string("%02d", i + 1), *[r[b].cast("string") for b in "gatc"]))
    text = F.concat(
        F.lit("AC  M"), F.col("vec_id").cast("string"), F.lit("\nXX\nNA  F"), (F.col("vec_id") % 7).cast("string"), F.lit("(alt)/x\nBF  T1; f; Species: Homo sapiens, Mus musculus.\nP0  G A T C\n"), F.array_join(line, "\n"), F.lit("\nXX\n//")
    )
    found = M.read_motif_records(spark, stored_lines(matrices(spark, sf).select(text.alias("value"))), "transfac")
    return motif_rows_of(found.withColumn("record_id", F.substring("id", 2, 20).cast("long")))


@query(f"""SELECT vec_id, 'F' || vec_id AS factors, '' AS species, i, round(p[1], 6) AS a, round(p[2], 6) AS c, round(p[3], 6) AS g, round(p[4], 6) AS t FROM ({SHARES})""")
def bulyk_files(spark, sf):
    """Matrices written as records of a line for each base."""
    bases = [F.concat(F.lit(f"{b.upper()}:\t"), F.array_join(F.col(f"counts.{b}").cast("array<string>"), "\t")) for b in "acgt"]
    text = F.concat_ws("\n", F.concat(F.lit("F"), F.col("vec_id").cast("string"), F.lit("_v1")), *bases, F.lit(""))
    found = M.read_motif_records(spark, stored_lines(matrices(spark, sf).select(text.alias("value"))), "bulyk")
    return motif_rows_of(found.withColumn("record_id", F.substring(F.get("factors", F.lit(0)), 2, 20).cast("long")))


@query()
def burrows_wheeler(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", S.bwt(F.col("text")).alias("bwt"))


@query("SELECT doc_id, text FROM documents")
def burrows_wheeler_round_trip(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", S.ibwt(S.bwt(F.col("text"))).alias("text"))


@query("SELECT doc_id, reverse(translate(upper(regexp_replace(text, '[^acgtACGT]', '', 'g')), 'ACGT', 'TGCA')) AS sequence FROM documents")
def reverse_complement(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", S.reverse_complement(F.upper(F.regexp_replace("text", "[^acgtACGT]", ""))).alias("sequence"))


@query(r"""SELECT name, CAST(start AS INTEGER) AS start, read, reverse(translate(far, 'ACGT', 'TGCA')) AS mate FROM (SELECT name, start, upper(substr(sequence, start + 1, 12)) AS read, upper(substr(sequence, start + 89, 12)) AS far FROM (
SELECT name, sequence, w * 300 + CAST('0x' || substr(md5('1|' || name || '|' || w), 1, 8) AS BIGINT) % 300 AS start FROM (
SELECT name, sequence, unnest(range(0, greatest((len(sequence) - 1) // 300, 0) + 1)) AS w FROM (SELECT 'd' || doc_id AS name, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtan') AS sequence FROM documents))))
WHERE len(read) = 12 AND read NOT LIKE '%N%' AND len(far) = 12 AND far NOT LIKE '%N%'""")
def sampled_reads(spark, sf):
    """Paired reads from texts spelt in four letters."""
    letters = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtan")
    named = V.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), letters.alias("sequence"))
    return Q.sample_reads(named, 12, 300, 1, 100).select("name", "start", "read", "mate")


@query("""SELECT motif, num, ref, round(num / e, 6) AS fold, round(CASE WHEN num = 0 THEN 1 ELSE (SELECT sum(exp(-e + i * ln(e) - lgamma(i + 1))) FROM range(num, num + 400) z(i)) END, 8) AS p FROM (
SELECT m.motif, coalesce(num, 0) AS num, coalesce(ref, 0) AS ref, greatest(coalesce(ref, 0), 1) * (SELECT sum("end" - start) FROM r WHERE k = 0) / (SELECT sum("end" - start) FROM r WHERE k = 1) AS e FROM (SELECT DISTINCT motif FROM h) m
LEFT JOIN (SELECT motif, count(DISTINCT (h.chrom, pos)) AS num FROM h JOIN r ON k = 0 AND r.chrom = h.chrom AND r.start < pos + 5 AND pos < r."end" GROUP BY ALL) a ON a.motif = m.motif
LEFT JOIN (SELECT motif, count(DISTINCT (h.chrom, pos)) AS ref FROM h JOIN r ON k = 1 AND r.chrom = h.chrom AND r.start < pos + 5 AND pos < r."end" GROUP BY ALL) b ON b.motif = m.motif)""".replace(
    "FROM h JOIN", "FROM (SELECT DISTINCT l_returnflag AS chrom, l_orderkey * 100 + l_suppkey % 100 AS pos, l_suppkey % 40 AS motif FROM lineitem) h JOIN").replace("FROM h)", "FROM (SELECT l_suppkey % 40 AS motif FROM lineitem))").replace(
    "JOIN r ON", """JOIN (SELECT chrom, k, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom, k ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chrom, k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (SELECT chrom, start, "end", line % 2 AS k FROM v_regions))) GROUP BY chrom, k, island) r ON""").replace(
    "FROM r WHERE", """FROM (SELECT chrom, k, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom, k ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chrom, k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (SELECT chrom, start, "end", line % 2 AS k FROM v_regions))) GROUP BY chrom, k, island) r WHERE"""))
def motif_enrichment(spark, sf):
    """Motif hits in one half of the regions against the other half."""
    r = V.regions(spark, sf)
    hits = V.table(spark, sf, "lineitem").selectExpr("l_returnflag AS chrom", "l_orderkey * 100 + l_suppkey % 100 AS pos", "l_suppkey % 40 AS motif")
    out = Q.motif_enrichment(r.filter("line % 2 = 0"), r.filter("line % 2 = 1"), hits, 5, 64, V.parts(spark, sf))
    return rounded(rounded(out.select("motif", "num", "ref", "fold", "p"), "fold"), "p", digits=8)
