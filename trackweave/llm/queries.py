"""The numbered queries: each applies one operator to its whole table."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_groups
from .fingerprints import fingerprint_edits
from .html_text import extract_main_text
from .licenses import scan_licenses
from .mixing import mixing_plan
from .ngram_join import jaccard_join
from .packing import pack
from .personal import KINDS, find_personal_data
from .quality import fit_quality
from .runs import find_runs
from .suffixes import repeated_passages
from .warc import archive_pages
from .whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[1]


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents; of one in ten by a checksum of its id, the words from some place on repeat."""
    word = r"[^\x20\x09-\x0D]+"
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when((h % 10 == 0) & F.col("text").rlike(word), F.regexp_extract_all("text", F.lit(word), F.lit(0))).alias("words"))
    rows = rows.select("*", F.size("words").alias("n"), F.when(F.col("words").isNotNull(), (F.col("g") % F.size("words")).cast("int")).alias("a"))
    rows = rows.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    rest = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) AS int))), 1, n - a)")
    return rows.select("doc_id", F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.expr("slice(words, 1, a)"), rest), " ")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_repeats(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("faster"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id",
        "n_runs",
        (-F.col("best.before")).alias("start"),
        F.col("best.length"),
        (-F.col("best.faster")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.faster")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")

    def count(wanted: Callable[[Column], Column]) -> Column:
        return F.size(F.filter("spans", wanted)).cast("long")

    def base(kind: str) -> Callable[[Column], Column]:
        return lambda s: s.base & (s.kind == kind)

    return found.select(
        "doc_id",
        *(count(base(kind)).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(joined(F.filter("spans", lambda s: s.base)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count(lambda s: ~s.base).alias("n_disguised"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        *(op1_license_scan, op2_warc, op3_ngram_join, op4_mix_sources, op5_html_text, op6_exact_dedup, op7_quality, op8_suffix_dedup),
        *(op9_pack, op10_fingerprints, op11_periodic_runs, op12_whitening, op13_personal_data),
    )
}

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       coalesce(doc_id = min(doc_id) OVER (PARTITION BY t), false) AS kept,
       sha256(t) AS text_sha256
FROM d
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('17|' || doc_id) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s
), l AS (
  SELECT *, CAST(2 * coalesce(sum(source_size) OVER b, 0) AS BIGINT) AS full_,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS BIGINT) AS open_,
         CAST(sum(source_size) OVER () AS BIGINT) AS total_,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS nth
  FROM w WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), r AS (
  SELECT arg_min((CAST(total_ AS DOUBLE) * 1.5::DOUBLE - full_) / open_, nth) AS rate FROM l
  WHERE (CAST(total_ AS DOUBLE) * 1.5::DOUBLE - full_) / open_ * weight <= 2 * source_size
), t AS (
  SELECT source, n, source_size, least(rate * weight, 2.0::DOUBLE * source_size) AS target FROM l, r
), p AS (
  SELECT d.*, t.source_size, t.target,
         CAST('0x' || substr(key, 1, 8) AS BIGINT) % least((n + 511) // 512, 65536) AS block
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY block, key, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle FROM p
)
SELECT doc_id, size, source_size, target,
       CAST(size * (CAST(middle <= target AS INT) + CAST(source_size + middle <= target AS INT)) AS BIGINT) AS taken
FROM q
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct([array_to_string(ws[i:i+4], ' ') FOR i IN range(1, greatest(len(ws) - 3, 2))]) AS sh
  FROM w WHERE len(ws) > 0
), n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b, c, na.n AS na, nb.n AS nb FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE c >= 0.8 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id, doc_id AS m FROM documents
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.m
), k AS (SELECT doc_id, min(m) AS class_id FROM r GROUP BY ALL)
SELECT k.doc_id,
       least(k.doc_id, coalesce(min(b) FILTER (WHERE c = na AND c = nb), k.doc_id)) AS same_id,
       k.class_id,
       1 + count(b) FILTER (WHERE c = na AND c = nb) AS copies,
       count(b) AS n_links
FROM k LEFT JOIN e ON e.a = k.doc_id GROUP BY k.doc_id, k.class_id
"""

ORACLES: dict[str, str] = {"op3_ngram_join": OP3_SQL, "op4_mix_sources": OP4_SQL, "op6_exact_dedup": OP6_SQL}
