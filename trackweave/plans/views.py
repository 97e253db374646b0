"""Relations derived from the driver's tables by integer arithmetic, in Spark and in SQL, and the registry of queries."""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with SQL that may use the views below."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# rows of a table to one partition of what is made from it
ROWS = 500_000


def parts(spark: SparkSession, sf: str, name: str = "lineitem") -> int:
    """Partitions for what is made from a table: the session's number, more where the table (counted by its footers) is larger, so that a task's share does not grow with it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf, name).count() // ROWS))


# each view may use those before it
VIEWS = {
    "v_points": "SELECT event_type AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS pos, value, user_id FROM events",
    "v_track": "SELECT chrom, pos, max(value) AS value FROM v_points GROUP BY ALL",
    "v_treat": "SELECT chrom, pos, max(value) AS value FROM v_points WHERE user_id % 2 = 0 GROUP BY ALL",
    "v_control": "SELECT chrom, pos, max(value) AS value FROM v_points WHERE user_id % 2 = 1 GROUP BY ALL",
    "v_lengths": "SELECT chrom, max(pos) - min(pos) + 1 AS length FROM v_track GROUP BY ALL",
    "v_shifted": "SELECT t.chrom, pos - lo AS pos, value FROM v_track t JOIN (SELECT chrom, min(pos) AS lo FROM v_track GROUP BY ALL) m ON m.chrom = t.chrom",
    "v_peaks": """SELECT o_orderpriority AS chrom, o_orderkey * 100 + o_custkey % 100 AS start, o_orderkey * 100 + o_custkey % 100 + 50 + o_custkey % 150 AS "end",
      o_orderkey * 100 + o_custkey % 100 + 25 AS summit, o_totalprice AS score, o_totalprice / 1000.0::DOUBLE AS total_p,
      CAST(o_custkey % 400 AS DOUBLE) / 2 AS pvalue, CAST(o_custkey % 97 AS DOUBLE) / 4 AS fold, CAST(o_orderkey % 101 AS DOUBLE) / 2 AS fdr, o_orderkey AS name FROM orders""",
    "v_regions": """SELECT l_returnflag AS chrom, l_orderkey * 100 + l_linenumber * 7 AS start, l_orderkey * 100 + l_linenumber * 7 + CAST(l_quantity AS BIGINT) AS "end",
      l_extendedprice AS score, l_linenumber AS line, l_linestatus AS status FROM lineitem""",
    "v_tags": "SELECT l_returnflag AS chrom, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_orderkey * 25 + l_linenumber AS pos, l_orderkey * 10 + l_linenumber AS tag_id FROM lineitem",
    "v_signal": "SELECT l_returnflag AS chrom, l_orderkey * 100 + l_partkey % 100 AS pos, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL",
    "v_genes": """SELECT p_type AS chrom, 'g' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand,
      p_partkey * 5000 + p_size * 10 AS txStart, p_partkey * 5000 + p_size * 47 + 1000 AS txEnd,
      p_partkey * 5000 + p_size * 10 + 100 AS cdsStart, p_partkey * 5000 + p_size * 47 + 900 AS cdsEnd,
      [p_partkey * 5000 + p_size * 10, p_partkey * 5000 + p_size * 10 + 400, p_partkey * 5000 + p_size * 10 + 800] AS exonStarts,
      [p_partkey * 5000 + p_size * 10 + 200, p_partkey * 5000 + p_size * 10 + 600, p_partkey * 5000 + p_size * 47 + 1000] AS exonEnds, p_size FROM part""",
    "v_coords": "SELECT DISTINCT p_type AS chrom, p_partkey * 5000 + CAST(floor(l_extendedprice) AS BIGINT) % 12000 - 3000 AS pos FROM lineitem JOIN part ON l_partkey = p_partkey",
    "v_gene_signal": """SELECT p_type AS chrom, p_partkey * 5000 + CAST(floor(l_extendedprice) AS BIGINT) % 7000 - 2000 AS pos, max(l_quantity) AS value
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "v_gene_peaks": """SELECT p_type AS chrom, p_partkey * 5000 + p_size * 60 - 500 AS start, p_partkey * 5000 + p_size * 60 + 100 AS "end", p_retailprice AS score FROM part""",
}


def oracle(sql: str) -> str:
    """The SQL with the views that it uses in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in needed:
                need(VIEWS[v])
                needed.append(v)

    need(sql)
    if not needed:
        return sql
    body = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    return f"WITH {body} {sql}"


def points(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, sf, "events").select(F.col("event_type").alias("chrom"), seconds.alias("pos"), "value", "user_id")


def track(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    return points(spark, sf).filter(where).groupBy("chrom", "pos").agg(F.max("value").alias("value"))


def treat(spark: SparkSession, sf: str) -> DataFrame:
    return track(spark, sf, "user_id % 2 = 0")


def control(spark: SparkSession, sf: str) -> DataFrame:
    return track(spark, sf, "user_id % 2 = 1")


def lengths(spark: SparkSession, sf: str) -> DataFrame:
    return track(spark, sf).groupBy("chrom").agg((F.max("pos") - F.min("pos") + 1).alias("length"))


def shifted(spark: SparkSession, sf: str) -> DataFrame:
    """The track with each chromosome's first position at 0."""
    t = track(spark, sf)
    low = t.groupBy("chrom").agg(F.min("pos").alias("lo"))
    return t.join(low, "chrom").select("chrom", (F.col("pos") - F.col("lo")).alias("pos"), "value")


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    start = F.expr("o_orderkey * 100 + o_custkey % 100")
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("chrom"), start.alias("start"), (start + F.expr("50 + o_custkey % 150")).alias("end"), (start + 25).alias("summit"), F.col("o_totalprice").alias("score"),
        (F.col("o_totalprice") / 1000).alias("total_p"), (F.expr("o_custkey % 400") / 2).alias("pvalue"), (F.expr("o_custkey % 97") / 4).alias("fold"), (F.expr("o_orderkey % 101") / 2).alias("fdr"), F.col("o_orderkey").alias("name"),
    )


def regions(spark: SparkSession, sf: str) -> DataFrame:
    start = F.expr("l_orderkey * 100 + l_linenumber * 7")
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.col("l_extendedprice").alias("score"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("status")
    )


def tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("l_returnflag AS chrom", "CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand", "l_orderkey * 25 + l_linenumber AS pos", "l_orderkey * 10 + l_linenumber AS tag_id")


def signal(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr("l_returnflag AS chrom", "l_orderkey * 100 + l_partkey % 100 AS pos", "l_extendedprice AS value")
    return rows.repartition(parts(spark, sf), "chrom", "pos").groupBy("chrom", "pos").agg(F.max("value").alias("value"))


def genes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_type AS chrom", "'g' || p_partkey AS name", "CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand",
        "p_partkey * 5000 + p_size * 10 AS txStart", "p_partkey * 5000 + p_size * 47 + 1000 AS txEnd", "p_partkey * 5000 + p_size * 10 + 100 AS cdsStart", "p_partkey * 5000 + p_size * 47 + 900 AS cdsEnd",
        "array(p_partkey * 5000 + p_size * 10, p_partkey * 5000 + p_size * 10 + 400, p_partkey * 5000 + p_size * 10 + 800) AS exonStarts",
        "array(p_partkey * 5000 + p_size * 10 + 200, p_partkey * 5000 + p_size * 10 + 600, p_partkey * 5000 + p_size * 47 + 1000) AS exonEnds", "p_size",
    )


def _on_parts(spark: SparkSession, sf: str, pos: str, *more: str) -> DataFrame:
    n = parts(spark, sf)
    both = table(spark, sf, "lineitem").repartition(n, "l_partkey").join(table(spark, sf, "part").hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    return both.selectExpr("p_type AS chrom", f"{pos} AS pos", *more)


def coords(spark: SparkSession, sf: str) -> DataFrame:
    return _on_parts(spark, sf, "p_partkey * 5000 + cast(floor(l_extendedprice) as bigint) % 12000 - 3000").repartition(parts(spark, sf), "chrom", "pos").distinct()


def gene_signal(spark: SparkSession, sf: str) -> DataFrame:
    return _on_parts(spark, sf, "p_partkey * 5000 + cast(floor(l_extendedprice) as bigint) % 7000 - 2000", "l_quantity AS value").repartition(parts(spark, sf), "chrom", "pos").groupBy("chrom", "pos").agg(F.max("value").alias("value"))


def gene_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr("p_type AS chrom", "p_partkey * 5000 + p_size * 60 - 500 AS start", "p_partkey * 5000 + p_size * 60 + 100 AS end", "p_retailprice AS score")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
