"""Queries of metadata records, keyword search and lists."""

from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import filters as L
from ..operators import records as M
from ..sources.text import gff_to_bed
from ..sources.text import parse_key_values as read_key_values
from . import views as V
from .views import query


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events")
def parse_key_values(spark, sf):
    """Records of one line ``k = number`` each."""
    line = F.translate(F.regexp_replace("props", ":", "="), '{}"', "")
    numbered = V.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("file"), F.lit(0).alias("line"), line.alias("value"))
    return read_key_values(numbered, ["k"]).select(F.col("file").cast("long").alias("event_id"), F.col("k").cast("long").alias("k"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_brand LIKE '%#1%'")
def keyword_search(spark, sf):
    return L.keyword_search(V.table(spark, sf, "part"), "[p_name]a [p_brand]#1").select("p_partkey", "p_name")


@query("""SELECT c_mktsegment AS segment, CAST(row_number() OVER (ORDER BY c_mktsegment) AS BIGINT) AS segment_id FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
def add_dimension_values(spark, sf):
    empty = spark.createDataFrame([], "segment_id long, segment string")
    values = V.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"))
    return M.add_values(empty, values, "segment", "segment_id").select("segment", "segment_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_records(spark, sf):
    t = V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return M.update(t, t.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment")), "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 <> 0")
def delete_records(spark, sf):
    t = V.table(spark, sf, "customer").select("c_custkey", "c_name")
    return M.delete(t, t.filter("c_custkey % 4 = 0").select("c_custkey"), "c_custkey")


@query("SELECT c.c_custkey, s.segment_id FROM customer c JOIN (SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment) AS BIGINT) AS segment_id FROM (SELECT DISTINCT c_mktsegment FROM customer)) s ON s.c_mktsegment = c.c_mktsegment")
def star_schema(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    dimension = M.add_values(spark.createDataFrame([], "segment_id long, c_mktsegment string"), c, "c_mktsegment", "segment_id")
    return M.star(c, {"c_mktsegment": (dimension, "segment_id")}).select("c_custkey", "segment_id")


@query("SELECT p_partkey + 1 + (SELECT max(p_partkey) FROM part) AS p_partkey, p_name FROM part")
def new_record_ids(spark, sf):
    t = V.table(spark, sf, "part").select("p_partkey", "p_name")
    return M.with_new_ids(t, t.withColumn("o", F.col("p_partkey")), "p_partkey", "o").select("p_partkey", "p_name")


@query("SELECT l_partkey AS name, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS first_order FROM lineitem GROUP BY ALL")
def first_per_name(spark, sf):
    t = V.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "name")
    return L.first_per_name(t, "name", "l_shipdate", "l_orderkey", "l_linenumber").select("name", F.col("l_orderkey").alias("first_order"))


@query("SELECT k.chrom, CAST(k.bucket AS BIGINT) AS bucket, coalesce(n, 0) AS n FROM (SELECT DISTINCT o_orderpriority AS chrom, b AS bucket FROM orders, (SELECT unnest(range(0, 60)) AS b)) k LEFT JOIN (SELECT o_orderpriority AS c, CAST(floor(o_totalprice / 10000) AS BIGINT) AS b, count(*) AS n FROM orders GROUP BY ALL) ON c = chrom AND b = bucket")
def complete_with_zeros(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("chrom"), F.floor(F.col("o_totalprice") / 10000).alias("bucket"))
    keys = o.select("chrom").distinct().select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))).alias("bucket"))
    return L.complete(o.groupBy("chrom", "bucket").agg(F.count(F.lit(1)).alias("n")), keys, ["chrom", "bucket"])


@query("""SELECT l_returnflag AS chrom, l_orderkey * 100 - 1 AS start, l_orderkey * 100 + 25 AS "end", CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand FROM lineitem""")
def gff_to_bed_rows(spark, sf):
    """GFF lines made from the table, parsed back to BED."""
    line = F.concat_ws("\t", "l_returnflag", F.lit("src"), F.lit("feature"), F.col("l_orderkey") * 100, F.col("l_orderkey") * 100 + 25, F.lit("."), F.when(F.col("l_linestatus") == "O", "+").otherwise("-"), F.lit("."), F.lit("x"))
    return gff_to_bed(V.table(spark, sf, "lineitem").select(line.alias("value"))).select("chrom", "start", "end", "strand")


@query("SELECT p_partkey, CAST(len(list_filter(string_split(translate(p_name, ' ', ','), ','), lambda x: trim(x) <> '')) AS INTEGER) AS parts FROM part")
def clean_names(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", F.size(S.clean_factor(F.translate("p_name", " ", "/"))).alias("parts"))
