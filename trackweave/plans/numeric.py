"""Queries of distribution and array functions over the driver's tables."""

from pyspark.sql import functions as F

from ..functions import arrays as R
from ..functions import probability as D
from ..functions import strings as S
from ..operators import windows as O
from . import views as V
from .views import query, rounded


def small(spark, sf):
    return V.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey % 40 AS k", "(o_orderkey % 300) / 10.0 + 0.5 AS lam", "o_custkey % 90 + 10 AS n", "(o_orderkey % 97 + 1) / 100.0 AS p").selectExpr("id", "k", "cast(lam as double) AS lam", "n", "cast(p as double) AS p")


SMALL = "SELECT o_orderkey AS id, o_custkey % 40 AS k, CAST((o_orderkey % 300) / 10.0 + 0.5 AS DOUBLE) AS lam, o_custkey % 90 + 10 AS n, CAST((o_orderkey % 97 + 1) / 100.0 AS DOUBLE) AS p FROM orders"


@query(f"SELECT id, round(list_sum([exp(-lam + i * ln(lam) - lgamma(i + 1)) FOR i IN range(0, k + 1)]), 8) AS p FROM ({SMALL})")
def poisson_lower(spark, sf):
    return small(spark, sf).select("id", F.round(D.poisson_cdf(F.col("k"), F.col("lam")), 8).alias("p"))


@query(f"SELECT id, round(list_sum([exp(-lam + i * ln(lam) - lgamma(i + 1)) FOR i IN range(k + 1, k + 250)]), 8) AS p FROM ({SMALL})")
def poisson_upper(spark, sf):
    return small(spark, sf).select("id", F.round(D.poisson_upper(F.col("k"), F.col("lam")), 8).alias("p"))


@query(f"SELECT id, round(exp(-lam + k * ln(lam) - lgamma(k + 1)), 8) AS p FROM ({SMALL})")
def poisson_density(spark, sf):
    return small(spark, sf).select("id", F.round(D.poisson_pdf(F.col("k"), F.col("lam")), 8).alias("p"))


@query(f"SELECT id, round(list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)) FOR i IN range(0, least(k, n) + 1)]), 8) AS tail FROM ({SMALL})")
def binomial_lower(spark, sf):
    return small(spark, sf).select("id", F.round(D.binomial_cdf(F.col("k"), F.col("n"), F.col("p")), 8).alias("tail"))


@query(f"SELECT id, round(coalesce(list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)) FOR i IN range(k + 1, n + 1)]), 0), 8) AS tail FROM ({SMALL})")
def binomial_upper(spark, sf):
    return small(spark, sf).select("id", F.round(D.binomial_upper(F.col("k"), F.col("n"), F.col("p")), 8).alias("tail"))


@query(f"SELECT id, round(coalesce(list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + lgamma(201) - lgamma(k + 10 - i + 1) - lgamma(200 - k - 10 + i + 1) - lgamma(n + 201) + lgamma(k + 11) + lgamma(n + 200 - k - 10 + 1)) FOR i IN range(4, least(n, k + 10) + 1)]), 0), 8) AS tail FROM ({SMALL})")
def hypergeometric_tail(spark, sf):
    """P(more than 3 of n good ones among k + 10 draws, with 200 bad ones)."""
    tail = D.hypergeometric_upper(F.lit(3), F.col("n"), F.lit(200), F.col("k") + 10)
    return small(spark, sf).select("id", F.round(tail, 8).alias("tail"))


@query()
def normal_distribution(spark, sf):
    z = (F.col("lam") - 15) / 5
    return rounded(small(spark, sf).select("id", D.normal_cdf(z).alias("cdf"), D.normal_quantile(D.normal_cdf(z)).alias("z")), "cdf", "z")


VECTORS = "SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings"


def vectors(spark, sf):
    return V.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@query(f"SELECT vec_id, round(list_avg(v), 6) AS average, round(list_median(v), 6) AS middle, list_max(v) AS highest, list_min(v) AS lowest FROM ({VECTORS})".replace("list_median(v)", "list_aggregate(v, 'median')"))
def row_statistics(spark, sf):
    v = vectors(spark, sf)
    return rounded(v.select("vec_id", R.mean(F.col("v")).alias("average"), R.median(F.col("v")).alias("middle"), F.array_max("v").alias("highest"), F.array_min("v").alias("lowest")), "average", "middle")


@query(f"SELECT i AS position, round(avg(x), 6) AS average, max(x) AS highest, min(x) AS lowest FROM (SELECT unnest(v) AS x, unnest(range(0, len(v)))::INTEGER AS i FROM ({VECTORS})) GROUP BY i")
def column_profile(spark, sf):
    rows = vectors(spark, sf).select(F.posexplode("v").alias("position", "x"))
    return rounded(rows.groupBy("position").agg(F.avg("x").alias("average"), F.max("x").alias("highest"), F.min("x").alias("lowest")), "average")


@query(f"SELECT vec_id, i AS position, round(sum(x) OVER (PARTITION BY vec_id ORDER BY i), 6) AS running FROM (SELECT vec_id, unnest(v) AS x, unnest(range(0, len(v)))::INTEGER AS i FROM ({VECTORS}))")
def array_running_total(spark, sf):
    return rounded(vectors(spark, sf).select("vec_id", F.posexplode(R.running_total(F.col("v"))).alias("position", "running")), "running")


@query(f"SELECT vec_id, i AS position, round(d, 6) AS difference FROM (SELECT vec_id, i, x - lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS d0, lead(x) OVER (PARTITION BY vec_id ORDER BY i) - x AS d FROM (SELECT vec_id, unnest(v) AS x, unnest(range(0, len(v)))::INTEGER AS i FROM ({VECTORS}))) WHERE d IS NOT NULL")
def array_differences(spark, sf):
    return rounded(vectors(spark, sf).select("vec_id", F.posexplode(R.differences(F.col("v"))).alias("position", "difference")), "difference")


@query(f"SELECT vec_id, n, idx FROM (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY x, i) - 1 AS INTEGER) AS n, i AS idx FROM (SELECT vec_id, unnest(v) AS x, unnest(range(0, len(v)))::INTEGER AS i FROM ({VECTORS})))")
def array_sort_order(spark, sf):
    return vectors(spark, sf).select("vec_id", F.posexplode(R.sort_order(F.col("v"))).alias("n", "idx"))


@query(f"SELECT vec_id, CAST(count(*) AS INTEGER) AS inside FROM (SELECT vec_id, unnest(v) AS x FROM ({VECTORS})) WHERE x BETWEEN -0.1::DOUBLE AND 0.1::DOUBLE GROUP BY vec_id")
def array_within(spark, sf):
    return vectors(spark, sf).select("vec_id", F.size(R.within(F.col("v"), F.lit(-0.1), F.lit(0.1))).alias("inside")).filter("inside > 0")


@query("SELECT o_orderkey AS id, CAST(CASE WHEN o_totalprice < 1000 THEN -1 WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 150000 THEN 1 WHEN o_totalprice < 300000 THEN 2 ELSE 3 END AS INTEGER) AS bin FROM orders")
def bin_index(spark, sf):
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), R.bin_index(F.col("o_totalprice"), [1000, 50_000, 150_000, 300_000]).alias("bin"))


@query("""SELECT s_suppkey AS id, '#' || upper(printf('%02x', s_suppkey % 256)) || upper(printf('%02x', s_nationkey * 9 % 256)) || '0A' AS colour FROM supplier""")
def hex_colours(spark, sf):
    c = R.as_hex_colour(F.col("s_suppkey") % 256, F.col("s_nationkey").cast("long") * 9 % 256, F.lit(10))
    return V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), c.alias("colour"))


@query(f"SELECT id, CAST(list_min([CASE WHEN list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p)) FOR j IN range(0, i + 1)]) >= 0.9::DOUBLE THEN i ELSE n END FOR i IN range(0, n + 1)]) AS DOUBLE) AS k FROM ({SMALL})")
def binomial_quantiles(spark, sf):
    return small(spark, sf).select("id", D.binomial_quantile(F.lit(0.9), F.col("n"), F.col("p")).alias("k"))


@query(f"SELECT id, CAST(list_min([CASE WHEN list_sum([exp(-lam + j * ln(lam) - lgamma(j + 1)) FOR j IN range(0, i + 1)]) >= 0.9::DOUBLE THEN i ELSE 999 END FOR i IN range(0, 90)]) AS DOUBLE) AS k FROM ({SMALL})")
def poisson_quantiles(spark, sf):
    return small(spark, sf).select("id", D.poisson_quantile(F.lit(0.9), F.col("lam")).alias("k"))


@query("""SELECT chrom, pos, last_value(v IGNORE NULLS) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS value FROM (SELECT chrom, pos, CASE WHEN value >= 30 THEN value END AS v FROM v_track)""")
def fill_forward(spark, sf):
    t = V.track(spark, sf).select("chrom", "pos", F.when(F.col("value") >= 30, F.col("value")).alias("value"))
    return O.fill_forward(t, 200_000)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 25 AND l_linenumber % 2 = 1 THEN NULL ELSE (CASE WHEN l_quantity >= 25 THEN l_quantity ELSE 0 END) + (CASE WHEN l_linenumber % 2 = 0 THEN l_tax ELSE 0 END) END AS total,
CAST(l_quantity >= 25 AS INTEGER) + CAST(l_linenumber % 2 = 0 AS INTEGER) AS n FROM lineitem""")
def array_sum_and_count(spark, sf):
    x = F.array(F.when(F.col("l_quantity") >= 25, F.col("l_quantity")).otherwise(float("nan")))
    y = F.array(F.when(F.expr("l_linenumber % 2 = 0"), F.col("l_tax")))
    sums, counts = R.added(x, y)
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.get(sums, F.lit(0)).alias("total"), F.get(counts, F.lit(0)).alias("n"))


PER_ORDER = "SELECT l_orderkey, list_sort(list(l_quantity)) AS q, len(list(l_quantity)) AS n FROM lineitem GROUP BY ALL"


@query(f"""SELECT l_orderkey, round(q[n] - q[1], 4) AS widest, q[l + 1] AS low, q[r + 1] AS high, list_aggregate(q[l + 1:r + 1], 'median') AS middle
FROM (SELECT *, greatest(CAST(round(25.0::DOUBLE * n / 100) AS INTEGER) - 1, 0) AS l, least(CAST(round(75.0::DOUBLE * n / 100) AS INTEGER), n - 1) AS r FROM ({PER_ORDER}))""")
def boundaries_and_medians(spark, sf):
    o = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    b = R.boundary_median(F.col("q"), 25.0, 75.0)
    return o.select("l_orderkey", F.round(R.widest_difference(F.col("q")), 4).alias("widest"), b.low.alias("low"), b.high.alias("high"), b.middle.alias("middle"))


@query("""SELECT o_orderkey, CASE WHEN p = 0 THEN '(<=4.9e-324)' WHEN p < 0.001 THEN printf('(%.1e)', p) ELSE printf('(%.3f)', p) END AS label FROM (
SELECT o_orderkey, CASE WHEN k % 5 = 0 THEN 0 ELSE k / 17.0::DOUBLE * CASE k % 3 WHEN 0 THEN 1e-9::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1e-3::DOUBLE END END AS p FROM (SELECT o_orderkey, o_custkey % 16 AS k FROM orders))""")
def p_value_labels(spark, sf):
    k = F.col("o_custkey") % 16
    p = F.when(k % 5 == 0, 0.0).otherwise(k.cast("double") / 17 * F.when(k % 3 == 0, 1e-9).when(k % 3 == 1, 1.0).otherwise(1e-3))
    return V.table(spark, sf, "orders").select("o_orderkey", S.p_value_label(p).alias("label"))


@query("""SELECT o_orderkey, CAST(round(o_totalprice / 250) * 250 AS BIGINT) AS nearest, printf('%.5e', sqrt(o_totalprice)) AS code, CASE WHEN o_totalprice / 1e6::DOUBLE * 100 < 0.1 THEN printf('%.2f %%', o_totalprice / 1e6::DOUBLE * 100) ELSE printf('%.1f %%', o_totalprice / 1e6::DOUBLE * 100) END AS label,
regexp_replace(o_orderpriority, '^.*-', '') AS bare FROM orders""")
def number_labels(spark, sf):
    return V.table(spark, sf, "orders").select(
        "o_orderkey", R.nearest_multiple(F.col("o_totalprice"), 250).alias("nearest"), S.scientific(F.sqrt("o_totalprice")).alias("code"), S.percent_label(F.col("o_totalprice") / 1e6).alias("label"),
        S.without_prefix(F.regexp_replace("o_orderpriority", "^.*-", "chr")).alias("bare"),
    )


@query("SELECT l_orderkey, CAST(max(i) FILTER (WHERE q = m) AS INTEGER) AS place FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, max(l_quantity) OVER (PARTITION BY l_orderkey) AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS i FROM lineitem) GROUP BY ALL")
def place_of_largest(spark, sf):
    a = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x.l_quantity)
    o = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(a.alias("q"))
    return o.select("l_orderkey", R.last_at_most(F.col("q")).alias("place"))


@query()
def random_draws(spark, sf):
    """Three integers from 5 to 9 per part."""
    return V.table(spark, sf, "part").select("p_partkey", R.random_integers(F.col("p_partkey"), 5, 9, 3).alias("draws"))
