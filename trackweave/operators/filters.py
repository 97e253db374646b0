"""Filters, projections and selections of interval and track rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.strings import standard_chromosome


def in_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None, closed_low: bool = True, closed_high: bool = False) -> DataFrame:
    """Rows with low <= column < high; the flags close or open the ends, None leaves one open. Missing values go."""
    c, tests = F.col(column), [F.col(column).isNotNull()]
    if low is not None:
        tests.append(c >= low if closed_low else c > low)
    if high is not None:
        tests.append(c <= high if closed_high else c < high)
    return df.filter(reduce(Column.__and__, tests))


def filter_pvalue(df: DataFrame, low: float, high: float | None = None) -> DataFrame:
    return in_range(df, "pvalue", low, high or None)


def filter_score(df: DataFrame, low: float, high: float | None = None) -> DataFrame:
    return in_range(df, "score", low, high or None)


def filter_fold(df: DataFrame, low: float, high: float | None = None) -> DataFrame:
    return in_range(df, "fold", low, high or None)


def filter_fdr(df: DataFrame, high: float, low: float | None = None) -> DataFrame:
    """low < fdr <= high."""
    return in_range(df, "fdr", low, high, closed_low=False, closed_high=True)


def above(track: DataFrame, cutoff: float) -> DataFrame:
    return track.filter(F.col("value") > cutoff)


def below(track: DataFrame, cutoff: float) -> DataFrame:
    return track.filter(F.col("value") < cutoff)


def by_gene_length(genes: DataFrame, low: int, high: int) -> DataFrame:
    return genes.filter((F.col("txEnd") - F.col("txStart")).between(low, high))


def top_by_score(df: DataFrame, n: int, descending: bool = True, key: str = "score") -> DataFrame:
    """The n best rows and all that tie with the last of them.

    The n-th best value comes from a distributed top-n; the rows are then filtered, not sorted.
    """
    order = F.col(key).desc() if descending else F.col(key).asc()
    best = df.filter(F.col(key).isNotNull()).select(key).orderBy(order).limit(n)
    limit = best.agg((F.min(key) if descending else F.max(key)).alias("__limit"))
    test = F.col(key) >= F.col("__limit") if descending else F.col(key) <= F.col("__limit")
    return df.join(F.broadcast(limit), test).drop("__limit")


def score_cutoff(df: DataFrame, n: int, descending: bool = True, key: str = "score") -> DataFrame:
    """One row: the score of the n-th best."""
    best = df.filter(F.col(key).isNotNull()).select(key).orderBy(F.col(key).desc() if descending else F.col(key).asc()).limit(n)
    return best.agg((F.min(key) if descending else F.max(key)).alias("cutoff"))


def keyword_search(df: DataFrame, query: str) -> DataFrame:
    """Rows that match a query such as ``[factor]ER [cell]MCF``: each named column contains its text."""
    import re

    terms = re.findall(r"\[([^\]]+)\]([^\[]*)", query)
    return df.filter(reduce(Column.__and__, [F.col(f.strip()).contains(t.strip()) for f, t in terms], F.lit(True)))


def first_per_name(df: DataFrame, name: str = "name", *order: str) -> DataFrame:
    """One row per name, the first in the given order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(name).orderBy(*order))).filter("__n = 1").drop("__n")


def standardise(df: DataFrame) -> DataFrame:
    return df.withColumn("chrom", standard_chromosome(F.col("chrom")))


def complete(df: DataFrame, keys: DataFrame, on: list[str], fill: float = 0) -> DataFrame:
    """All rows of ``keys``, with ``fill`` in the columns of missing ones."""
    return keys.join(df, on, "left").fillna(fill)


def scored_everywhere(df: DataFrame) -> DataFrame:
    """One row: whether each chromosome has scores, and only present ones."""
    return df.agg(F.coalesce(F.bool_and(F.col("score").isNotNull()), F.lit(False)).alias("scored"))


def filled_scores(df: DataFrame, score: float = 1.0) -> DataFrame:
    return df.withColumns({"score": F.lit(score), "name": F.lit("0")})


def percentile_part(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows between two percentiles of a column (by index, both in)."""
    from .aggregates import nth_values

    last = F.col("n") - 1
    limits = nth_values(df, column, F.floor(last * low / 100), F.floor(last * high / 100)).select(F.col("v0").alias("__low"), F.col("v1").alias("__high"))
    return df.join(F.broadcast(limits), F.col(column).between(F.col("__low"), F.col("__high"))).drop("__low", "__high")
