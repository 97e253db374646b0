"""The n-th smallest values of groups of any size, by rounds of counting: no task ever holds the rows of a group.

A value is a whole number of 64 bits in the order of the values. Each round counts the values of all groups by the next 16 bits and finds the bucket that holds the wanted place, at
most 65,536 counts a group; only values of that bucket go on to the next round. Four rounds end at one value, however the values are spread.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, LongType

STEP = 16


@F.arrow_udf(LongType())
def _order_of(values: pa.Array) -> pa.Array:
    v = values.fill_null(0).to_numpy(zero_copy_only=False) + 0.0  # -0 becomes 0
    bits = np.where(np.isnan(v), np.nan, v).view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits), mask=values.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(DoubleType())
def _value_of(order: pa.Array) -> pa.Array:
    bits = order.to_numpy(zero_copy_only=False)
    return pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64))


def nth_by_group(df: DataFrame, keys: list[str], column: str, *places: Column) -> DataFrame:
    """Rows (keys, i, value): the value at the i-th of the 0-based ``places``, expressions of the group's number of values ``n``, in the sorted column.

    Null values do not count, NaN is the largest; null keys are a group. Groups without values have no row, nor do places outside of 0 to n - 1. Whole numbers keep their type.
    """
    whole = isinstance(df.schema[column].dataType, IntegralType)
    value = F.col(f"`{column}`")
    names = [f"k{j}" for j in range(len(keys))] or ["k0"]
    group = [F.col(f"`{k}`").alias(a) for k, a in zip(keys, names, strict=False)] or [F.lit(0).alias("k0")]
    rows = df.filter(value.isNotNull()).select(*group, (value.cast("long") if whole else _order_of(value.cast("double"))).alias("v"))

    def same(a: str, b: str) -> Column:
        out = F.lit(True)
        for k in names:
            out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return out

    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), p.cast("long").alias("rest")) for i, p in enumerate(places)])).alias("x")
    state = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).select(*names, "n", asked).filter("x.rest >= 0 and x.rest < n").select(*names, "x.i", "x.rest")
    counts = rows.groupBy(*names, F.shiftright("v", 48).alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    counts = state.alias("s").join(counts.alias("c"), same("s", "c")).select(*[F.col(f"s.{k}").alias(k) for k in names], "i", "rest", "bucket", "c")
    for shift in (32, 16, 0, None):
        # the bucket that holds the wanted place, and the place in it
        upto = F.sum("c").over(W.partitionBy(*names, "i").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        state = counts.withColumn("upto", upto).filter("rest < upto and rest >= upto - c").select(*names, "i", (F.col("rest") - F.col("upto") + F.col("c")).alias("rest"), F.col("bucket").alias("prefix"))
        if shift is None:
            break
        inside = rows.alias("r").join(state.alias("s"), same("r", "s") & (F.shiftright("r.v", shift + STEP) == F.col("s.prefix")))
        counts = inside.select(*[F.col(f"s.{k}").alias(k) for k in names], "i", "rest", F.shiftright("r.v", shift).alias("bucket")).groupBy(*names, "i", "rest", "bucket").agg(F.count(F.lit(1)).alias("c"))
    out = F.col("prefix").cast(df.schema[column].dataType) if whole else _value_of("prefix")
    return state.select(*[F.col(a).alias(k) for k, a in zip(keys, names, strict=False)], "i", out.alias("value"))


def medians(df: DataFrame, keys: list[str], column: str, name: str = "median") -> DataFrame:
    """Exact median of each group: the middle value, or the mean of the two middle ones."""
    both = nth_by_group(df, keys, column, F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    return both.groupBy(*keys).agg(F.avg(F.col("value").cast("double")).alias(name))
