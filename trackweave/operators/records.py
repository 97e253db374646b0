"""Metadata records: tables of dataset descriptions with dimension tables, changed by writing new versions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from .windows import numbered


def with_new_ids(existing: DataFrame, rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows numbered on from the largest key of ``existing`` (from 1 if it is empty).

    The rows are written in order to the shared folder first: its files are ranges of the order, in which rows are numbered on from the counts of the files before.
    """
    path = shared_path(rows.sparkSession, "ordered")
    rows.orderBy(*order).write.parquet(path)
    ordered = rows.sparkSession.read.schema(rows.schema).parquet(path)
    largest = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    # files are named by their number, of five digits or more
    counted = numbered(ordered, [], F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long"), *order)
    return counted.join(F.broadcast(largest), F.lit(True)).withColumn(key, (F.col("__top") + F.col("nth") + 1).cast("long")).drop("__top", "nth")


def add_values(dimension: DataFrame, values: DataFrame, name: str, key: str) -> DataFrame:
    """The dimension (key, name) with the values that it lacks appended."""
    fresh = values.select(name).filter(F.col(name).isNotNull()).distinct().join(dimension, name, "left_anti")
    return dimension.select(key, name).unionByName(with_new_ids(dimension, fresh, key, name).select(key, name))


def update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the values of ``changes`` in rows of equal key; missing changes leave the old value."""
    columns = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = table.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys, key, "left_anti")


def star(table: DataFrame, dimensions: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The flat table with each named column replaced by its key in a dimension (dimension, key)."""
    for name, (dimension, key) in dimensions.items():
        table = table.join(dimension, name, "left").drop(name)
    return table
