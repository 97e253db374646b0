"""Exact deduplication by content hash, in DataFrame operations only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import whole_row

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def row_key(id_: Column, text: Column) -> Column:
    """128-bit key of a row by its id, null apart from all others, and its text."""
    return F.unhex(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null is the empty text.
    Rows are grouped by a 128-bit hash together with the normalised text itself: grouping on the text compares
    bytes, so two texts that share a hash stay apart. Copies collapse in the map-side aggregation, so a group
    that holds a third of all rows sends one row per task. The row with the smallest id stays; a null id is
    never the smallest, and a group of null ids only keeps none (keep_id null, kept false). Rows that repeat
    both id and text are one document written twice: each counts in group_size and all are marked alike.
    Other columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id",
        "text",
        F.sha2("text", 256).alias("text_sha256"),
    )
    rows = rows.select("*", F.unhex(F.md5("text")).alias("h128"))
    groups = (
        rows.groupBy("h128", "text")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.first("text_sha256").alias("sha"))
        .select(F.col("h128").alias("g128"), "sha", "keep_id", "group_size")
    )
    return (
        rows.select("doc_id", "h128", "text_sha256")
        .join(groups, (F.col("h128") == F.col("g128")) & (F.col("text_sha256") == F.col("sha")))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
            "text_sha256",
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts (``exact_groups``), with all its columns: one with the smallest id, null only if all ids are.

    Rows are told apart by id and text, so unique texts stay whatever their ids: null, or those of other rows. Of rows that
    repeat both, one stays. Null is the empty text; nulls in other columns, and columns of any names, are passed on; an empty table gives an empty one.
    """
    # an id is a key by its hash as well, as a null-safe comparison is none that rows are dealt by
    id_, text = F.col(id_col), normalised(F.col(text_col))
    rows = docs.select(whole_row(docs), id_.alias("id"), F.unhex(F.md5(text)).alias("h128"), F.unhex(F.sha2(text, 256)).alias("sha"), F.xxhash64(id_.isNull(), id_).alias("id_key"))
    kept = (
        docs.select(id_.alias("id"), text.alias("text"))
        .groupBy(F.unhex(F.md5("text")).alias("k128"), "text")
        .agg(F.min("id").alias("k_id"))
        .select("k128", F.unhex(F.sha2("text", 256)).alias("k_sha"), "k_id", F.xxhash64(F.col("k_id").isNull(), "k_id").alias("k_key"))
    )
    same = (F.col("h128") == F.col("k128")) & (F.col("sha") == F.col("k_sha")) & (F.col("id_key") == F.col("k_key")) & F.col("id").eqNullSafe(F.col("k_id"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["h128", "sha", "id_key"]).select("doc.*")
