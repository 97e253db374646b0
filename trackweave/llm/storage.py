"""Lineage cuts in the folder that the whole cluster shares."""

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def own_dir() -> str:
    return tempfile.mkdtemp(prefix="trackweave-")


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where that is unset in local mode (tests), a temporary one of this process.

    On a cluster a local folder would be another one on each machine, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or own_dir()).rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Later stages then start from the table: a lost executor costs one stage, not the whole lineage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame, name: str = "doc") -> Column:
    """All columns of ``df`` as one, so that columns added beside it never clash; ``select(f"{name}.*")`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)
