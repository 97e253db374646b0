"""The folder that driver and executors share."""

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def own_dir() -> str:
    return tempfile.mkdtemp(prefix="trackweave-")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names; where that is unset in local mode (tests), below a temporary folder of this process.

    On a cluster a local folder would be another one on each machine, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(named or own_dir()).rstrip('/')}/{label}/{uuid.uuid4().hex}"


def stored_lines(lines: DataFrame) -> str:
    """The path of text files with the column ``value`` of ``lines``, partition by partition."""
    path = shared_path(lines.sparkSession, "text")
    lines.select("value").write.text(path)
    return path


def stored_rows(df: DataFrame) -> DataFrame:
    """The rows, made once and read back from Parquet, for what several steps or jobs read."""
    path = shared_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stored_csv(df: DataFrame) -> str:
    """The path of tab-delimited files of ``df``, each with the header, and NA where a value is missing."""
    path = shared_path(df.sparkSession, "csv")
    df.write.csv(path, sep="\t", header=True, nullValue="NA")
    return path
