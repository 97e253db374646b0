"""Streaming queries, run to the end of what is there, with the rows that the same batch query gives."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from ..streaming.regions import stream_bins, stream_peaks, stream_regions
from . import views as V
from .views import query


def events(spark: SparkSession, sf: str) -> DataFrame:
    schema = V.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def finished(plan: Callable[[DataFrame], DataFrame], source: DataFrame, end: str = "9999-12-01 00:00:00") -> DataFrame:
    """All rows of ``plan`` over the stream ``source``, written to the shared folder and read back.

    A window is emitted once the watermark has passed it, and the last ones have no later event. So when all is read, the same
    stream goes on with one closing event at ``end``: what is open is emitted, and the window of the closing event never is.
    """
    spark = source.sparkSession
    base = shared_path(spark, "streams")
    spark.createDataFrame([], source.schema).write.parquet(f"{base}/closing")
    out = plan(source.unionByName(spark.readStream.schema(source.schema).parquet(f"{base}/closing")))

    def read_on() -> None:
        q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    read_on()
    values = {"ts": end, "value": "Infinity"}  # the value passes every cut-off
    closing = spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in source.schema])
    closing.write.mode("append").parquet(f"{base}/closing")
    read_on()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def seconds(column: str):
    """Whole seconds since 1970 by the clock of the session, in which the events' times were read."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP'1970-01-01 00:00:00', {column})")


@query("""SELECT event_type, CAST(floor(epoch(s)) AS BIGINT) AS start, round(sum(value), 4) AS total, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL 1 hour, ts) AS s FROM events) GROUP BY ALL""")
def streamed_hourly_bins(spark, sf):
    return finished(stream_bins, events(spark, sf)).select("event_type", seconds("start").alias("start"), F.round("total", 4).alias("total"), "n")


@query("""SELECT event_type, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, max(value) AS score, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (
SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 50 minutes THEN 0 ELSE 1 END AS fresh FROM events WHERE value >= 20))
GROUP BY event_type, g""")
def streamed_regions(spark, sf):
    return finished(lambda rows: stream_regions(rows, 20), events(spark, sf)).select("event_type", seconds("start").alias("start"), "score", "n")


@query("""SELECT chrom AS event_type, min(pos) AS start, max(pos) + 1 AS "end", arg_min(pos, (-value, pos)) AS summit, max(value) AS score, count(*) AS n
FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY pos, value ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos, value) <= 3000 THEN 0 ELSE 1 END AS fresh FROM v_points WHERE value >= 20))
GROUP BY chrom, s HAVING max(pos) - min(pos) + 1 >= 300""")
def streamed_peaks(spark, sf):
    """Region calling by the batch rule, with state and timers."""
    # pandas knows no times beyond 2262
    found = finished(lambda rows: stream_peaks(rows, 20, min_length=300, max_gap=3000), events(spark, sf), "2261-12-01 00:00:00")
    return found.select("event_type", *[seconds(f"timestamp_seconds(`{c}`)").alias(c) for c in ("start", "end", "summit")], "score", "n")
