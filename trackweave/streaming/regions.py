"""Regions of high values in a stream: the event-time form of the gap rule."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_regions(events: DataFrame, cutoff: float, max_gap: str = "50 minutes", late: str = "1 hour", key: str = "event_type", time: str = "ts") -> DataFrame:
    """Sessions per key of values at or above the cut-off whose gaps stay below ``max_gap``: key, start, end (last time plus the gap), score, n.

    Rows later than ``late`` behind the watermark are left out; a session is emitted when the watermark has passed its end.
    """
    high = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).filter(F.col("value") >= cutoff)
    return (
        high.groupBy(F.session_window(time, max_gap).alias("w"), key)
        .agg(F.max("value").alias("score"), F.count(F.lit(1)).alias("n"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "score", "n")
    )


def join_fragments(fragments: list[tuple], max_gap: int) -> list[tuple]:
    """Fragments (start, end, score, summit, n) that lie at most ``max_gap`` apart become one; of equal scores the first summit counts."""
    out: list[tuple] = []
    for f in sorted(fragments):
        if out and f[0] - out[-1][1] <= max_gap:
            start, end, score, summit, n = out[-1]
            best = max((score, -summit), (f[2], -f[3]))
            out[-1] = (start, max(end, f[1]), best[0], -best[1], n + f[4])
        else:
            out.append(f)
    return out


def stream_peaks(events: DataFrame, cutoff: float, min_length: int = 200, max_gap: int = 50, span: int = 1, late: str = "1 hour", key: str = "event_type", time: str = "ts") -> DataFrame:
    """The rule of ``windows.call_peaks`` on a stream, whole seconds as positions: key, start, end, summit, score, n.

    Each key keeps the fragments that later rows may still join, whatever their order of arrival within ``late``. A timer of event time fires when the watermark
    has passed the end of the first of them by ``max_gap``: what is long enough is emitted, once, and forgotten. Rows behind the watermark are left out. Null keys are a key.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    high = timed.filter(F.col("value") >= cutoff).select(F.col(key).alias("key"), time, F.expr(f"unix_seconds({time})").alias("pos"), F.col("value").cast("double").alias("value"))
    kind = events.schema[key].dataType.simpleString()
    fields = ("starts", "ends", "scores", "summits", "counts")

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fragments = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            fragments += [(p, p, v, p, 1) for p, v in zip(f["pos"].tolist(), f["value"].tolist(), strict=True)]
            fragments = join_fragments(fragments, max_gap)
        passed = state.getCurrentWatermarkMs() / 1000
        done, open_ = [f for f in fragments if f[1] + max_gap < passed], [f for f in fragments if f[1] + max_gap >= passed]
        if open_:
            state.update(tuple(list(x) for x in zip(*open_, strict=True)))
            state.setTimeoutTimestamp((int(min(f[1] for f in open_)) + max_gap + 1) * 1000)
        elif state.exists:
            state.remove()
        rows = [(group[0], s, e + span, at, v, n) for s, e, v, at, n in done if e - s + span >= min_length]
        yield pd.DataFrame(rows, columns=["key", "start", "end", "summit", "score", "n"])

    kinds = ", ".join(f"{f} array<{'double' if f == 'scores' else 'long'}>" for f in fields)
    out = high.groupBy("key").applyInPandasWithState(step, f"key {kind}, start long, end long, summit long, score double, n long", kinds, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnRenamed("key", key)


def stream_bins(events: DataFrame, width: str = "1 hour", late: str = "1 hour", key: str = "event_type", time: str = "ts") -> DataFrame:
    """Sum, mean and count of values per key and tumbling window."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return (
        timed.groupBy(F.window(time, width).alias("w"), key)
        .agg(F.sum("value").alias("total"), F.avg("value").alias("average"), F.count(F.lit(1)).alias("n"))
        .select(key, F.col("w.start").alias("start"), "total", "average", "n")
    )
