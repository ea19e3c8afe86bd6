"""Event-time windows, dedup and running aggregates on streams.

``watermark`` bounds the state: later rows than that may be dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    stamped = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return stamped.withWatermark(ts, watermark) if watermark else stamped


def windowed_counts(
    df: DataFrame, ts: str, length: str, slide: str | None = None, keys: Sequence[str] = (), watermark: str | None = "10 minutes"
) -> DataFrame:
    """Tumbling (no ``slide``) or sliding window counts."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (
        event_time(df, ts, watermark)
        .groupBy(w.alias("w"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")
    )


def session_counts(df: DataFrame, ts: str, gap: str, keys: Sequence[str], watermark: str | None = "10 minutes") -> DataFrame:
    """Sessions per key, closed by a gap. Sessions merge inside each input task first."""
    df.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (
        event_time(df, ts, watermark)
        .groupBy(F.session_window(ts, gap).alias("w"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")
    )


def dedup_by_id(df: DataFrame, ts: str, ids: Sequence[str], watermark: str = "1 hour") -> DataFrame:
    """One row per id while the id is within the watermark."""
    return event_time(df, ts, watermark).dropDuplicatesWithinWatermark(list(ids))


def running_summary(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Positive / negative / neutral so far, per key (update mode)."""
    c = F.col(label)
    return df.where(c != "2").groupBy(*keys).agg(
        F.count_if(c == "1").alias("positive"),
        F.count_if(c == "-1").alias("negative"),
        F.count_if(c == "0").alias("neutral"),
    )
