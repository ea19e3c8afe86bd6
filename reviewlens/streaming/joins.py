"""Streams that meet streams: completeness with a waiting time, and rows that come too late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.streaming.stores import EpochTable


def status() -> F.Column:
    return F.when(F.col("processed") >= F.col("expected"), "complete").when(F.col("processed") > 0, "partial").otherwise("missing")


def stream_completeness(expected: DataFrame, processed: DataFrame, key: str, row_id: str, wait: str, delay: str, length: str = "1 day") -> DataFrame:
    """Per key and window of sending: how many rows were expected, and how many of them processed within ``wait``.

    ``expected`` (key, row_id, expected_at) and ``processed`` (row_id, processed_at) are streams; a row that is
    processed twice counts once. Watermarks on both sides let a row that nothing answers leave the join when its wait is
    over, and a window leave the counts when all of its rows have: three stateful steps in one append query.
    A key whose window is not complete by then is ``partial`` or ``missing``.
    """
    e = expected.withWatermark("expected_at", delay)
    p = processed.select(F.col(row_id).alias("rl_id"), "processed_at").withWatermark("processed_at", delay)
    p = p.dropDuplicatesWithinWatermark(["rl_id"])
    after = F.expr(f"processed_at >= expected_at AND processed_at <= expected_at + INTERVAL {wait}")
    joined = e.join(p, (F.col(row_id) == F.col("rl_id")) & after, "leftOuter")
    counts = joined.groupBy(F.window("expected_at", length).alias("w"), key).agg(F.count("*").alias("expected"), F.count("processed_at").alias("processed"))
    return counts.select(key, F.col("w.start").alias("window_start"), "expected", "processed").withColumn("status", status())


class LateSplit:
    """Parts the rows of each micro-batch into those on time and those behind the watermark.

    The watermark of a micro-batch is the highest event time of all earlier ones less the delay, as in Spark's own
    operators; here it is kept on disk, one number per micro-batch, so the late rows can be stored instead of
    dropped, and a micro-batch that is run again parts its rows the same way. Rows without an event time are
    late. On time and late together are all rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, ts: str, delay: str):
        self.ts, self.delay = ts, delay
        self.on_time = EpochTable(spark, f"{path}/on-time", schema)
        self.late = EpochTable(spark, f"{path}/late", schema)
        self.marks = EpochTable(spark, f"{path}/marks", "high timestamp")

    def process(self, batch: DataFrame, epoch: int) -> None:
        high = self.marks.read(before=epoch).agg((F.max("high") - F.expr(f"INTERVAL {self.delay}")).alias("w")).first()["w"]
        behind = F.col(self.ts).isNull() | (F.lit(False) if high is None else F.col(self.ts) < F.lit(high))
        rows = batch.withColumn("rl_late", behind).persist()
        self.on_time.write(rows.filter(~F.col("rl_late")).drop("rl_late"), epoch)
        self.late.write(rows.filter("rl_late").drop("rl_late"), epoch)
        self.marks.write(rows.agg(F.max(self.ts).alias("high")), epoch)
        rows.unpersist()
