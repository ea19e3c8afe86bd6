"""Count-or-timeout batches per product.

A batch closes when it holds ``size`` reviews, or when it is older than the time-out as
its product's next review arrives, or when the whole stream has gone idle. Within a
micro-batch all rows of a product are numbered with ``number_within`` and cut into runs of
``size``, so a product that dominates the stream is still spread over many tasks. Rows of
open batches (fewer than ``size`` per product) are carried in a table from one micro-batch
to the next; a re-run micro-batch reads and writes the same versions, so nothing is lost
or doubled when executors are.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators.numbering import number_within
from reviewlens.streaming.stores import EpochTable

BATCH_SIZE = 20
BATCH_TIMEOUT_S = 30


class ReviewBatches:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        key: str = "product_id",
        order: str = "seq",
        size: int = BATCH_SIZE,
        timeout_s: float = BATCH_TIMEOUT_S,
    ):
        """``schema`` is that of the rows, with ``key`` and the numeric ``order``."""
        self.spark, self.key, self.order = spark, key, order
        self.size, self.timeout = size, timedelta(seconds=timeout_s)
        self.rows = EpochTable(spark, path, f"{schema}, arrived timestamp, batch bigint, reason string, state string")
        self.times = EpochTable(spark, f"{path}-times", "now timestamp")
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema.fields]

    def process(self, batch: DataFrame, epoch: int, now: datetime | None = None) -> None:
        """``foreachBatch`` body. The time of a micro-batch is that of its first attempt, noted on disk, so a
        micro-batch that is run again closes the same batches."""
        noted = self.times.read_epoch(epoch).first()
        if noted is None:
            now = now or datetime.now(timezone.utc)
            self.times.write(self.spark.createDataFrame([(now,)], self.times.schema), epoch)
        else:
            now = noted["now"]
        pending = self._open_rows(epoch).unionByName(batch.select(*self.columns, F.lit(now).alias("arrived"))).persist()
        self.rows.write(self._tag(pending, now), epoch, "state")
        pending.unpersist()

    def _flush_id(self, epoch: int) -> int:
        """Folder of the idle flush after ``epoch`` (negative, so it never meets an epoch)."""
        return -(epoch + 2)

    def _open_rows(self, epoch: int) -> DataFrame:
        """Rows the micro-batch before left open, unless they were flushed since."""
        left = self.rows.read_epoch(epoch - 1).where("state = 'open'").select(*self.columns, "arrived")
        flushed = not self.rows.read_epoch(self._flush_id(epoch - 1)).isEmpty()
        return left.limit(0) if flushed else left

    def _tag(self, pending: DataFrame, now: datetime) -> DataFrame:
        numbered = number_within(
            pending,
            [self.key],
            self.order,
            "__rl_rn",
            total="__rl_n",
            facts={"__rl_first": ("min", "arrived"), "__rl_last": ("max", "arrived")},
        )
        cut = numbered.withColumn("batch", F.floor((F.col("__rl_rn") - 1) / self.size).cast("bigint"))
        # the last batch of a product may be short
        full = F.col("batch") < F.floor(F.col("__rl_n") / self.size)
        # a review of the product came in now, and its open batch had waited too long
        late = (F.col("__rl_last") == F.lit(now)) & (F.col("__rl_first") < F.lit(now - self.timeout))
        reason = F.when(full, "full").when(late & (F.col("__rl_n") < self.size), "timeout")
        return (
            cut.withColumn("reason", reason)
            .withColumn("state", F.when(F.col("reason").isNull(), "open").otherwise("closed"))
            .drop("__rl_rn", "__rl_n", "__rl_first", "__rl_last")
        )

    def flush(self) -> None:
        """The stream is idle: close what is open. Safe to repeat, also after a restart: the last
        micro-batch is looked up among the folders written."""
        last = self.rows.read().where("epoch >= 0").agg(F.max("epoch")).first()[0]
        if last is None:
            return
        left = self.rows.read_epoch(last).where("state = 'open'")
        closed = left.withColumns({"batch": F.lit(0).cast("bigint"), "reason": F.lit("idle"), "state": F.lit("closed")})
        self.rows.write(closed, self._flush_id(last), "state")

    def read(self) -> DataFrame:
        """Closed batches: every row with its batch (unique with key and epoch) and reason."""
        return self.rows.read().where("state = 'closed'").select(*self.columns, "epoch", "batch", "reason")

    def summary(self) -> DataFrame:
        return (
            self.read()
            .groupBy(self.key, "epoch", "batch", "reason")
            .agg(F.count("*").alias("size"))
        )
