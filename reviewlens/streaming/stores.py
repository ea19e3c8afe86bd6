"""Tables kept by ``foreachBatch``: every micro-batch owns one ``epoch=<id>`` folder.

Writing a folder replaces it, so a micro-batch that is run again after a failure leaves
the same result; readers combine the epochs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators.dedup import new_rows
from reviewlens.operators.sampling import latest_n
from reviewlens.sources.writers import product_bucket


class EpochTable:
    """A parquet folder with one sub-folder per micro-batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def write(self, df: DataFrame, epoch: int, partition: str | None = None) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(partition) if partition else w).parquet(f"{self.path}/epoch={epoch}")

    def _load(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", path).parquet(path)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # nothing written yet

    def read_epoch(self, epoch: int) -> DataFrame:
        return self._load(f"{self.path}/epoch={epoch}", self.schema)

    def read(self, before: int | None = None) -> DataFrame:
        """All rows with their ``epoch``; ``before`` leaves out that epoch and later ones."""
        df = self._load(self.path, f"{self.schema}, epoch bigint")
        return df if before is None else df.where(F.col("epoch") < before)


class PredictionStore:
    """Idempotent per-product store: a review id is added once.

    Rows are kept by product bucket, and the id check reads the id columns of the
    micro-batch's own buckets only. Columns may be of any type, maps included.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "review_id", product: str = "product_id", buckets: int = 64):
        self.table = EpochTable(spark, path, f"{schema}, bucket int")
        self.key, self.product, self.buckets = key, product, buckets

    def process(self, batch: DataFrame, epoch: int) -> None:
        tagged = batch.withColumn("bucket", product_bucket(self.product, self.buckets)).persist()
        stored = self.stored(before=epoch, buckets=[r[0] for r in tagged.select("bucket").distinct().collect()])
        fresh = new_rows(stored, tagged, self.key, ["bucket", self.product])
        # few files per bucket; Spark gives a crowded bucket several writers
        self.table.write(fresh.hint("rebalance", "bucket"), epoch, "bucket")
        tagged.unpersist()

    def stored(self, before: int, buckets: list[int]) -> DataFrame:
        """Ids of some buckets from the micro-batches before one; other buckets' folders are not read."""
        ids = self.table.read(before=before).where(F.col("bucket").isin(buckets))
        return ids.select("bucket", self.product, self.key)

    def read(self) -> DataFrame:
        return self.table.read().drop("bucket", "epoch")


class LatestStore:
    """Newest ``n`` rows per key: each epoch keeps its own newest ``n``, readers merge."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: Sequence[str], n: int = 50):
        self.table = EpochTable(spark, path, schema)
        self.keys, self.order, self.n = list(keys), list(order), n

    def process(self, batch: DataFrame, epoch: int) -> None:
        self.table.write(latest_n(batch, self.order, self.n, self.keys), epoch)

    def read(self) -> DataFrame:
        return latest_n(self.table.read().drop("epoch"), self.order, self.n, self.keys)


class UpdateStore:
    """Result of an update-mode aggregation: the newest epoch of a key holds its value."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str]):
        self.table = EpochTable(spark, path, schema)
        self.keys = list(keys)

    def process(self, batch: DataFrame, epoch: int) -> None:
        self.table.write(batch, epoch)

    def read(self) -> DataFrame:
        df = self.table.read()
        values = [c for c in df.columns if c not in (*self.keys, "epoch")]
        newest = df.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "epoch").alias("v"))
        return newest.select(*self.keys, "v.*")
