"""Batch writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gathered(df: DataFrame, column: str) -> DataFrame:
    """Rows of one value together, so that a partitioned write makes few files. Adaptive
    execution splits the partitions of values that are too big for one task."""
    return df.hint("rebalance", F.col(column))


def write_labelled(df: DataFrame, path: str, fmt: str = "parquet", file: str | None = None, mode: str = "overwrite") -> None:
    """Labelled table; with ``file`` one output folder per source file."""
    w = (gathered(df, file) if file else df).write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"').option("encoding", "UTF-8")
    (w.partitionBy(file) if file else w).save(path)


BOM = "\ufeff"


def write_csv_bom(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV whose files begin with a byte order mark, as spreadsheet programs expect of UTF-8: the mark is put before the name of the
    first column, which every file starts with."""
    first, *rest = df.columns
    named = df.toDF(BOM + first, *rest)
    w = named.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "")
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_groups(df: DataFrame, path: str, group: str, fmt: str = "parquet", max_rows: int = 5_000_000) -> None:
    """One folder per group; a huge group is written by several tasks, in several files."""
    w = gathered(df, group).write.mode("overwrite").option("maxRecordsPerFile", max_rows)
    w.partitionBy(group).format(fmt).save(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add a metrics record; earlier rows are the history, so nothing needs a backup."""
    metrics.write.mode("append").parquet(path)


def product_bucket(product: str, buckets: int):
    """Bucket number of a product, to partition a store by when products are many."""
    return F.pmod(F.xxhash64(product), F.lit(buckets)).cast("int")


def write_prediction_store(df: DataFrame, path: str, product: str = "product_id", buckets: int = 256, mode: str = "append") -> None:
    """Append predictions, partitioned by product bucket."""
    bucketed = df.withColumn("bucket", product_bucket(product, buckets))
    gathered(bucketed, "bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def kafka_batch(df: DataFrame, servers: str, topic: str, columns: Sequence[str] = ("key", "value")) -> None:
    """Send (key, value) rows to a topic (the connector package is the user's)."""
    df.select(*columns).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
