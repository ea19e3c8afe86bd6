"""Topic in, topic out: envelopes, decoding, stateless enrichment.

The same envelope (key, value, topic, partition, offset, timestamp) is read from Kafka or
from files, so everything behind it is independent of the transport.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from reviewlens.operators.project import decode_message, harmonise
from reviewlens.operators.rules import doc_polarity

ENVELOPE = "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"


def kafka_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """Topic from the earliest offset (the connector package is the user's)."""
    r = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_offsets:
        r = r.option("maxOffsetsPerTrigger", max_offsets)
    return r.load().select(
        F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset", "timestamp"
    )


def file_stream(
    spark: SparkSession, path: str, schema: str = ENVELOPE, fmt: str = "parquet", files_per_batch: int = 1, pattern: str | None = None
) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(path)


def decode(stream: DataFrame) -> DataFrame:
    """Envelope to harmonised messages, with the topic's partition and offset."""
    m = F.col("__rl_m")  # decoded once, read by every field
    return stream.withColumn("__rl_m", decode_message("value")).select(
        *harmonise(m),
        F.element_at(m, "Product_Category").alias("product_category"),
        "partition",
        "offset",
        F.col("timestamp").alias("arrived"),
    )


def enrich(messages: DataFrame, sentiment: Column | None = None) -> DataFrame:
    """Score the text only, keep the product columns beside it, encode for the output topic."""
    label = doc_polarity("review_content") if sentiment is None else sentiment
    scored = messages.withColumn("predicted_sentiment", label)
    fields = [
        F.col("review_id"),
        F.col("review_content").alias("reviewContent"),
        F.col("product_id").alias("Product_ID"),
        F.col("product_category").alias("Product_Category"),
        F.col("predicted_sentiment"),
        (F.unix_micros(F.current_timestamp()) / 1e6).alias("processed_at"),
    ]
    return scored.select(
        F.col("product_id").alias("key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")
    )


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    return (
        df.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )


def drain(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Process what is there now, in as many micro-batches as it takes, then stop."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def drain_to_parquet(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append-mode drain into a parquet folder; returns that folder as a batch table."""
    drain(df.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)
    return df.sparkSession.read.schema(df.schema).parquet(path)
