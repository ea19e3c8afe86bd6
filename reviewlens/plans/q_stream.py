"""Streaming queries: each drains a whole table through micro-batches and reads the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.operators import project
from reviewlens.plans.q_io import READABLE, messages
from reviewlens.plans.registry import query
from reviewlens.plans.session import scratch_path
from reviewlens.plans.views import LABELS_LONG, Tables
from reviewlens.streaming import ingest, stores, windows
from reviewlens.streaming.batches import ReviewBatches

FILES = 4  # at least; more for larger tables
ROWS_PER_FILE = 250_000


def files_per_batch(files: int, cores: int) -> int:
    """A file for every core, but at least ``FILES`` micro-batches: what a micro-batch costs besides its rows is then paid once for
    the work of all cores, and not once per file."""
    return max(1, min(files // FILES, cores))


def written(t: Tables, df: DataFrame, order: str) -> tuple[str, str, int]:
    """``df`` written as files in order: their folder, schema and number per micro-batch."""
    path, files = scratch_path(t.spark, "stream"), max(FILES, df.count() // ROWS_PER_FILE)
    df.repartitionByRange(files, order).write.parquet(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return path, schema, files_per_batch(files, t.spark.sparkContext.defaultParallelism)


def staged(t: Tables, df: DataFrame, order: str) -> DataFrame:
    """``df`` as a stream of a few files per micro-batch."""
    path, schema, each = written(t, df, order)
    return ingest.file_stream(t.spark, path, schema, files_per_batch=each)


def envelope(t: Tables) -> DataFrame:
    return messages(t).select(
        F.col("user_id").cast("string").alias("key"),
        "value",
        F.lit("raw_reviews").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def run_batches(t: Tables, stream: DataFrame, body, mode: str = "append") -> None:
    writer = stream.writeStream.outputMode(mode).foreachBatch(body)
    ingest.drain(writer, scratch_path(t.spark, "checkpoint"))


def readable_messages(t: Tables) -> DataFrame:
    """The stream of readable messages; the others are stored as dead letters by a stream of their own."""
    stream = staged(t, envelope(t), "offset")
    good, dead = project.split_dead_letters(stream, "value")
    ingest.drain_to_parquet(dead, scratch_path(t.spark, "dead-letters"), scratch_path(t.spark, "checkpoint"))
    return good


MESSAGE_COLUMNS = """CASE WHEN event_id % 4 >= 2 AND event_id % 8 = 2 THEN 'unknown' ELSE CAST(user_id AS VARCHAR) END AS product_id,
  event_type || ' giao hàng nhanh' AS review_content, CAST(event_id AS VARCHAR) AS review_id"""


@query("stream_ingest", f"SELECT {MESSAGE_COLUMNS}, CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 5 AS INTEGER) ELSE 0 END AS rating FROM events WHERE {READABLE}")
def stream_ingest(t):
    decoded = ingest.decode(readable_messages(t)).select("product_id", "review_content", "review_id", "rating")
    return ingest.drain_to_parquet(decoded, scratch_path(t.spark, "ingested"), scratch_path(t.spark, "checkpoint"))


@query("stream_enrich", f"SELECT {MESSAGE_COLUMNS}, CASE WHEN event_id % 4 = 1 THEN 'Fashion' END AS product_category, 'POSITIVE' AS predicted_sentiment FROM events WHERE {READABLE}")
def stream_enrich(t):
    out = ingest.drain_to_parquet(ingest.enrich(ingest.decode(readable_messages(t))), scratch_path(t.spark, "enriched"), scratch_path(t.spark, "checkpoint"))
    fields = "review_id string, reviewContent string, Product_ID string, Product_Category string, predicted_sentiment string"
    m = F.col("m")
    return out.select(F.from_json("value", fields).alias("m")).select(
        m["Product_ID"].alias("product_id"),
        m["reviewContent"].alias("review_content"),
        m["review_id"].alias("review_id"),
        m["Product_Category"].alias("product_category"),
        m["predicted_sentiment"].alias("predicted_sentiment"),
    )


def reviews_stream(t: Tables) -> DataFrame:
    e = t.events.select(
        F.col("user_id").cast("string").alias("product_id"), F.col("event_id").cast("string").alias("review_id"), F.col("event_id").alias("seq")
    )
    return staged(t, e, "seq")


@query(
    "stream_batches",
    """WITH c AS (SELECT CASE WHEN event_id % 97 <> 0 THEN CAST(user_id AS VARCHAR) END AS product_id, count(*) AS n FROM events GROUP BY ALL)
SELECT product_id, 'full' AS reason, CAST(20 AS BIGINT) AS size, n // 20 AS batches FROM c WHERE n >= 20
UNION ALL SELECT product_id, 'idle', n % 20, 1 FROM c WHERE n % 20 > 0""",
)
def stream_batches(t):
    """Count-or-timeout batches of twenty per product, the rest flushed when idle. Some reviews come
    without a product or a sequence number, and one number is far from all others."""
    i = F.col("event_id")
    seq = F.when(i % 101 != 0, F.when(i == 1, F.lit(1 << 60)).otherwise(i))
    events = t.events.select(F.when(i % 97 != 0, F.col("user_id").cast("string")).alias("product_id"), i.cast("string").alias("review_id"), seq.alias("seq"))
    batches = ReviewBatches(
        t.spark, scratch_path(t.spark, "batches"), "product_id string, review_id string, seq bigint", timeout_s=24 * 3600
    )
    run_batches(t, staged(t, events, "seq"), lambda df, epoch: batches.process(df, epoch))
    batches.flush()
    return batches.summary().groupBy("product_id", "reason", "size").agg(F.count("*").alias("batches"))


@query(
    "stream_upsert",
    """SELECT DISTINCT CAST(user_id AS VARCHAR) AS product_id, CAST(event_id // 2 AS VARCHAR) AS review_id FROM events WHERE event_id % 9 <> 0
UNION ALL SELECT CAST(user_id AS VARCHAR), NULL FROM events WHERE event_id % 9 = 0""",
)
def stream_upsert(t):
    """Each review arrives, under an id shared by two events, and is stored once; the two
    copies come in different micro-batches. Rows without an id are all kept."""
    i = F.col("event_id")
    e = t.events.select(
        F.col("user_id").cast("string").alias("product_id"),
        F.when(i % 9 != 0, F.floor(i / 2).cast("bigint").cast("string")).alias("review_id"),
        (i % 2).alias("half"),
    )
    store = stores.PredictionStore(t.spark, scratch_path(t.spark, "store"), "product_id string, review_id string", buckets=8)
    path = scratch_path(t.spark, "stream")
    for half in (0, 1):
        e.where(F.col("half") == half).drop("half").write.mode("append").parquet(path)
    stream = ingest.file_stream(t.spark, path, "product_id string, review_id string")
    run_batches(t, stream, lambda df, epoch: store.process(df, epoch))
    return store.read()


def timed_labels(t: Tables) -> DataFrame:
    return t.labels_long().withColumn("ts", F.col("ts").cast("timestamp"))


def labels_stream(t: Tables) -> DataFrame:
    return staged(t, timed_labels(t), "review_id")


@query(
    "stream_summary",
    f"""WITH {LABELS_LONG} SELECT product_id, aspect, count(*) FILTER (label = '1') AS positive,
  count(*) FILTER (label = '-1') AS negative, count(*) FILTER (label = '0') AS neutral FROM labels_long WHERE label <> '2' GROUP BY ALL""",
)
def stream_summary(t):
    summary = windows.running_summary(labels_stream(t), ["product_id", "aspect"])
    store = stores.UpdateStore(
        t.spark, scratch_path(t.spark, "summary"), "product_id bigint, aspect string, positive bigint, negative bigint, neutral bigint", ["product_id", "aspect"]
    )
    run_batches(t, summary, lambda df, epoch: store.process(df, epoch), "update")
    return store.read()


@query(
    "stream_latest_n",
    "SELECT CAST(user_id AS VARCHAR) AS product_id, CAST(event_id AS VARCHAR) AS review_id, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 50",
)
def stream_latest_n(t):
    store = stores.LatestStore(t.spark, scratch_path(t.spark, "latest"), "product_id string, review_id string, seq bigint", ["product_id"], ["seq"], 50)
    run_batches(t, reviews_stream(t), lambda df, epoch: store.process(df, epoch))
    return store.read()


def windows_table(t: Tables, df: DataFrame, keys: str, names: list[str]) -> DataFrame:
    store = stores.UpdateStore(
        t.spark, scratch_path(t.spark, "windows"), f"window_start timestamp, window_end timestamp, {keys}n bigint", ["window_start", "window_end", *names]
    )
    run_batches(t, df, lambda batch, epoch: store.process(batch, epoch), "update")
    return readable(store.read())


def readable(df: DataFrame) -> DataFrame:
    form = "yyyy-MM-dd HH:mm:ss"
    return df.withColumns({c: F.date_format(c, form) for c in ("window_start", "window_end")})


def span(t: Tables) -> int:
    """Seconds from the first to the last event, and one more."""
    return (t.events.agg(F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))).first()[0] or 0) + 1


def whole(t: Tables) -> str:
    """A watermark as long as the data: nothing is late, so the result is that of a batch."""
    return f"{span(t)} seconds"


STAMP = "'%Y-%m-%d %H:%M:%S'"


@query(
    "stream_tumbling",
    f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type AS aspect, count(*) AS n FROM events GROUP BY ALL)
SELECT strftime(s, {STAMP}) AS window_start, strftime(s + INTERVAL 1 HOUR, {STAMP}) AS window_end, aspect, n FROM w""",
)
def stream_tumbling(t):
    counts = windows.windowed_counts(labels_stream(t), "ts", "1 hour", keys=["aspect"], watermark=whole(t))
    return windows_table(t, counts, "aspect string, ", ["aspect"])


@query(
    "stream_sliding",
    f"""WITH e AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k) AS s FROM events, (SELECT unnest(range(4)) AS k)),
w AS (SELECT s, count(*) AS n FROM e GROUP BY ALL)
SELECT strftime(s, {STAMP}) AS window_start, strftime(s + INTERVAL 1 DAY, {STAMP}) AS window_end, n FROM w""",
)
def stream_sliding(t):
    counts = windows.windowed_counts(labels_stream(t), "ts", "1 day", "6 hours", watermark=whole(t))
    return windows_table(t, counts, "", [])


@query(
    "stream_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS product_id, epoch_us(min(ts)) AS window_start, epoch_us(max(ts) + INTERVAL 8 HOUR) AS window_end, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_session(t):
    """Each session is stored once, when it is closed: a last row far ahead in time lets the watermark pass all events."""
    length, labels = span(t), timed_labels(t)
    path, schema, each = written(t, labels, "review_id")
    ahead = labels.agg(*[(F.max(c) + F.make_dt_interval(F.lit(1), F.lit(0), F.lit(0), F.lit(2 * length)) if c == "ts" else F.lit(None).cast(kind)).alias(c) for c, kind in labels.dtypes])
    store = stores.EpochTable(t.spark, scratch_path(t.spark, "sessions"), "window_start timestamp, window_end timestamp, product_id bigint, n bigint")
    checkpoint = scratch_path(t.spark, "checkpoint")
    for last in (False, True):
        if last:
            ahead.write.mode("append").parquet(path)
        stream = ingest.file_stream(t.spark, path, schema, files_per_batch=each)
        sessions = windows.session_counts(stream, "ts", "8 hours", ["product_id"], watermark=f"{length} seconds")
        ingest.drain(sessions.writeStream.outputMode("append").foreachBatch(lambda df, epoch: store.write(df, epoch)), checkpoint)
    return store.read().drop("epoch").withColumns({c: F.unix_micros(c) for c in ("window_start", "window_end")})


@query("stream_dedup", "SELECT DISTINCT event_id // 3 AS review_id FROM events")
def stream_dedup(t):
    stream = labels_stream(t).withColumn("review_id", F.floor(F.col("review_id") / 3).cast("bigint")).select("review_id", "ts")
    kept = windows.dedup_by_id(stream, "ts", ["review_id"], watermark=whole(t)).select("review_id")
    return ingest.drain_to_parquet(kept, scratch_path(t.spark, "unique"), scratch_path(t.spark, "checkpoint"))
