"""Queries on keyed state, timers, stream joins and chained stateful steps.

Each arrives in steps: a part of the table is written to the stream's folder and drained, with one checkpoint
for all steps, so every step is also a restart. A last step holds nothing but rows far ahead in time, which
let the watermark pass everything before them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.labels import ASPECTS
from reviewlens.operators import lexicon as lx
from reviewlens.plans.q_label import columns, simple_labels
from reviewlens.plans.q_text import WS_CLASS, rx, strip
from reviewlens.plans.q_text import T as text_functions
from reviewlens.plans.registry import query
from reviewlens.plans.session import scratch_path
from reviewlens.plans.views import LABELS_LONG, REVIEWS, Tables
from reviewlens.streaming import chain, ingest, joins, keyed, windows

STEPS = 4
ALL_FILES = 1 << 20
STAMP = "yyyy-MM-dd HH:mm:ss"


class Arrival:
    """A folder that a table arrives in by steps, and the streams that read it."""

    def __init__(self, t: Tables):
        self.t, self.path = t, scratch_path(t.spark, "arrival")
        self.schema = ""

    def stream(self) -> DataFrame:
        return ingest.file_stream(self.t.spark, self.path, self.schema, files_per_batch=ALL_FILES)

    def add(self, part: DataFrame) -> None:
        self.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields)
        part.write.mode("append").parquet(self.path)


def per_step(t: Tables) -> int:
    """Events per step, rounded up."""
    return (t.events.agg(F.max("event_id")).first()[0] or 0) // STEPS + 1


STEP_SQL = f"event_id // ((SELECT max(event_id) FROM events) // {STEPS} + 1)"


def far(t: Tables, days: int = 60) -> DataFrame:
    """One row with a time (ts) that lies behind all events."""
    return t.events.agg((F.max("ts").cast("timestamp") + F.make_dt_interval(F.lit(days))).alias("ts"))


def events_by_step(t: Tables) -> Iterable[DataFrame]:
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    each = per_step(t)
    for k in range(STEPS):
        yield e.where((F.col("event_id") >= k * each) & (F.col("event_id") < (k + 1) * each))


def drained(t: Tables, parts: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``build`` appends to a table while ``parts`` arrive one after the other."""
    arrival, out, checkpoint = Arrival(t), scratch_path(t.spark, "appended"), scratch_path(t.spark, "checkpoint")
    with keyed.keyed_state(t.spark):
        for part in parts:
            arrival.add(part)
            result = ingest.drain_to_parquet(build(arrival.stream()), out, checkpoint)
    return result


# ------------------------------------------------------------------------------ timers

BATCH, WAIT_DAYS = 5, 2


@query(
    "stream_batches_timed",
    f"""WITH RECURSIVE e AS (SELECT CASE WHEN event_id % 97 <> 0 THEN CAST(user_id AS VARCHAR) END AS product_id, event_id % 2 AS salt, event_id AS seq, ts FROM events),
n AS (SELECT *, row_number() OVER k AS rn, count(*) OVER (PARTITION BY product_id, salt) AS total FROM e WINDOW k AS (PARTITION BY product_id, salt ORDER BY ts, seq)),
s AS (SELECT *, rn - 1 + count(*) OVER (PARTITION BY product_id, salt ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL {WAIT_DAYS} DAY FOLLOWING) AS last_in_time FROM n),
b AS (SELECT coalesce(product_id, '') AS p, salt, rn, least(rn + {BATCH - 1}, last_in_time) AS stop, total FROM s),
r AS (SELECT p, salt, rn, stop, 0 AS batch FROM b WHERE rn = 1
  UNION ALL SELECT b.p, b.salt, b.rn, b.stop, r.batch + 1 FROM r JOIN b ON b.p = r.p AND b.salt = r.salt AND b.rn = r.stop + 1)
SELECT nullif(p, '') AS product_id, salt, CAST(batch AS BIGINT) AS batch, CASE WHEN stop - rn + 1 = {BATCH} THEN 'full' ELSE 'timeout' END AS reason,
  CAST(stop - rn + 1 AS BIGINT) AS size FROM r""",
)
def stream_batches_timed(t):
    """Count-or-timeout batches closed by timers on event time; products are spread over two salts."""

    def shaped(df: DataFrame) -> DataFrame:
        i = F.col("event_id")
        return df.select(F.when(i % 97 != 0, F.col("user_id").cast("string")).alias("product_id"), (i % 2).alias("salt"), i.alias("seq"), "ts")

    ahead = far(t).select(F.lit("ahead").alias("product_id"), F.lit(0).cast("bigint").alias("salt"), F.lit(-1).cast("bigint").alias("seq"), "ts")
    parts = [*map(shaped, events_by_step(t)), ahead]
    rows = drained(t, parts, lambda s: keyed.timed_batches(s, ["product_id", "salt"], "ts", "seq", BATCH, WAIT_DAYS * 86400, delay="1 hour"))
    return rows.groupBy("product_id", "salt", "batch", "reason").agg(F.count("*").alias("size"))


@query(
    "stream_latest_state",
    "SELECT CAST(user_id AS VARCHAR) AS product_id, CAST(event_id AS VARCHAR) AS review_id, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20",
)
def stream_latest_state(t):
    """The newest twenty reviews per product, held as state and read from the checkpoint."""
    arrival, checkpoint = Arrival(t), scratch_path(t.spark, "checkpoint")
    with keyed.keyed_state(t.spark):
        for part in events_by_step(t):
            arrival.add(part.select(F.col("user_id").cast("string").alias("product_id"), F.col("event_id").cast("string").alias("review_id"), F.col("event_id").alias("seq")))
            kept = keyed.latest_rows(arrival.stream(), ["product_id"], ["seq"], 20)
            ingest.drain(kept.writeStream.format("noop").outputMode("update"), checkpoint)
    return keyed.read_latest(t.spark, checkpoint)


@query(
    "stream_alerts",
    f"""WITH {LABELS_LONG}, w AS (SELECT product_id, time_bucket(INTERVAL 1 DAY, ts) AS d, count(*) AS n,
  count(*) FILTER (label = '-1') AS negatives FROM labels_long WHERE label IN ('1', '0', '-1') GROUP BY ALL),
s AS (SELECT *, negatives / n AS share FROM w)
SELECT product_id, strftime(d, '%Y-%m-%d') AS day, n, negatives, round(share, 6) AS negative_share,
  coalesce(share - lag(share) OVER (PARTITION BY product_id ORDER BY d) >= 0.1, false) AS alert FROM s""",
)
def stream_alerts(t):
    """Daily windows of a stream, each compared with the product's window before it."""
    each, labels = per_step(t), t.labels_long().withColumn("ts", F.col("ts").cast("timestamp"))
    i = F.col("review_id")
    parts = [labels.where((i >= k * each) & (i < (k + 1) * each)) for k in range(STEPS)]
    parts.append(far(t).select(F.lit(-1).cast("bigint").alias("review_id"), F.lit(-1).cast("bigint").alias("product_id"), F.lit("").alias("aspect"), F.lit("0").alias("label"), "ts"))

    def build(stream: DataFrame) -> DataFrame:
        counted = (
            windows.event_time(stream, "ts", "1 hour").where(F.col("label").isin("1", "0", "-1"))
            .groupBy("product_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == "-1").alias("negatives"))
        )
        shares = counted.select("product_id", F.col("w.start").alias("window_start"), "n", "negatives", (F.col("negatives") / F.col("n")).alias("negative_share"))
        return keyed.trend_alerts(shares, ["product_id"])

    out = drained(t, parts, build)
    return out.select("product_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "negatives", F.round("negative_share", 6).alias("negative_share"), "alert")


# ------------------------------------------------------------------------ stream joins


@query(
    "stream_completeness",
    """WITH e AS (SELECT user_id AS product_id, time_bucket(INTERVAL 1 DAY, ts) AS d, event_id % 7 <> 0 AND event_id % 5 <= 3 AS done FROM events),
c AS (SELECT product_id, d, count(*) AS expected, count(*) FILTER (done) AS processed FROM e GROUP BY ALL)
SELECT product_id, strftime(d, '%Y-%m-%d %H:%M:%S') AS window_start, expected, processed,
  CASE WHEN processed >= expected THEN 'complete' WHEN processed > 0 THEN 'partial' ELSE 'missing' END AS status FROM c""",
)
def stream_completeness(t):
    """Reviews sent and reviews processed, which meet within three hours. Some are never processed, some too late,
    some twice."""
    i = F.col("event_id")
    sent, done = Arrival(t), Arrival(t)
    out, checkpoint = scratch_path(t.spark, "completeness"), scratch_path(t.spark, "checkpoint")
    ahead = far(t).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"), "ts")
    for part in [*events_by_step(t), ahead]:
        sent.add(part.select(F.col("user_id").alias("product_id"), i.alias("review_id"), F.col("ts").alias("expected_at")))
        hours = F.when(i >= 0, i % 5).otherwise(0)
        answer = part.where(i % 7 != 0).select(i.alias("review_id"), (F.col("ts") + F.make_dt_interval(F.lit(0), hours.cast("int"))).alias("processed_at"))
        done.add(answer.unionByName(answer.where("review_id % 11 = 0")))
        joined = joins.stream_completeness(sent.stream(), done.stream(), "product_id", "review_id", "3 HOURS", "8 hours")
        result = ingest.drain_to_parquet(joined, out, checkpoint)
    return result.withColumn("window_start", F.date_format("window_start", STAMP))


@query(
    "stream_late_split",
    f"""WITH a AS (SELECT event_id, ts, CASE WHEN event_id % 31 <> 0 THEN ts END AS stamp, least({STEP_SQL} + CASE WHEN event_id % 50 < 3 THEN event_id % 50 ELSE 0 END, {STEPS - 1}) AS step FROM events),
h AS (SELECT step, max(stamp) AS high FROM a GROUP BY step),
w AS (SELECT step, max(high) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 6 HOUR AS mark FROM h),
f AS (SELECT a.*, stamp IS NULL OR coalesce(stamp < mark, false) AS late FROM a JOIN w USING (step))
SELECT strftime(time_bucket(INTERVAL 1 DAY, stamp), '%Y-%m-%d') AS day, count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late FROM f GROUP BY ALL""",
)
def stream_late_split(t):
    """Some rows arrive one or two steps after their time, some have no time: those behind the watermark are stored
    apart, and per day both kinds add up to all rows."""
    i, each = F.col("event_id"), per_step(t)
    held_back = F.when(i % 50 < 3, i % 50).otherwise(0)
    e = t.events.select("event_id", F.when(i % 31 != 0, F.col("ts").cast("timestamp")).alias("ts"), F.least(F.floor(i / each) + held_back, F.lit(STEPS - 1)).alias("step"))
    split = joins.LateSplit(t.spark, scratch_path(t.spark, "late-split"), "event_id bigint, ts timestamp", "ts", "6 HOURS")
    arrival, checkpoint = Arrival(t), scratch_path(t.spark, "checkpoint")
    for k in range(STEPS):
        arrival.add(e.where(F.col("step") == k).drop("step"))
        ingest.drain(arrival.stream().writeStream.foreachBatch(lambda df, epoch: split.process(df, epoch)), checkpoint)
    both = split.on_time.read().withColumn("late", F.lit(False)).unionByName(split.late.read().withColumn("late", F.lit(True)))
    return both.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late"))


# --------------------------------------------------------------------- the whole chain

CLEANED = f"coalesce({strip(rx(rx('lower(content)', text_functions.TAG, ''), WS_CLASS + '+', ' '))}, '')"
AT_SQL = "(SELECT min(ts) FROM events) + to_minutes(review_id % 40000)"
CHAIN = f"""WITH {REVIEWS}, l AS (SELECT product_id, {AT_SQL} AS stamp, lower({CLEANED}) AS x FROM reviews),
labelled AS (SELECT coalesce(product_id, 'unknown') AS product_id, strftime(time_bucket(INTERVAL 1 DAY, stamp), '%Y-%m-%d') AS day, {columns(simple_labels('x', lx.SIMPLE))} FROM l),
long AS (SELECT * FROM (UNPIVOT labelled ON {', '.join(chr(34) + a + chr(34) for a in ASPECTS)} INTO NAME aspect VALUE label))
SELECT product_id, day, aspect, count(*) FILTER (label = '1') AS positive, count(*) FILTER (label = '-1') AS negative, count(*) FILTER (label = '0') AS neutral
FROM long WHERE label IN ('1', '-1', '0') GROUP BY ALL"""


@query("stream_pipeline", CHAIN)
def stream_pipeline(t):
    """Envelopes of all reviews, a tenth of them sent twice, decoded, deduplicated, cleaned, labelled and summed up per
    product, day and aspect in one append query of two stateful steps."""
    first = F.lit(t.events.agg(F.min("ts").cast("timestamp")).first()[0])
    r = t.reviews()
    at = first + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("review_id") % 40000).cast("int"))
    fields = F.struct("product_id", F.col("content").alias("review_content"), "rating", F.col("review_id").cast("string").alias("review_id"))
    sent = r.select(F.col("product_id").alias("key"), F.to_json(fields).alias("value"), F.lit("reviews").alias("topic"), F.lit(0).alias("partition"), F.col("review_id").alias("offset"), at.alias("timestamp"))
    again = sent.where("offset % 10 = 0").withColumn("timestamp", F.col("timestamp") + F.make_dt_interval(F.lit(0), F.lit(1)))
    everything = sent.unionByName(again)
    minutes = 40060
    step = F.floor((F.unix_seconds("timestamp") - F.unix_seconds(first)) / (minutes * 60 / STEPS))
    stepped = everything.withColumn("step", step).persist()
    ahead = far(t, 400).select(F.lit("").alias("key"), F.lit('{"review_id": "ahead"}').alias("value"), F.lit("reviews").alias("topic"), F.lit(0).alias("partition"), F.lit(-1).cast("bigint").alias("offset"), F.col("ts").alias("timestamp"))
    parts = [*(stepped.where(F.col("step") == k).drop("step") for k in range(STEPS + 1)), ahead]
    out = drained(t, parts, lambda s: chain.windowed_summary(chain.labelled_messages(s, "2 hours"), ASPECTS, "1 day"))
    stepped.unpersist()
    each = out.select("product_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), F.explode("summary").alias("aspect", "c"))
    return each.select("product_id", "day", "aspect", "c.positive", "c.negative", "c.neutral")


PUBLISHED = {0: {"positive": ["nhanh", "tốt"], "negative": ["view", "error"]}, 2: {"positive": ["click", "signup"], "negative": ["nhanh"]}}


def polarity_sql(version: int, value: str) -> str:
    lead = " - ".join("(" + " + ".join(f"contains({value}, '{k}')::INT" for k in PUBLISHED[version][p]) + ")" for p in ("positive", "negative"))
    return f"CASE WHEN {lead} > 0 THEN 'POSITIVE' WHEN {lead} < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END"


@query(
    "stream_model_switch",
    f"""WITH e AS (SELECT event_id, {STEP_SQL} AS step, event_type || ' giao hàng nhanh' AS x FROM events)
SELECT event_id, CASE WHEN step < 2 THEN 0 ELSE 2 END AS version, CASE WHEN step < 2 THEN {polarity_sql(0, 'x')} ELSE {polarity_sql(2, 'x')} END AS sentiment FROM e""",
)
def stream_model_switch(t):
    """A second model is published between micro-batches; rows after that carry its version."""
    models = chain.ModelRecords(t.spark, scratch_path(t.spark, "models"))
    scorer = chain.SwitchingScorer(t.spark, scratch_path(t.spark, "switch"), "event_id bigint, content string", "content", models)
    arrival, checkpoint = Arrival(t), scratch_path(t.spark, "checkpoint")
    for k, part in enumerate(events_by_step(t)):
        if k in PUBLISHED:
            rows = [(p, w) for p, words in PUBLISHED[k].items() for w in words]
            models.publish(t.spark.createDataFrame(rows, "polarity string, keyword string"), k)
        arrival.add(part.select("event_id", F.concat("event_type", F.lit(" giao hàng nhanh")).alias("content")))
        ingest.drain(arrival.stream().writeStream.foreachBatch(lambda df, epoch: scorer.process(df, epoch)), checkpoint)
    return scorer.scored.read().select("event_id", "version", "sentiment")


@query(
    "throughput",
    f"""WITH s AS (SELECT {STEP_SQL} AS batch, count(*) AS rows FROM events GROUP BY ALL)
SELECT batch, rows, CAST(sum(rows) OVER (ORDER BY batch) AS BIGINT) AS total, true AS timed FROM s""",
)
def throughput(t):
    """Rows so far and seconds of every micro-batch, as observed while labelling."""
    watch = chain.Throughput()
    arrival, checkpoint = Arrival(t), scratch_path(t.spark, "checkpoint")
    t.spark.streams.addListener(watch)
    for part in events_by_step(t):
        arrival.add(part.select("event_id", "event_type"))
        labelled = watch.watched(arrival.stream()).withColumn("sentiment", chain.doc_polarity("event_type"))
        ingest.drain(labelled.writeStream.format("noop"), checkpoint)
    watch.settled(STEPS)
    t.spark.streams.removeListener(watch)
    return watch.table(t.spark).select("batch", "rows", "total", ((F.col("seconds") > 0) & (F.col("rows_per_second") > 0)).alias("timed"))
