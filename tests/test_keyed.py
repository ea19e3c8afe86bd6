"""Keyed state, timers, stream joins and chained steps: what happens between micro-batches."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reviewlens.plans.session import scratch_path
from reviewlens.streaming import chain, ingest, joins, keyed

T0 = datetime(2024, 1, 1)
ROWS = "product_id string, seq bigint, ts timestamp"


class Folder:
    def __init__(self, spark, schema):
        self.spark, self.schema, self.path = spark, schema, scratch_path(spark, "t")

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return ingest.file_stream(self.spark, self.path, self.schema, files_per_batch=1000)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def closed(df):
    rows = df.groupBy("product_id", "batch", "reason").agg(F.array_sort(F.collect_list("seq")).alias("s")).collect()
    return sorted((r.product_id or "", r.batch, r.reason, r.s) for r in rows)


@pytest.fixture
def batches(spark):
    folder, out, checkpoint = Folder(spark, ROWS), scratch_path(spark, "o"), scratch_path(spark, "c")

    def step(rows):
        folder.add(rows)
        with keyed.keyed_state(spark):
            return closed(ingest.drain_to_parquet(keyed.timed_batches(folder.stream(), ["product_id"], "ts", "seq", 3, 30, delay="0 seconds"), out, checkpoint))

    return step


def test_batch_closes_without_another_review(batches):
    """Each step is a restart from the checkpoint: open rows are neither lost nor doubled."""
    assert batches([("a", 1, at(0)), ("a", 2, at(1)), (None, 9, at(1))]) == []
    assert batches([("b", 3, at(20))]) == []
    # time passes through another product's review: both open batches close
    assert batches([("b", 4, at(40))]) == [("", 0, "timeout", [9]), ("a", 0, "timeout", [1, 2])]
    assert batches([("a", 5, at(41)), ("a", 6, at(41)), ("a", 7, at(42)), ("a", 8, at(43))])[1:] == [("a", 0, "timeout", [1, 2]), ("a", 1, "full", [5, 6, 7])]
    got = batches([("z", 10, at(500))])
    assert got[1:] == [("a", 0, "timeout", [1, 2]), ("a", 1, "full", [5, 6, 7]), ("a", 2, "timeout", [8]), ("b", 0, "timeout", [3, 4])]


def test_late_review_opens_a_new_batch(batches):
    """Within one micro-batch too a review that comes after the time-out does not join."""
    batches([("a", 1, at(0)), ("a", 2, at(31)), ("a", 3, at(61))])
    assert batches([("z", 4, at(900))]) == [("a", 0, "timeout", [1]), ("a", 1, "timeout", [2, 3])]


def test_clock_timer_fires_by_itself(spark):
    folder, out = Folder(spark, ROWS), scratch_path(spark, "o")
    folder.add([("a", 1, T0), ("a", 2, None)])
    with keyed.keyed_state(spark):
        rows = keyed.timed_batches(folder.stream(), ["product_id"], "ts", "seq", 20, 2)
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "c")).trigger(processingTime="1 second").start()
    try:
        stop = time.monotonic() + 60
        while time.monotonic() < stop:
            try:
                got = closed(spark.read.schema(rows.schema).parquet(out))
            except Exception:
                got = []
            if got:
                break
            time.sleep(0.5)
        assert got == [("a", 0, "timeout", [1, 2])]
    finally:
        query.stop()


def test_latest_state_is_bounded(spark):
    folder, checkpoint = Folder(spark, "k string, seq bigint"), scratch_path(spark, "c")
    sizes = []
    for k in range(3):
        folder.add([(key, k * 10 + i) for key in ("a", None) for i in range(10)] + [("b", None)])
        with keyed.keyed_state(spark):
            ingest.drain(keyed.latest_rows(folder.stream(), ["k"], ["seq"], 4).writeStream.format("noop").outputMode("update"), checkpoint)
        rows = keyed.read_latest(spark, checkpoint).collect()
        sizes.append(len(rows))
        newest = [k * 10 + i for i in (6, 7, 8, 9)]
        assert sorted(r.seq for r in rows if r.k == "a") == newest and sorted(r.seq for r in rows if r.k is None) == newest
        assert [r.seq for r in rows if r.k == "b"] == [None] * (k + 1)
    assert sizes == [9, 10, 11]


def test_completeness_waits_then_reports(spark):
    sent, done = Folder(spark, "p string, id bigint, expected_at timestamp"), Folder(spark, "id bigint, processed_at timestamp")
    out, checkpoint = scratch_path(spark, "o"), scratch_path(spark, "c")

    def step(expected, processed):
        sent.add(expected)
        done.add(processed)
        df = joins.stream_completeness(sent.stream(), done.stream(), "p", "id", "60 SECONDS", "0 seconds", "1 minute")
        rows = ingest.drain_to_parquet(df, out, checkpoint).collect()
        return sorted((r.p, r.expected, r.processed, r.status) for r in rows)

    assert step([("a", 1, at(0)), ("a", 2, at(1)), ("b", 3, at(2)), ("c", 4, at(3))], [(1, at(5)), (1, at(6))]) == []
    # 2 is processed too late, 3 is never processed
    assert step([("z", 9, at(100))], [(4, at(63)), (2, at(100))]) == []
    assert step([("z", 10, at(1000))], [(77, at(1000))])[:3] == [("a", 2, 1, "partial"), ("b", 1, 0, "missing"), ("c", 1, 1, "complete")]


def test_late_split_repeats_itself(spark):
    split = joins.LateSplit(spark, scratch_path(spark, "l"), "id bigint, ts timestamp", "ts", "10 SECONDS")
    batch = lambda *rows: spark.createDataFrame(rows, "id bigint, ts timestamp")
    split.process(batch((1, at(0)), (2, at(100)), (3, None)), 0)
    for _ in range(2):  # run again after a failure
        split.process(batch((4, at(89)), (5, at(90)), (6, at(500))), 1)
    split.process(batch((7, at(101))), 2)
    assert sorted(r.id for r in split.late.read().collect()) == [3, 4, 7]
    assert sorted(r.id for r in split.on_time.read().collect()) == [1, 2, 5, 6]


def test_micro_batch_keeps_its_model(spark):
    models = chain.ModelRecords(spark, scratch_path(spark, "m"))
    scorer = chain.SwitchingScorer(spark, scratch_path(spark, "s"), "t string", "t", models)
    batch = spark.createDataFrame([("tốt",), (None,)], "t string")
    words = lambda *rows: spark.createDataFrame(rows, "polarity string, keyword string")
    scorer.process(batch, 0)
    models.publish(words(("positive", "tốt")), 1)
    scorer.process(batch, 1)
    models.publish(words(("negative", "tốt")), 2)
    scorer.process(batch, 1)  # run again: still version 1
    scorer.process(batch, 2)
    got = sorted((r.version or 0, r.t or "", r.sentiment or "") for r in scorer.scored.read().collect())
    assert got == [(0, "", ""), (0, "tốt", ""), (1, "", "NEUTRAL"), (1, "tốt", "POSITIVE"), (2, "", "NEUTRAL"), (2, "tốt", "NEGATIVE")]


def test_chain_keeps_reviews_without_id(spark):
    folder = Folder(spark, ingest.ENVELOPE)
    value = '{"product_id": "p", "review_content": "<b>Đẹp</b>  quá"%s}'
    rows = [("k", value % extra, "t", 0, i, at(i)) for i, extra in enumerate(["", "", ', "review_id": "x"', ', "review_id": "x"'])]
    folder.add(rows)
    store = scratch_path(spark, "o")
    labelled = chain.labelled_messages(folder.stream(), "1 hour")
    kept = ingest.drain_to_parquet(chain.predictions(labelled, ["Chất lượng sản phẩm", "Vận chuyển"]), store, scratch_path(spark, "c"))
    got = kept.select("review_id", "sentiment").collect()
    assert len(got) == 3 and sum(r.review_id == "x" for r in got) == 1
    assert all(r.sentiment == {"Chất lượng sản phẩm": "1"} for r in got)
