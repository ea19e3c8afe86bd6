from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from reviewlens.plans.session import scratch_path
from reviewlens.streaming import stores
from reviewlens.streaming.batches import ReviewBatches

ROWS = "product_id string, review_id string, seq bigint"


def reviews(spark, product, start, n):
    return spark.range(start, start + n).select(
        F.lit(product).alias("product_id"), F.col("id").cast("string").alias("review_id"), F.col("id").alias("seq")
    )


def sizes(b):
    return sorted((r["product_id"], r["reason"], r["size"]) for r in b.summary().collect())


def test_full_batches_then_idle(spark):
    b = ReviewBatches(spark, scratch_path(spark, "b"), ROWS)
    b.process(reviews(spark, "p", 0, 45), 0)
    assert sizes(b) == [("p", "full", 20), ("p", "full", 20)]
    b.flush()
    b.flush()
    assert sizes(b) == [("p", "full", 20), ("p", "full", 20), ("p", "idle", 5)]
    b.process(reviews(spark, "p", 45, 20), 1)  # the flushed rows do not come back
    assert sizes(b) == [("p", "full", 20)] * 3 + [("p", "idle", 5)]


def test_timeout_needs_a_new_review(spark):
    b = ReviewBatches(spark, scratch_path(spark, "b"), ROWS)
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    b.process(reviews(spark, "p", 0, 3).unionByName(reviews(spark, "q", 100, 4)), 0, t0)
    b.process(reviews(spark, "p", 3, 1), 1, t0 + timedelta(seconds=31))
    assert sizes(b) == [("p", "timeout", 4)]
    b.process(reviews(spark, "q", 104, 1), 2, t0 + timedelta(seconds=20))
    assert sizes(b) == [("p", "timeout", 4)]
    b.process(reviews(spark, "q", 105, 14), 3, t0 + timedelta(seconds=25))
    assert sizes(b) == [("p", "timeout", 4)]
    b.process(reviews(spark, "q", 119, 1), 4, t0 + timedelta(seconds=40))
    assert sizes(b) == [("p", "timeout", 4), ("q", "full", 20)]


def test_replay_changes_nothing(spark):
    b = ReviewBatches(spark, scratch_path(spark, "b"), ROWS)
    for epoch in (0, 1, 1, 1):
        b.process(reviews(spark, "p", epoch * 15, 15), epoch)
    b.flush()
    assert sizes(b) == [("p", "full", 20), ("p", "idle", 10)]
    assert b.read().select("review_id").distinct().count() == 30


def test_store_is_replay_safe(spark):
    s = stores.PredictionStore(spark, scratch_path(spark, "s"), "product_id string, review_id string", buckets=4)
    batch = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", None)], "product_id string, review_id string")
    for epoch in (0, 1, 1, 2):
        s.process(batch, epoch)
    got = sorted((r[0], r[1] or "") for r in s.read().select("product_id", "review_id").collect())
    assert got == [("p", "1"), ("p", "2"), ("q", ""), ("q", ""), ("q", "")]


def test_batches_lose_no_row_without_key_or_order_or_on_restart(spark):
    path = scratch_path(spark, "b")
    rows = [(None, "a", 1), ("p", "b", None), (None, "c", None), ("p", "d", 1 << 60), *(("p", str(i), i) for i in range(17))]
    ReviewBatches(spark, path, ROWS).process(spark.createDataFrame(rows, ROWS), 0)
    again = ReviewBatches(spark, path, ROWS)  # as after a restart
    again.flush()
    assert sorted(r["review_id"] for r in again.read().collect()) == sorted(r[1] for r in rows)
    assert {(r["product_id"], r["size"]) for r in again.summary().collect()} == {(None, 2), ("p", 19)}


def test_store_takes_maps_and_reads_its_own_buckets(spark):
    schema = "product_id string, review_id string, sentiment map<string,int>"
    path = scratch_path(spark, "s")
    s = stores.PredictionStore(spark, path, schema, buckets=4)
    s.process(spark.createDataFrame([(f"p{i}", str(i), {"a": i}) for i in range(20)], schema), 0)
    s = stores.PredictionStore(spark, path, schema, buckets=4)
    s.process(spark.createDataFrame([("p3", "3", {"a": 9}), ("p3", "33", {"a": 33})], schema), 1)
    assert sorted(r["sentiment"]["a"] for r in s.read().collect()) == [*range(20), 33]
    assert {f.split("bucket=")[1].split("/")[0] for f in s.stored(1, [2]).inputFiles()} >= {"2"}
    assert s.stored(1, [2]).select("bucket").distinct().collect()[0][0] == 2
    plan = s.stored(1, [2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_latest_store(spark):
    s = stores.LatestStore(spark, scratch_path(spark, "l"), ROWS, ["product_id"], ["seq"], 3)
    for epoch in range(3):
        s.process(reviews(spark, "p", epoch * 5, 5), epoch)
    assert sorted(r["seq"] for r in s.read().collect()) == [12, 13, 14]
    s.process(reviews(spark, "p", 15, 1), 3)
    assert sorted(r["seq"] for r in s.read().collect()) == [13, 14, 15]


def test_update_store(spark):
    s = stores.UpdateStore(spark, scratch_path(spark, "u"), "k string, n bigint", ["k"])
    s.process(spark.createDataFrame([("a", 1), ("b", 5)], "k string, n bigint"), 0)
    s.process(spark.createDataFrame([("a", 2)], "k string, n bigint"), 1)
    assert sorted(map(tuple, s.read().collect())) == [("a", 2), ("b", 5)]
    s.process(spark.createDataFrame([("b", 6)], "k string, n bigint"), 2)
    assert sorted(map(tuple, s.read().collect())) == [("a", 2), ("b", 6)]


def test_shuffle_size(spark):
    from reviewlens.plans.session import size_shuffles

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        assert size_shuffles(spark, 10) == 200
        assert size_shuffles(spark, 1 << 40) == 4096
        assert spark.conf.get(key) == "4096"
    finally:
        spark.conf.unset(key)


def test_micro_batches_use_all_cores(spark, monkeypatch):
    """The number of micro-batches does not grow with the number of files as long as there are cores for them."""
    from conftest import SMALL

    from reviewlens.plans import q_stream
    from reviewlens.plans.views import Tables

    assert [q_stream.files_per_batch(n, 12) for n in (4, 7, 24, 144, 1000)] == [1, 1, 6, 12, 12]
    monkeypatch.setattr(q_stream, "ROWS_PER_FILE", 30)  # 1,000 events: 33 files
    epochs = []
    q_stream.run_batches(Tables(spark, SMALL), q_stream.reviews_stream(Tables(spark, SMALL)), lambda df, epoch: epochs.append(df.count()))
    assert sum(epochs) == 1000 and len(epochs) == 5


def test_sessions_are_stored_once(spark, monkeypatch):
    """Not all of them again in every micro-batch."""
    from conftest import SMALL

    from reviewlens.plans.catalogue import QUERIES

    stored, write = [], stores.EpochTable.write

    def counted(self, df, epoch, partition=None):
        stored.append(df.count())
        write(self, df, epoch, partition)

    monkeypatch.setattr(stores.EpochTable, "write", counted)
    sessions = QUERIES["stream_session"](spark, SMALL)
    assert sum(stored) == sessions.count() and sessions.agg(F.sum("n")).first()[0] == 1000
