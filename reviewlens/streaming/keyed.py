"""Operators with keyed state and timers.

Each keeps a small, bounded state per key: the open rows of a batch, the newest n rows, the last closed
window. State lives in Spark's state store (RocksDB), is part of the stream's checkpoint and moves with it when an
executor is lost. A micro-batch reads and writes the state of a key once, whatever the number of its rows. Batches and
alerts go through Spark's row form: most keys have a row or two in a micro-batch, for which a pandas table per key, or
per closed batch, costs more than the work.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
AT = "rl_at"  # event or arrival time in microseconds


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which keyed state needs; the session's own
    setting comes back afterwards. A stream holds on to the setting it was started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def ordered(rows: Iterator[pd.DataFrame], columns: Sequence[str], by: Sequence[str]) -> list[tuple]:
    """A key's rows of one micro-batch as tuples in order; missing values are None."""
    table = pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable")[list(columns)]
    return [tuple(None if pd.isna(x) else x for x in r) for r in table.astype(object).itertuples(index=False, name=None)]


def frame(keys: Sequence[str], key: tuple, columns: Sequence[str], rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=list(columns), dtype=object)
    for name, value in zip(reversed(keys), reversed(key)):
        out.insert(0, name, value)
    return out


def sorted_rows(rows: Iterator[Row], columns: Sequence[str], by: Sequence[str]) -> list[tuple]:
    """:func:`ordered` of rows; values that are missing or no numbers come last."""
    place = [columns.index(c) for c in by]
    tuples = [tuple(r[c] for c in columns) for r in rows]
    return sorted(tuples, key=lambda r: [(True, 0) if r[i] is None or r[i] != r[i] else (False, r[i]) for i in place])


class BatchCutter(StatefulProcessor):
    """Batches of ``size`` rows of a key, or fewer once the first of them has waited for the time-out.

    The open rows and the number of the open batch are one value; the timer of a key follows from its first open row."""

    def __init__(self, keys: Sequence[str], columns: Sequence[str], schema: StructType, order: str, size: int, timeout_us: int, by_event: bool):
        self.columns, self.schema, self.order = list(columns), schema, order
        self.size, self.timeout, self.by_event = size, timeout_us, by_event
        self.row = Row(*keys, *columns, "batch", "reason")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", StructType().add("number", LongType()).add("held", ArrayType(self.schema)))

    def _state(self) -> tuple[list[tuple], int]:
        found = self.open.get()
        return ([tuple(r) for r in found[1]], found[0]) if found else ([], 0)

    def _timer(self, held: list[tuple]) -> int | None:
        """Later than every time that the open batch still takes."""
        return (held[0][0] + self.timeout) // 1000 + 1 if held else None

    def _batch(self, key: tuple, held: list[tuple], number: int, reason: str) -> list[Row]:
        return [self.row(*key, *r, number, reason) for r in held]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, number = self._state()
        before = self._timer(held)
        arrived = None if self.by_event else timerValues.getCurrentProcessingTimeInMs() * 1000
        out = []
        for row in sorted_rows(rows, self.columns, [AT, self.order]):
            row = row if self.by_event else (arrived, *row[1:])
            if held and row[0] > held[0][0] + self.timeout:
                out += self._batch(key, held, number, "timeout")
                held, number = [], number + 1
            held.append(row)
            if len(held) == self.size:
                out += self._batch(key, held, number, "full")
                held, number = [], number + 1
        self.open.update((number, held))
        after = self._timer(held)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, number = self._state()
        if held:
            self.open.update((number + 1, []))
            yield from self._batch(key, held, number, "timeout")

    def close(self) -> None:
        pass


def timed_batches(
    stream: DataFrame, keys: Sequence[str], ts: str, order: str, size: int = 20, timeout_s: float = 30, delay: str | None = None
) -> DataFrame:
    """Every row with its ``batch`` (a number per key) and ``reason``: ``full`` or ``timeout``.

    A batch opens with a row of the key and closes with its ``size``-th row or when its time-out has passed, by
    a timer, whether or not another row of the key comes. With ``delay`` time is event time and passes with
    the watermark; without, it is the clock. To spread a key with very many rows, add a salt column to
    ``keys``: each (key, salt) then cuts batches of its own. Rows without ``ts`` need the clock form.
    """
    by_event = delay is not None
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    plain = [c for c in stream.columns if c not in (*keys, ts)]
    timed = stream.withColumn(AT, at if by_event else F.lit(0).cast("bigint")).withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, delay) if by_event else timed
    schema = timed.select(AT, *plain).schema
    result = timed.select(*keys, AT, *plain).schema.add("batch", LongType()).add("reason", StringType())
    cutter = BatchCutter(keys, [AT, *plain], schema, order, size, int(timeout_s * 1_000_000), by_event)
    out = timed.groupBy(*keys).transformWithState(cutter, result, "Append", "EventTime" if by_event else "ProcessingTime")
    return out.withColumn(ts, F.timestamp_micros(AT)).select(*keys, ts, *plain, "batch", "reason")


class LatestKeeper(StatefulProcessor):
    """The newest ``n`` rows of a key, in a list state."""

    def __init__(self, keys: Sequence[str], columns: Sequence[str], schema: StructType, order: Sequence[str], n: int, ttl_ms: int | None):
        self.keys, self.columns, self.schema, self.order, self.n, self.ttl = list(keys), list(columns), schema, list(order), n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getListState("newest", self.schema, ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.newest.get()] if self.newest.exists() else []
        place = [self.columns.index(c) for c in self.order]
        both = held + ordered(rows, self.columns, self.order)
        # nulls are the oldest
        both.sort(key=lambda r: [(r[i] is not None, r[i]) for i in place], reverse=True)
        self.newest.put(both[: self.n])
        yield frame(self.keys, key, ["kept"], [(min(len(both), self.n),)])

    def close(self) -> None:
        pass


def latest_rows(stream: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 50, ttl_ms: int | None = None) -> DataFrame:
    """Keeps the newest ``n`` rows per key as state; a row (key, kept) per key and micro-batch comes out. Read the rows
    themselves with :func:`read_latest`. With ``ttl_ms`` a key that gets no rows for so long is forgotten."""
    columns = [c for c in stream.columns if c not in keys]
    result = stream.select(*keys).schema.add("kept", LongType())
    keeper = LatestKeeper(keys, columns, stream.select(*columns).schema, order, n, ttl_ms)
    return stream.groupBy(*keys).transformWithStateInPandas(keeper, result, "Update", "ProcessingTime" if ttl_ms else "None")


def read_latest(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rows that :func:`latest_rows` holds, from its checkpoint: keys times ``n`` rows at most, however
    many micro-batches there were."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "newest").load()
    return state.select("key.*", "list_element.*")


class TrendWatch(StatefulProcessor):
    """The share of a key's last closed window, to compare the next one with."""

    def __init__(self, keys: Sequence[str], columns: Sequence[str], jump: float):
        self.columns, self.jump = list(columns), jump
        self.row = Row(*keys, *columns, "alert")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "share double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = self.last.get()
        before = found[0] if found else None
        out = []
        for row in sorted_rows(rows, self.columns, [AT]):
            share = row[-1]
            out.append(self.row(*key, *row, before is not None and share - before >= self.jump))
            before = share
        self.last.update((before,))
        yield from out

    def close(self) -> None:
        pass


def trend_alerts(windows: DataFrame, keys: Sequence[str], jump: float = 0.1) -> DataFrame:
    """``windows`` (keys, window_start, n, negatives, negative_share), as closed windows come, with an ``alert`` where
    the share of negatives is at least ``jump`` above that of the key's window before. A key's windows must
    come in order, as an append-mode aggregation hands them out."""
    columns = [AT, "n", "negatives", "negative_share"]
    stamped = windows.withColumn(AT, F.unix_micros("window_start")).select(*keys, *columns)
    result = StructType([*stamped.schema.fields]).add("alert", "boolean")
    out = stamped.groupBy(*keys).transformWithState(TrendWatch(keys, columns, jump), result, "Append", "None")
    return out.select(*keys, F.timestamp_micros(AT).alias("window_start"), "n", "negatives", "negative_share", "alert")
