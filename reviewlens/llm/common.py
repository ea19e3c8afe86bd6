"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.plans.session import scratch_path


MEMORIES: list = []  # cached functions by which a Python worker remembers vocabularies and the words it has met


def handed_back() -> None:
    """Lets a Python worker forget vocabularies and give freed memory back to the system, which its allocators else keep as
    long as the worker lives: beside the JVM's heap, of use to no later step."""
    for f in MEMORIES:
        f.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that needs no vocabulary, with :func:`handed_back` before and after it."""

    def run_lean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handed_back()
        yield from run(batches)
        handed_back()

    return run_lean


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the folder that all executors share and read again: cuts the
    lineage, so a lost executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes tables of :func:`saved` that later steps have superseded, and lets Spark's cleaner delete the shuffle files of
    finished steps, which it does when the driver's JVM collects garbage. No plan may read them any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(conf).delete(path, True)
    if tables:
        jvm.System.gc()


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def carried(df: DataFrame, keep: tuple[str, ...]) -> str:
    """Schema text of doc_id and of the columns that a batch function hands on."""
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))


def field_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or as ``column.field`` the field of a struct column without null structs."""
    column, _, field = name.partition(".")
    return batch[column].field(field) if field else batch[column]


def beside(keep: tuple[str, ...], text: str) -> tuple[list[Column], str]:
    """The text column to send beside those of ``keep``, and its name there; none if it is a field of one of them, so that no text is sent twice."""
    return ([], text) if text.partition(".")[0] in keep else ([text_of(text).alias("text")], "text")


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """The texts of a batch; null is empty."""
    return [x or "" for x in column.to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
