"""Session settings and shared-folder helper."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "reviewlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` overrides them.

    Small shuffle partitions are merged at run time and skewed ones split; for large inputs
    raise the initial number with :func:`size_shuffles`.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def size_shuffles(spark: SparkSession, input_bytes: int, per_task: int = 256 << 20) -> int:
    """Set the initial number of shuffle partitions so that one holds about ``per_task``
    bytes of an input that is shuffled whole (text included); adaptive execution merges what
    turns out small. Returns the number. Streams keep ``spark.sql.shuffle.partitions``."""
    n = min(max(input_bytes // per_task, 200), 200_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    return n


def size_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let an Arrow batch hold about ``most`` bytes, from now on and in the whole session; a smaller bound that was set stays.

    By default a batch holds 10,000 rows, or 64 MB of whole texts. A Python worker and the JVM beside it each
    hold several copies of a batch, and what they once took they mostly keep, whatever step comes next.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= most:
        spark.conf.set(name, str(most))


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder the cluster shares (``spark.checkpoint.dir``).

    Only a local session may fall back to a temporary folder; on a cluster a missing
    setting is an error, because executors could not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="reviewlens-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Spread a single-file table over the cores before CPU-heavy work.

    One file with one row group is one busy task, whatever the number of cores. Tables of
    several files are already split and are left as they are: no shuffle for them.
    """
    if len(df.inputFiles()) != 1:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
