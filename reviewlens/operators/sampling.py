"""Samples, limits, splits and file batches.

Random choices hash an id, so they can be repeated and need no global shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlens.operators.dedup import identity_key
from reviewlens.plans.session import scratch_path

# Default sample size per rating.
REVIEWS_PER_RATING = {1: 30, 2: 30, 3: 30, 4: 30, 5: 30}
DEFAULT_PER_RATING = 50
SPARK_CUTS = 1000  # Spark's own default bound of groups cut before a shuffle
SLICES = 64


def cut_groups(df: DataFrame, keys: Sequence[str], by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Rows that may be among the first ``n`` of their group. Spark cuts groups before the shuffle up to ``SPARK_CUTS`` rows;
    beyond that each group is cut in slices first, so that a huge one is sorted by many tasks and only ``n`` rows of a
    slice meet afterwards. Slices are made by the columns ``by``, which tell a group's rows apart."""
    if n <= SPARK_CUTS:
        return df
    slices = [*keys, F.pmod(F.xxhash64(*by), F.lit(SLICES))]
    ranked = df.withColumn("__rl_rank", F.row_number().over(W.partitionBy(*slices).orderBy(*order)))
    return ranked.where(F.col("__rl_rank") <= n).drop("__rl_rank")


def balanced_sample(
    df: DataFrame,
    product: str,
    rating: str,
    order: str,
    per_rating: Mapping[int, int] = REVIEWS_PER_RATING,
    default: int = DEFAULT_PER_RATING,
) -> DataFrame:
    """The first n rows of each product and rating.

    The constant upper bound beside the per-rating one lets the groups be cut before they
    meet, so a huge group is never in one task (:func:`cut_groups`).
    """
    wanted = F.lit(default)
    for r, n in per_rating.items():
        wanted = F.when(F.col(rating) == r, n).otherwise(wanted)
    most = max([default, *per_rating.values()])
    rank = F.row_number().over(W.partitionBy(product, rating).orderBy(order))
    return (
        cut_groups(df, [product, rating], [order], [F.col(order)], most)
        .withColumn("__rl_rank", rank)
        .where(F.col("__rl_rank") <= most)
        .where(F.col("__rl_rank") <= wanted)
        .drop("__rl_rank")
    )


def balanced_unique(
    df: DataFrame, product: str, rating: str, order: str, ids: Sequence[str], content: str, per_rating: Mapping[int, int] = REVIEWS_PER_RATING, default: int = DEFAULT_PER_RATING
) -> DataFrame:
    """:func:`balanced_sample`, then each review of a product once: ratings are gone through from the lowest, and a
    review that was seen (first usable id of ``ids``, else the content) is left out. As in a crawl, what is left out
    is not made up for. The pass sees the sample only, a bounded number of rows per product."""
    sample = balanced_sample(df, product, rating, order, per_rating, default)
    seen = W.partitionBy(product, identity_key(ids, content)).orderBy(F.col(rating), F.col(order))
    return sample.withColumn("__rl_rank", F.row_number().over(seen)).where(F.col("__rl_rank") == 1).drop("__rl_rank")


def hash_unit(key: Column | str, seed: int = 42) -> Column:
    """Eight hex digits of the md5 of seed and id: a repeatable random key."""
    k = F.col(key) if isinstance(key, str) else key
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), k.cast("string"))), 1, 8)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in random but repeatable order (distributed top-k)."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def head_limit(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def latest_n(df: DataFrame, order: Sequence[str], n: int = 50, keys: Sequence[str] = ()) -> DataFrame:
    """The ``n`` newest rows, overall or per key.

    Spark cuts the groups before the shuffle up to ``SPARK_CUTS`` rows a group. For more, each
    key is first cut in slices, so a key with a third of all rows is sorted by many tasks and
    only ``n`` rows of each slice meet; the rows are the same either way.
    """
    newest = [F.col(o).desc() for o in order]
    if not keys:
        return df.orderBy(*newest).limit(n)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*newest))
    return cut_groups(df, keys, order, newest, n).withColumn("__rl_rank", rank).where(F.col("__rl_rank") <= n).drop("__rl_rank")


def assign_split(df: DataFrame, key: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``split`` = train / test in the given ratio, row by row."""
    border = format(int(train * 2**32), "08x")
    return df.withColumn("split", F.when(hash_unit(key, seed) < border, "train").otherwise("test"))


def assign_fold(df: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..folds-1, row by row; fold sizes are equal only on average."""
    return df.withColumn("fold", F.pmod(F.conv(hash_unit(key, seed), 16, 10).cast("bigint"), F.lit(folds)).cast("int"))


def file_batches(df: DataFrame, file: str, size: int = 10) -> DataFrame:
    """Number the sorted distinct files in groups of ``size`` and add ``batch`` to the rows; rows without a
    name are one file, the first.

    The distinct names are range-partitioned and numbered within their partition; only one count per
    partition is gathered. The numbers are written, so that a lost executor cannot move the ranges.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "file-numbers")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within the partition
    names = df.select(F.col(file).alias("__rl_file")).distinct().repartitionByRange("__rl_file").sortWithinPartitions("__rl_file")
    names.select("__rl_file", F.spark_partition_id().alias("__rl_part"), place.alias("__rl_at")).write.parquet(path)
    placed = spark.read.parquet(path)
    before, total = [], 0
    for part, n in sorted(map(tuple, placed.groupBy("__rl_part").count().collect())):
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "__rl_part int, __rl_before bigint")
    batch = F.floor((F.col("__rl_before") + F.col("__rl_at")) / size).cast("int") + 1
    numbered = placed.join(offsets, "__rl_part").select("__rl_file", batch.alias("batch"))
    return df.join(numbered, F.col(file).eqNullSafe(F.col("__rl_file"))).drop("__rl_file")
