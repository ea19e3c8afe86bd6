"""Duplicate removal, merging and idempotent appends.

"Keep first / last" is a row number cut at 1. Spark pushes that cut below the shuffle
(WindowGroupLimit), so each map task sends at most one row per key: a key that holds a
third of all rows costs one row per task, not a third of the data. Every operator wants an
explicit, unique order column, because file order means nothing after a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlens.functions.text import signature, strip_ws


def _one_per_key(df: DataFrame, key: Column, order: Column) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("__rl_key").orderBy(order))
    return (
        df.withColumn("__rl_key", key)
        .withColumn("__rl_rank", rank)
        .where(F.col("__rl_rank") == 1)
        .drop("__rl_key", "__rl_rank")
    )


def digest(c: Column) -> Column:
    """Fixed-size stand-in for a long text key (SHA-256)."""
    return F.sha2(c, 256)


def fuzzy_dedup(df: DataFrame, content: str, order: str) -> DataFrame:
    """First row per fuzzy signature, then without blank content. Blank and marks-only rows
    share the empty signature, so a blank first row also removes later marks-only rows."""
    trimmed = df.withColumn(content, strip_ws(F.coalesce(F.col(content), F.lit(""))))
    kept = _one_per_key(trimmed, digest(signature(content)), F.col(order).asc())
    return kept.where(F.col(content) != "")


def fuzzy_dedup_stats(df: DataFrame, content: str, order: str) -> DataFrame:
    """Rows before, removed and after, from one small aggregation per signature."""
    blank = strip_ws(F.coalesce(F.col(content), F.lit(""))) == ""
    groups = (
        df.select(digest(signature(content)).alias("k"), F.col(order).alias("o"), blank.alias("blank"))
        .groupBy("k")
        .agg(F.count("*").alias("n"), F.min_by("blank", "o").alias("blank"))
    )
    kept = F.count_if(~F.col("blank"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return groups.agg(total.alias("rows_before"), (total - kept).alias("rows_removed"), kept.alias("rows_after"))


def concat_by_name(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name; missing columns read null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_keep_last(old: DataFrame, new: DataFrame, content: str, order: str) -> DataFrame:
    """Old rows then new rows, one per exact content, the last one winning. Null contents
    count as equal to each other."""
    both = concat_by_name(old.withColumn("__rl_part", F.lit(0)), new.withColumn("__rl_part", F.lit(1)))
    key = F.coalesce(digest(F.col(content)), F.lit(""))
    # the newer part first, then the higher order
    rank = F.row_number().over(
        W.partitionBy("__rl_key").orderBy(F.col("__rl_part").desc(), F.col(order).desc())
    )
    return (
        both.withColumn("__rl_key", key)
        .withColumn("__rl_rank", rank)
        .where(F.col("__rl_rank") == 1)
        .drop("__rl_part", "__rl_key", "__rl_rank")
    )


def identity_key(ids: Sequence[str], content: str) -> Column:
    """First id that is neither null, empty nor 0, else the content's digest."""
    real = [
        F.when(~F.col(i).cast("string").isin("", "0"), F.concat(F.lit("id:"), F.col(i).cast("string"))) for i in ids
    ]
    return F.coalesce(*real, F.concat(F.lit("text:"), digest(F.coalesce(F.col(content), F.lit("")))))


def dedup_by_id(df: DataFrame, ids: Sequence[str], content: str, order: str) -> DataFrame:
    """First row per identity."""
    return _one_per_key(df, identity_key(ids, content), F.col(order).asc())


def new_rows(store: DataFrame, batch: DataFrame, key: str, scope: Sequence[str] = ()) -> DataFrame:
    """Rows of ``batch`` whose id the store does not hold (within ``scope``, for example the
    product). Rows without an id always pass, and copies inside the batch all pass. Rows
    without an id never enter the join, so they cannot pile up on one task."""
    has_id = F.coalesce(F.col(key).cast("string") != "", F.lit(False))
    with_id = batch.where(has_id).join(store.select(*scope, key), [*scope, key], "left_anti")
    return with_id.select(*batch.columns).unionByName(batch.where(~has_id))


def upsert_predictions(store: DataFrame, batch: DataFrame, key: str, scope: Sequence[str] = ()) -> DataFrame:
    """The store after an idempotent append."""
    return store.unionByName(new_rows(store, batch, key, scope), allowMissingColumns=True)


# --------------------------------------------------------------- product catalogue


def insert_products(products: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Add products not yet listed; among new rows with one id the first wins."""
    first = _one_per_key(new, F.col(key), F.col(order).asc())
    fresh = first.join(products.select(key), key, "left_anti").select(*new.columns)
    return concat_by_name(products, fresh)


def remove_products(products: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return products.join(ids.select(key), key, "left_anti").select(*products.columns)


def update_products(products: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Overwrite ``columns`` of listed products (one change row per product); unknown
    products are ignored."""
    c = changes.select(key, F.lit(True).alias("__rl_hit"), *[F.col(x).alias(f"__rl_{x}") for x in columns])
    joined = products.join(c, key, "left")
    return joined.select(
        *[
            F.when(F.col("__rl_hit"), F.col(f"__rl_{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x)
            for x in products.columns
        ]
    )
