"""Exact running numbers per key, without bringing a key's rows into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def number_within(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    output: str = "rn",
    slices: int = 64,
    total: str | None = None,
    facts: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Add 1, 2, 3, ... per key in ``order`` (a numeric, unique column). Null keys are one key;
    rows without ``order`` come first in theirs.

    The rows are cut into slices of about equal size by approximate quantiles of the order.
    They are numbered within (key, slice), and each slice starts after the rows of the key's
    earlier slices, counted beforehand. A key with a third of all rows is therefore spread
    over the slices, whatever the gaps in its order; only one count per (key, slice) is ever
    gathered by key. ``total`` adds the key's row count, and ``facts`` its minima or maxima
    (name -> ("min" or "max", column)), from the same counts.
    """
    facts = dict(facts or {})
    added = [output, *([total] if total else []), *facts]
    # doubles keep the order of the values, so equal doubles only share a slice
    value = F.col(order).cast("double")
    cuts = df.select(value.alias("o")).approxQuantile("o", [i / slices for i in range(1, slices)], 1 / (4 * slices))
    passed = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < value)) if cuts else F.lit(0)
    sliced = df.withColumn("__rl_slice", passed)
    group = [*keys, "__rl_slice"]
    local = sliced.withColumn("__rl_local", F.row_number().over(W.partitionBy(*group).orderBy(order)))
    pick = {"min": F.min, "max": F.max}
    counts = sliced.groupBy(*group).agg(
        F.count("*").alias("__rl_n"), *[pick[how](column).alias(name) for name, (how, column) in facts.items()]
    )
    key = W.partitionBy(*keys)
    before = key.orderBy("__rl_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"__rl_of_{c}") for c in group],
        F.coalesce(F.sum("__rl_n").over(before), F.lit(0)).alias("__rl_offset"),
        *([F.sum("__rl_n").over(key).alias(total)] if total else []),
        *[pick[how](name).over(key).alias(name) for name, (how, _) in facts.items()],
    )
    return (
        local.join(offsets, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__rl_of_{c}")) for c in group]))
        .withColumn(output, F.col("__rl_local") + F.col("__rl_offset"))
        .select(*df.columns, *added)
    )
