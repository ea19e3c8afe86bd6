"""Counts, distributions and scores per aspect.

Wide labels are aggregated wide: one pass computes every aspect's measures with map-side
partial sums, and only the small result is turned into rows. Exploding first would send
nine rows per review through the aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlens.functions.labels import to_int, to_wide

Measures = dict[str, Callable[[Column], Column]]


def per_aspect(df: DataFrame, keys: Sequence[str], aspects: Sequence[str], measures: Measures) -> DataFrame:
    """Aggregate each aspect column with each measure; result rows are (keys, aspect, measures)."""
    aggs = [
        make(F.col(f"`{a}`").cast("string")).alias(f"{m}_{i}")
        for i, a in enumerate(aspects)
        for m, make in measures.items()
    ]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("aspect"), *[F.col(f"{m}_{i}").alias(m) for m in measures])
            for i, a in enumerate(aspects)
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def _is(value: str) -> Callable[[Column], Column]:
    return lambda c: F.count_if(c == value)


def aspect_stats(df: DataFrame, aspects: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Positive / negative / neutral / mixed / absent counts by exact text, mentioned and
    its percentage; ``1.0`` is not ``1`` and falls under absent."""
    measures: Measures = {
        "pos": _is("1"),
        "neg": _is("-1"),
        "neu": _is("0"),
        "multi": lambda c: F.count_if(F.contains(c, F.lit("["))),
        "total": lambda c: F.count("*"),
    }
    mentioned = F.col("pos") + F.col("neg") + F.col("neu") + F.col("multi")
    return per_aspect(df, keys, aspects, measures).select(
        *keys,
        "aspect",
        "pos",
        "neg",
        "neu",
        "multi",
        (F.col("total") - mentioned).alias("na"),
        mentioned.alias("mentioned"),
        F.when(F.col("total") > 0, F.round(mentioned / F.col("total") * 100, 1)).otherwise(0.0).alias("pct"),
    )


def aspect_summary(df: DataFrame, keys: Sequence[str], aspects: Sequence[str]) -> DataFrame:
    """Positive / negative / neutral per key and aspect; an aspect is listed when any
    review mentions it, mixed labels counting as mention only."""
    measures: Measures = {
        "positive": _is("1"),
        "negative": _is("-1"),
        "neutral": _is("0"),
        "seen": lambda c: F.count_if(c != "2"),
    }
    return per_aspect(df, keys, aspects, measures).where(F.col("seen") > 0).drop("seen")


def aspect_summary_long(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """The same from rows (keys, aspect, label)."""
    c = F.col(label).cast("string")
    return (
        df.where(c != "2")
        .groupBy(*keys, "aspect")
        .agg(
            F.count_if(c == "1").alias("positive"),
            F.count_if(c == "-1").alias("negative"),
            F.count_if(c == "0").alias("neutral"),
        )
    )


def summary_json(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One JSON object per key: aspect -> {positive, negative, neutral}. The list gathered
    per key has one entry per aspect, since ``summary`` is already grouped by aspect."""
    entry = F.struct("aspect", F.struct("positive", "negative", "neutral").alias("v"))
    return summary.groupBy(*keys).agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("summary")
    )


def label_distribution(long: DataFrame) -> DataFrame:
    """Count and percentage of every label value per aspect."""
    counts = long.groupBy("aspect", "label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("aspect"))
    return counts.withColumn("pct", F.round(F.col("n") / total * 100, 1))


def score(label: Column, default: float) -> Column:
    """Mean of 100 / 50 / 0 for labels 1 / 0 / -1, others ignored; ``default`` if none."""
    v = to_int(label)
    points = F.when(v == 1, 100.0).when(v == 0, 50.0).when(v == -1, 0.0)
    return F.coalesce(F.avg(points), F.lit(float(default)))


def aspect_scores(df: DataFrame, keys: Sequence[str], aspects: Sequence[str], default: float = 50.0) -> DataFrame:
    """0-100 score per key and aspect from wide labels."""
    return per_aspect(df, keys, aspects, {"score": lambda c: score(c, default)})


def aspect_scores_long(long: DataFrame, keys: Sequence[str], default: float = 50.0) -> DataFrame:
    return long.groupBy(*keys, "aspect").agg(score(F.col("label"), default).alias("score"))


def product_comparison(scores: DataFrame, key: str, aspects: Sequence[str]) -> DataFrame:
    """Products by aspects matrix of scores; products without any score are left out."""
    return to_wide(scores, [key], aspects, "score")


def rating_histogram(df: DataFrame, rating: str = "rating", unique_key: str | None = None) -> DataFrame:
    """Reviews per rating, sorted by rating; with ``unique_key`` also the distinct ones."""
    aggs = [F.count("*").alias("n")]
    if unique_key:
        aggs.append(F.count_distinct(unique_key).alias("n_unique"))
    return df.groupBy(rating).agg(*aggs).orderBy(rating)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def multi_polarity_count(df: DataFrame, parsed: Column) -> DataFrame:
    """Mixed cells, mentions and all cells, from ``parse_multipolarity`` structs."""
    flags = parsed["neg"] + parsed["pos"] + parsed["neu"]
    return df.agg(
        F.count_if(flags > 1).alias("multi_cells"),
        F.count_if(parsed["mention"] == 1).alias("mentions"),
        F.count("*").alias("cells"),
    )


def sentiment_trend(
    df: DataFrame, key: str, ts: str, label: str = "label", length: str = "1 day", jump: float = 0.1
) -> DataFrame:
    """Share of negatives per key and time window, and an alert when it jumps by ``jump``
    against the key's previous window. The comparison runs over the grouped windows."""
    counted = (
        df.where(F.col(label).isin("1", "0", "-1"))
        .groupBy(key, F.window(ts, length).alias("w"))
        .agg(F.count("*").alias("n"), F.count_if(F.col(label) == "-1").alias("negatives"))
        .select(key, F.col("w.start").alias("window_start"), "n", "negatives")
        .withColumn("negative_share", F.col("negatives") / F.col("n"))
    )
    before = F.lag("negative_share").over(W.partitionBy(key).orderBy("window_start"))
    return counted.withColumn("alert", F.coalesce(F.col("negative_share") - before >= jump, F.lit(False)))
