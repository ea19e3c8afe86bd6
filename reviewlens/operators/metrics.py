"""Evaluation metrics and model promotion, all from counts.

The confusion counts are the only step that touches the data; everything after works on a
few rows per class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def confusion_counts(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_scores(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per class seen in truth or prediction: tp, support, predicted, precision, recall, f1."""
    c = confusion_counts(df, truth, pred, keys)
    zero = F.lit(0).cast("bigint")
    as_truth = F.struct(
        F.col("truth").alias("class"),
        F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(zero).alias("tp"),
        F.col("n").alias("support"),
        zero.alias("predicted"),
    )
    as_pred = F.struct(
        F.col("pred").alias("class"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")
    )
    sums = (
        c.select(*keys, F.explode(F.array(as_truth, as_pred)).alias("r"))
        .select(*keys, "r.*")
        .groupBy(*keys, "class")
        .agg(*[F.sum(x).alias(x) for x in ("tp", "support", "predicted")])
    )
    return sums.select(
        *keys,
        "class",
        "tp",
        "support",
        "predicted",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def accuracy_f1(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted F measure."""
    return class_scores(df, truth, pred, keys).groupBy(*keys).agg(
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def macro_f1(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of the F1 of every class in truth or prediction."""
    return class_scores(df, truth, pred, keys).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def multilabel_scores(df: DataFrame, label: str, truth_m: str, pred_m: str, truth_s: str, pred_s: str) -> DataFrame:
    """Rows (label, mention truth/prediction 0-1, sentiment truth/prediction).

    Mention F1 is binary per label, averaged over labels; sentiment F1 is the macro over
    classes; with sentiment accuracy and the mean of both F1.
    """
    per_label = df.groupBy(label).agg(
        F.count_if((F.col(truth_m) == 1) & (F.col(pred_m) == 1)).alias("tp"),
        F.count_if(F.col(truth_m) == 1).alias("t"),
        F.count_if(F.col(pred_m) == 1).alias("p"),
    )
    mention = per_label.select(_ratio(2 * F.col("tp"), F.col("t") + F.col("p")).alias("mention"))
    sentiment = class_scores(df, truth_s, pred_s).select(F.col("f1").alias("sentiment"), "tp", "support")
    # a few rows from each side, averaged apart (nulls do not count)
    return (
        mention.unionByName(sentiment, allowMissingColumns=True)
        .agg(
            F.avg("mention").alias("mention_f1"),
            F.avg("sentiment").alias("sentiment_f1"),
            _ratio(F.sum("tp"), F.sum("support")).alias("sentiment_acc"),
        )
        .withColumn("combined_f1", (F.col("mention_f1") + F.col("sentiment_f1")) / 2)
    )


def samples_f1(df: DataFrame, truth: Sequence[str], pred: Sequence[str], mentioned: Column) -> DataFrame:
    """Mean row F1 and micro F1 of multi-hot rows, on mentioned rows only; 0 if there are none."""
    tp = sum((F.col(t) * F.col(p) for t, p in zip(truth, pred)), F.lit(0))
    t_sum = sum((F.col(t) for t in truth), F.lit(0))
    p_sum = sum((F.col(p) for p in pred), F.lit(0))
    rows = df.where(mentioned).select(tp.alias("tp"), t_sum.alias("t"), p_sum.alias("p"))
    return rows.agg(
        F.coalesce(F.avg(_ratio(2 * F.col("tp"), F.col("t") + F.col("p"))), F.lit(0.0)).alias("samples_f1"),
        F.coalesce(_ratio(2 * F.sum("tp"), F.sum("t") + F.sum("p")), F.lit(0.0)).alias("micro_f1"),
        F.count("*").alias("n"),
    )


def kfold_summary(folds: DataFrame, fold: str = "fold", f1: str = "combined_f1") -> DataFrame:
    """Mean, population deviation and the best fold (the lowest one among equals)."""
    return folds.agg(
        F.avg(f1).alias("mean_f1"),
        F.stddev_pop(f1).alias("std_f1"),
        F.max_by(fold, F.struct(F.col(f1), -F.col(fold))).alias("best_fold"),
        F.max(f1).alias("best_f1"),
    )


def confusion_matrix(df: DataFrame, truth: str, pred: str, classes: Sequence[str]) -> DataFrame:
    """One row per true class, one column per predicted class."""
    return (
        df.groupBy(F.col(truth).alias("truth")).pivot(pred, list(classes)).agg(F.count(F.lit(1))).na.fill(0)
    )


def cohen_kappa(df: DataFrame, first: str, second: str, keys: Sequence[str] = ()) -> DataFrame:
    """Agreement beyond chance of two annotators."""
    s = class_scores(df, first, second, keys)
    totals = s.groupBy(*keys).agg(
        F.sum("support").alias("n"),
        _ratio(F.sum("tp"), F.sum("support")).alias("observed"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("chance"),
    )
    expected = F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return totals.select(
        *keys,
        "n",
        "observed",
        F.when(expected < 1, (F.col("observed") - expected) / (1 - expected)).otherwise(1.0).alias("kappa"),
    )


# ------------------------------------------------------------------------ promotion


def should_update(old_f1: Column, new_f1: Column, min_gain: float = 0.01) -> Column:
    """Promote when the gain over the old score (0 if there is none) is large enough."""
    return new_f1 - F.coalesce(old_f1, F.lit(0.0)) >= min_gain


def compare_models(old: DataFrame, new: DataFrame, min_gain: float = 0.01) -> DataFrame:
    """Newest challenger against the champion per model: (model, best_f1) on both sides."""
    joined = new.select("model", F.col("best_f1").alias("new_f1")).join(
        old.select("model", F.col("best_f1").alias("old_f1")), "model", "left"
    )
    return joined.select(
        "model",
        F.coalesce("old_f1", F.lit(0.0)).alias("old_f1"),
        "new_f1",
        should_update(F.col("old_f1"), F.col("new_f1"), min_gain).alias("should_update"),
    )


def promotion_history(metrics: DataFrame, min_gain: float = 0.01, slices: int = 64) -> DataFrame:
    """Replay the gate over every version of a model, in order of version, then score.

    Only a score above all earlier ones can be promoted: the champion is never ``min_gain`` below the best
    score so far. So the running maximum, taken in slices of the versions, leaves a few records per model;
    those are folded, and every version finds its champion among the few that were promoted. A version
    without a score has no decision; of rows that repeat a version and score the first alone is promoted.
    """
    runs = metrics.select("model", F.col("version").cast("bigint").alias("version"), F.col("best_f1").cast("double").alias("new_f1"))
    at = F.col("version").cast("double")
    cuts = runs.select(at.alias("v")).approxQuantile("v", [i / slices for i in range(1, slices)], 1 / (4 * slices))
    passed = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < at)) if cuts else F.lit(0)
    sliced = runs.withColumn("__rl_slice", F.when(at.isNull(), 0).otherwise(passed))
    earlier = W.partitionBy("model").orderBy("__rl_slice").rowsBetween(W.unboundedPreceding, -1)
    tops = sliced.groupBy("model", "__rl_slice").agg(F.max("new_f1").alias("top")).select(
        F.col("model").alias("__rl_m"), F.col("__rl_slice").alias("__rl_s"), F.max("top").over(earlier).alias("before")
    )
    within = W.partitionBy("model", "__rl_slice").orderBy("version", "new_f1").rowsBetween(W.unboundedPreceding, -1)
    best = F.greatest(F.max("new_f1").over(within), F.col("before"))
    joined = sliced.join(tops, F.col("model").eqNullSafe(F.col("__rl_m")) & (F.col("__rl_slice") == F.col("__rl_s")))
    records = joined.withColumn("best", best).where("new_f1 > coalesce(best, 0.0)")
    folded = records.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("version", "new_f1"))).alias("runs"))
    kind = "array<struct<version:bigint,new_f1:double>>"

    def step(won: Column, run: Column) -> Column:
        champion = F.coalesce(F.get(won, F.size(won) - 1)["new_f1"], F.lit(0.0))
        return F.when(run["new_f1"] - champion >= min_gain, F.array_append(won, run)).otherwise(won)

    won = folded.select(F.col("model").alias("__rl_m"), F.aggregate("runs", F.array().cast(kind), step).alias("won"))
    repeat = F.row_number().over(W.partitionBy("model", "version", "new_f1").orderBy("model"))
    own = F.struct("version", "new_f1")
    first = F.col("repeat") == 1
    past = F.filter(F.coalesce("won", F.array().cast(kind)), lambda x: (x < own) | (~first & (x == own)))
    rows = runs.withColumn("repeat", repeat).join(won, F.col("model").eqNullSafe(F.col("__rl_m")), "left")
    old = F.coalesce(F.get(past, F.size(past) - 1)["new_f1"], F.lit(0.0))
    return rows.select("model", "version", "new_f1", old.alias("old_f1")).withColumn("should_update", F.col("new_f1") - F.col("old_f1") >= min_gain)


def latest_models(metrics: DataFrame) -> DataFrame:
    """Newest version of every model."""
    return metrics.groupBy("model").agg(
        F.max("version").alias("version"), F.max_by("best_f1", "version").alias("best_f1")
    )
