"""Trainable labellers on Spark ML: mention, sentiment and naive Bayes models.

Features are hashed or counted terms; training is data-parallel on tables. Every function
takes a DataFrame with a text column and a numeric label column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import takewhile

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, RegexTokenizer, UnivariateFeatureSelector
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions.text import WORD
from reviewlens.operators.metrics import kfold_summary, macro_f1
from reviewlens.operators.sampling import assign_fold


def _tokens(text: str) -> RegexTokenizer:
    return RegexTokenizer(inputCol=text, outputCol="tokens", pattern=f"[^{WORD}]+", toLowercase=True)


def hashed_features(text: str, size: int = 1 << 16) -> list:
    return [
        _tokens(text),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=size),
        IDF(inputCol="tf", outputCol="features"),
    ]


def mention_model(text: str, label: str, size: int = 1 << 16, iterations: int = 20) -> Pipeline:
    """Is the aspect mentioned: binary logistic regression."""
    lr = LogisticRegression(labelCol=label, family="binomial", maxIter=iterations, regParam=0.01)
    return Pipeline(stages=[*hashed_features(text, size), lr])


def sentiment_model(text: str, label: str, size: int = 1 << 14, iterations: int = 20) -> Pipeline:
    """Negative / positive / neutral: multinomial logistic regression."""
    lr = LogisticRegression(labelCol=label, family="multinomial", maxIter=iterations, regParam=0.01)
    return Pipeline(stages=[*hashed_features(text, size), lr])


def binary_models(
    df: DataFrame, text: str, labels: Sequence[str], size: int = 1 << 14, iterations: int = 20
) -> tuple[PipelineModel, dict[str, LogisticRegressionModel]]:
    """One binary model per 0/1 label column (aspects, or polarity flags of mixed labels).
    The text is turned into features once for all of them."""
    features = Pipeline(stages=hashed_features(text, size)).fit(df)
    ready = features.transform(df).select(*labels, "features").persist()
    lr = LogisticRegression(family="binomial", maxIter=iterations, regParam=0.01)
    models = {name: lr.copy({lr.labelCol: name}).fit(ready) for name in labels}
    ready.unpersist()
    return features, models


def naive_bayes(text: str, label: str, vocabulary: int = 1 << 16, top: int = 1000) -> Pipeline:
    """Term counts, chi-squared selection, multinomial naive Bayes."""
    selector = UnivariateFeatureSelector(
        featuresCol="counts", outputCol="features", labelCol=label, selectionMode="numTopFeatures"
    )
    selector.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(top)
    return Pipeline(
        stages=[
            _tokens(text),
            CountVectorizer(inputCol="tokens", outputCol="counts", vocabSize=vocabulary, binary=False),
            selector,
            NaiveBayes(labelCol=label, modelType="multinomial"),
        ]
    )


def score_aspects(
    df: DataFrame, features: PipelineModel, models: dict[str, LogisticRegressionModel], threshold: float = 0.5
) -> DataFrame:
    """Probability per model, gathered into a map of the aspects at or above the threshold."""
    out = features.transform(df)
    names = list(models)
    for i, name in enumerate(names):
        scored = models[name].transform(out)
        out = scored.withColumn(f"__rl_m{i}", vector_to_array("probability")[1]).select(*out.columns, f"__rl_m{i}")
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"__rl_m{i}").alias("value")) for i, n in enumerate(names)])
    found = F.map_from_entries(F.filter(entries, lambda e: e["value"] >= threshold))
    return out.withColumn("scores", found).select(*df.columns, "scores")


def term_counts(df: DataFrame, key: str, text: str, label: str, folds: int, seed: int = 42) -> DataFrame:
    """(key, fold, label, term, tf) of rows with a label; a row without terms has one row with a null term."""
    tagged = assign_fold(df.where(F.col(label).isNotNull()), key, folds, seed)
    terms = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), f"[^{WORD}]+"), lambda x: x != "")
    each = tagged.select(key, "fold", F.col(label).alias("label"), F.explode_outer(terms).alias("term"))
    return each.groupBy(key, "fold", "label", "term").agg(F.count("term").alias("tf"))


def naive_bayes_folds(counts: DataFrame, key: str, classes: Sequence) -> DataFrame:
    """(key, fold, label, prediction) of every row, by the model of the other folds.

    ``counts`` is a stored table from :func:`term_counts`. Multinomial naive Bayes with one added per term needs sums
    only, so a fold's model is the total of all folds less that fold: whatever the number of folds, the terms are counted
    once, per fold, and no fold is trained on its own. The vocabulary of a fold's model is the terms that other
    folds have. Of classes with equal scores (to six places) the first in ``classes`` wins.
    """
    k = range(len(classes))
    is_class = [F.col("label") == F.lit(c) for c in classes]
    in_fold = counts.where("term IS NOT NULL").groupBy("term", "fold").agg(*[F.sum(F.when(is_class[i], F.col("tf")).otherwise(0)).alias(f"f{i}") for i in k])
    over_all = in_fold.groupBy("term").agg(*[F.sum(f"f{i}").alias(f"a{i}") for i in k])
    # what is left of a term without each fold that has it; other folds' models have all of it
    model = in_fold.join(over_all, "term").select("term", "fold", *[(F.col(f"a{i}") - F.col(f"f{i}")).alias(f"n{i}") for i in k])
    gone = model.groupBy("fold").agg(F.count_if(sum((F.col(f"n{i}") for i in k), F.lit(0)) == 0).alias("gone"))
    vocabulary = over_all.agg(F.count("*").alias("vocabulary"), *[F.sum(f"a{i}").alias(f"all{i}") for i in k])
    in_total = in_fold.groupBy("fold").agg(*[F.sum(f"f{i}").alias(f"own{i}") for i in k])
    docs = counts.select(key, "fold", "label").distinct()
    own = docs.groupBy("fold").agg(F.count("*").alias("docs"), *[F.count_if(is_class[i]).alias(f"d{i}") for i in k])
    everything = vocabulary.first()
    all_docs = docs.agg(F.count("*").alias("docs"), *[F.count_if(is_class[i]).alias(f"d{i}") for i in k]).first()
    facts = own.join(gone, "fold", "left").join(in_total, "fold", "left").na.fill(0)
    sizes = facts.select(
        "fold",
        *[(F.lit(everything[f"all{i}"] or 0) - F.col(f"own{i}") + F.lit(everything["vocabulary"]) - F.col("gone")).alias(f"t{i}") for i in k],
        *[F.log((F.lit(all_docs[f"d{i}"]) - F.col(f"d{i}")) / (F.lit(all_docs["docs"]) - F.col("docs"))).alias(f"p{i}") for i in k],
    )
    known = counts.join(model, ["term", "fold"], "left").join(F.broadcast(sizes), "fold")  # one row per fold
    logs = [F.sum(F.when(F.col("term").isNull(), 0.0).otherwise(F.col("tf") * F.log((F.coalesce(F.col(f"n{i}"), F.lit(0)) + 1) / F.col(f"t{i}")))).alias(f"l{i}") for i in k]
    scored = known.groupBy(key, "fold", "label").agg(*logs, *[F.first(f"p{i}").alias(f"p{i}") for i in k])
    scores = F.array(*[F.round(F.coalesce(F.col(f"p{i}"), F.lit(float("-inf"))) + F.col(f"l{i}"), 6) for i in k])
    best = F.array_position(scores, F.array_max(scores)).cast("int") - 1
    return scored.select(key, "fold", "label", F.element_at(F.array(*map(F.lit, classes)), best + 1).alias("prediction"))


def prepared_once(df: DataFrame, stages: Sequence[Transformer], keep: Sequence[str], path: str) -> DataFrame:
    """``keep`` and what ``stages``, which learn nothing, make of ``df`` in the end, stored by fold."""
    out = PipelineModel(list(stages)).transform(df)
    made = stages[-1].getOutputCol()
    out.select(*keep, "fold", made).write.partitionBy("fold").parquet(path)
    return df.sparkSession.read.parquet(path)


def cross_validate(
    df: DataFrame, key: str, label: str, make: Callable[[], Pipeline], folds: int = 5, seed: int = 42, path: str | None = None
) -> DataFrame:
    """Macro F1 per fold (the folds come from the id's hash). One row per fold. With a shared folder ``path`` ``df`` and the leading
    stages that learn nothing are worked out once for all folds, not for each fit and each scoring; the later stages must read
    only ``label`` and what the last of these stages makes."""
    tagged = assign_fold(df, key, folds, seed)
    first = [*takewhile(lambda stage: isinstance(stage, Transformer), make().getStages())] if path else []
    if first:
        tagged = prepared_once(tagged, first, [key, label], path)
    rows: DataFrame | None = None
    for i in range(folds):
        model = Pipeline(stages=make().getStages()[len(first):]).fit(tagged.where(F.col("fold") != i))
        scored = model.transform(tagged.where(F.col("fold") == i))
        one = macro_f1(scored, label, "prediction").select(
            F.lit(i).alias("fold"), F.col("macro_f1").alias("combined_f1")
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def cross_validate_summary(folds: DataFrame) -> DataFrame:
    return kfold_summary(folds)


# ------------------------------------------------------------------ external scorers

Scorer = Callable[[list[str]], list[str]]


def batch_predictor(load: Callable[[], Callable], size: int, return_type: T.DataType, batch: int = 256) -> Callable:
    """A numeric model as a Column function over vectors of ``size`` numbers, in batches."""
    return predict_batch_udf(load, return_type=return_type, batch_size=batch, input_tensor_shapes=[[size]])


def scorer_udf(load: Callable[[str], Scorer], version: str) -> Callable[[Column | str], Column]:
    """A batch scorer as a Column function.

    ``load(version)`` runs once per Python task; ``version`` is resolved on the driver (per
    micro-batch in a stream), so a new model takes effect with the next batch. Blank texts
    give ``{}`` and a failing batch falls back to single texts, so one bad row yields
    ``{"error": ...}`` and the job goes on.
    """

    def one(score: Scorer, text: str) -> str:
        import json

        try:
            return score([text])[0]
        except Exception as exc:  # reported in the row
            return json.dumps({"error": str(exc)})

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = load(version)
        for texts in batches:
            out = pd.Series(["{}"] * len(texts), index=texts.index, dtype="object")
            todo = texts[texts.fillna("") != ""]
            if len(todo):
                try:
                    out.loc[todo.index] = score(todo.tolist())
                except Exception:
                    out.loc[todo.index] = [one(score, t) for t in todo]
            yield out

    # real types, not their names, so that Spark can tell the kind of function
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.StringType())
