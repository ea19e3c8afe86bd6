"""Model training and scoring queries (rows-only checks: learned numbers are not SQL)."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.text import WORD
from reviewlens.operators import learn
from reviewlens.operators.sampling import assign_split
from reviewlens.plans.registry import query
from reviewlens.plans.session import scratch_path, spread
from reviewlens.plans.views import Tables


def labelled(t: Tables) -> DataFrame:
    """Documents with their labels: quality, toxic and a three-class sentiment."""
    both = spread(t.documents.select("doc_id", "text")).join(t.labels, "doc_id")
    sentiment = F.when(F.col("toxic") == 1, 0.0).when(F.col("quality") == 1, 1.0).otherwise(2.0)
    return both.select(
        "doc_id",
        "text",
        F.col("quality").cast("double").alias("quality"),
        F.col("toxic").cast("double").alias("toxic"),
        sentiment.alias("sentiment"),
    )


def fit_and_score(t: Tables, pipeline, label: str) -> DataFrame:
    """Fit on the train part, score every labelled row."""
    rows = assign_split(labelled(t), "doc_id")
    model = pipeline.fit(rows.where("split = 'train'"))
    return model.transform(rows).select("doc_id", "split", F.col(label).alias("truth"), "prediction")


@query("ml_mention")
def ml_mention(t):
    return fit_and_score(t, learn.mention_model("text", "quality", size=1 << 14), "quality")


@query("ml_sentiment")
def ml_sentiment(t):
    return fit_and_score(t, learn.sentiment_model("text", "sentiment", size=1 << 12), "sentiment")


@query("ml_naive_bayes")
def ml_naive_bayes(t):
    return fit_and_score(t, learn.naive_bayes("text", "quality", vocabulary=1 << 13, top=500), "quality")


CLASSES = [0, 1, 2]


def folds_sql() -> str:
    def each(text: str) -> str:
        return ", ".join(text.replace("#", str(i)) for i in CLASSES)

    score = "[" + each("round(CASE WHEN d# = 0 THEN '-infinity'::DOUBLE ELSE ln(d# / docs) END + l#, 6)") + "]"
    terms = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^{WORD}]+'), lambda x: x <> '')"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, CAST(CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold,
  CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 1 ELSE 2 END AS label, {terms} AS terms FROM documents JOIN labels USING (doc_id)),
c AS MATERIALIZED (SELECT doc_id, fold, label, term, count(*) AS tf FROM (SELECT doc_id, fold, label, unnest(terms) AS term FROM d) GROUP BY ALL),
tests AS (SELECT DISTINCT fold FROM d),
n AS MATERIALIZED (SELECT tests.fold, term, {each('coalesce(sum(tf) FILTER (label = #), 0) AS n#')} FROM c JOIN tests ON c.fold <> tests.fold GROUP BY ALL),
t AS (SELECT fold, {each('sum(n#) + count(*) AS t#')} FROM n GROUP BY fold),
p AS (SELECT tests.fold, CAST(count(*) AS DOUBLE) AS docs, {each('count(*) FILTER (label = #) AS d#')} FROM d JOIN tests ON d.fold <> tests.fold GROUP BY ALL),
s AS (SELECT doc_id, {each('sum(tf * ln((coalesce(n#, 0) + 1) / t#)) AS l#')} FROM c JOIN t USING (fold) LEFT JOIN n USING (fold, term) GROUP BY doc_id),
r AS (SELECT doc_id, fold, label, {score} AS scores FROM d JOIN p USING (fold) LEFT JOIN (SELECT doc_id, {each('l#')} FROM s) USING (doc_id))
SELECT doc_id, fold, label, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS prediction FROM r"""


@query("ml_naive_bayes_folds", folds_sql())
def ml_naive_bayes_folds(t):
    """Every labelled document judged by the naive Bayes model of the other four folds, out of one count of terms."""
    rows = labelled(t).select("doc_id", "text", F.col("sentiment").cast("int").alias("label"))
    path = scratch_path(t.spark, "term-counts")
    learn.term_counts(rows, "doc_id", "text", "label", 5).write.parquet(path)
    return learn.naive_bayes_folds(t.spark.read.parquet(path), "doc_id", CLASSES)


@query("ml_kfold")
def ml_kfold(t):
    path = scratch_path(t.spark, "fold-features")
    return learn.cross_validate(labelled(t), "doc_id", "quality", lambda: learn.mention_model("text", "quality", size=1 << 12), path=path)


@query("ml_score")
def ml_score(t):
    """One binary model per aspect, the aspects found as a map per document."""
    features, models = learn.binary_models(labelled(t), "text", ["quality", "toxic"], size=1 << 12)
    scored = learn.score_aspects(spread(t.documents.select("doc_id", "text")), features, models)
    return scored.select("doc_id", F.array_join(F.array_sort(F.map_keys("scores")), ",").alias("found"))


def load_counter(version: str):
    """A stand-in model: counts the marks of a text, tagged with the version."""
    marks = re.compile(r"[!?.,;:]")

    def score(texts: list[str]) -> list[str]:
        return [json.dumps({"version": version, "marks": len(marks.findall(x))}) for x in texts]

    return score


@query(
    "scorer_udf",
    """SELECT doc_id, CASE WHEN text <> '' THEN '{"version": "v1", "marks": ' || length(regexp_replace(text, '[^!?.,;:]', '', 'g')) || '}' ELSE '{}' END AS reply FROM documents""",
)
def scorer_udf(t):
    """A batch scorer loaded once per task, fed over Arrow."""
    score = learn.scorer_udf(load_counter, "v1")
    return spread(t.documents).select("doc_id", score("text").alias("reply"))
