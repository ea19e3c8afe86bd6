"""What the physical plans must and must not contain."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from reviewlens.operators import dedup, sampling
from reviewlens.plans.catalogue import ORACLES, QUERIES

LEARNED = {"scorer_udf", "ml_mention", "ml_sentiment", "ml_naive_bayes", "ml_kfold", "ml_score"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in LEARNED and not n.startswith("stream_")))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text, node


@pytest.mark.parametrize("name", ["fuzzy_dedup", "merge_keep_last", "dedup_by_id", "balanced_sample", "latest_n_per_product"])
def test_groups_are_cut_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_scan_reads_only_what_it_needs(spark):
    text = plan(QUERIES["balanced_sample"](spark, SMALL))
    assert "text" not in text.split("ReadSchema: ")[1].split(">")[0]
    text = plan(QUERIES["upsert_predictions"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts" in text


def test_labelling_does_not_shuffle(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    from reviewlens.operators import rules, validate

    assert "Exchange" not in plan(rules.rules_simple(df, "text"))
    assert "Exchange" not in plan(validate.validate_labels(rules.rules_simple(df, "text"), ["doc_id"], "text"))


def test_hot_copies_give_the_right_answer(spark):
    """A third of all rows share one text, one product and one rating."""
    df = spark.range(60000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "Hot, hot!").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("content"),
        F.when(F.col("id") % 3 == 0, "p").otherwise(F.concat(F.lit("p"), (F.col("id") % 100).cast("string"))).alias("product"),
        (F.col("id") % 3 + 1).cast("int").alias("rating"),
    )
    assert dedup.fuzzy_dedup(df, "content", "seq").count() == 40001
    assert sampling.balanced_sample(df, "product", "rating", "seq").where("product = 'p'").count() == 30
    assert sampling.latest_n(df, ["seq"], 50, ["product"]).where("product = 'p'").count() == 50


def test_most_queries_have_sql():
    assert set(QUERIES) - set(ORACLES) == LEARNED - {"scorer_udf"}
