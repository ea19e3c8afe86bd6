import pytest
from pyspark.sql import functions as F

from reviewlens.operators import aggregate, dedup, metrics, project, relate, sampling
from reviewlens.operators.numbering import number_within


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_fuzzy_dedup_blank_first_removes_marks_only(spark):
    df = spark.createDataFrame([(1, ""), (2, "!!!"), (3, "Tốt"), (4, "tốt.")], "seq int, content string")
    assert rows(dedup.fuzzy_dedup(df, "content", "seq")) == [(3, "Tốt")]
    assert rows(dedup.fuzzy_dedup_stats(df, "content", "seq")) == [(4, 3, 1)]
    other = spark.createDataFrame([(1, "!!!"), (2, ""), (3, None)], "seq int, content string")
    assert rows(dedup.fuzzy_dedup(other, "content", "seq")) == [(1, "!!!")]


def test_fuzzy_dedup_empty_input(spark):
    df = spark.createDataFrame([], "seq int, content string")
    assert rows(dedup.fuzzy_dedup_stats(df, "content", "seq")) == [(0, 0, 0)]


def test_merge_keep_last(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 7)], "seq int, c string, v int")
    new = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (3, None, 8)], "seq int, c string, v int")
    assert rows(dedup.merge_keep_last(old, new, "c", "seq").select("c", "v"), "c") == [(None, 8), ("a", 2), ("b", 3)]


def test_upsert(spark):
    store = spark.createDataFrame([("p", "1")], "product string, id string")
    batch = spark.createDataFrame([("p", "1"), ("p", "2"), ("p", "2"), ("p", None), ("p", ""), ("q", "1")], "product string, id string")
    got = rows(dedup.new_rows(store, batch, "id", ["product"]), "product", "id")
    assert got == [("p", None), ("p", ""), ("p", "2"), ("p", "2"), ("q", "1")]
    unique = spark.createDataFrame([("p", "5"), ("p", "6")], "product string, id string")
    once = dedup.upsert_predictions(store, unique, "id", ["product"])
    assert rows(dedup.upsert_predictions(once, unique, "id", ["product"]), "id") == rows(once, "id")


def test_dedup_by_id_falls_through(spark):
    df = spark.createDataFrame(
        [(1, "5", None, "a"), (2, None, "5", "b"), (3, "", "0", "c"), (4, None, None, "c"), (5, "0", "9", "d")],
        "seq int, rate string, id string, c string",
    )
    assert [r[0] for r in rows(dedup.dedup_by_id(df, ["rate", "id"], "c", "seq"), "seq")] == [1, 3, 5]


def test_products(spark):
    p = spark.createDataFrame([("a", "A", 1.0)], "id string, name string, price double")
    new = spark.createDataFrame([("a", "X", 9.0), ("b", "B", 2.0), ("b", "B2", 3.0)], "id string, name string, price double")
    listed = dedup.insert_products(p, new, "id", "price")
    assert rows(listed, "id") == [("a", "A", 1.0), ("b", "B", 2.0)]
    changed = dedup.update_products(listed, spark.createDataFrame([("b", None), ("z", 4.0)], "id string, price double"), "id", ["price"])
    assert rows(changed, "id") == [("a", "A", 1.0), ("b", "B", None)]
    assert rows(dedup.remove_products(listed, spark.createDataFrame([("a",)], "id string"), "id")) == [("b", "B", 2.0)]


def test_balanced_sample(spark):
    df = spark.range(50).select(F.lit("p").alias("product"), F.when(F.col("id") < 40, 1).otherwise(5).alias("rating"), F.col("id").alias("seq"))
    got = sampling.balanced_sample(df, "product", "rating", "seq")
    assert rows(got.groupBy("rating").count(), "rating") == [(1, 30), (5, 10)]


def test_file_batches(spark):
    df = spark.range(58).select(F.format_string("f%02d", "id").alias("file"))
    assert [n for _, n in rows(sampling.file_batches(df, "file").groupBy("batch").count(), "batch")] == [10, 10, 10, 10, 10, 8]
    some = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "i int, file string")
    assert rows(sampling.file_batches(some, "file", 2), "i") == [(1, "b", 2), (2, None, 1), (3, "a", 1), (4, "b", 2)]
    assert sampling.file_batches(some.limit(0), "file").count() == 0


def test_promotion_of_many_versions(spark):
    """Against a plain loop: many versions of one model, repeats, missing scores, a missing model."""
    import random

    rng = random.Random(7)
    many = [("m", v, round(min(1, v / 3e5 + rng.random() / 3), 4)) for v in range(200_000)]
    odd = [("o", 1, 0.5), ("o", 1, 0.5), ("o", 2, None), ("o", 3, 0.505), ("o", 4, 0.9), (None, 1, 0.2), (None, 2, 0.005)]
    want, champion = [], {}
    for m, v, f in sorted(many + odd, key=lambda r: (r[0] or "", r[1], r[2] or 0.0)):
        old = champion.get(m, 0.0)
        better = None if f is None else f - old >= 0.01
        want.append((m, v, f, old, better))
        if better:
            champion[m] = f
    df = spark.createDataFrame(many + odd, "model string, version long, best_f1 double")
    got = [tuple(r) for r in metrics.promotion_history(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_split_and_folds(spark):
    df = spark.range(20000)
    n = dict(rows(sampling.assign_split(df, "id").groupBy("split").count()))
    assert abs(n["train"] / 20000 - 0.8) < 0.02
    folds = rows(sampling.assign_fold(df, "id").groupBy("fold").count(), "fold")
    assert [f for f, _ in folds] == [0, 1, 2, 3, 4] and all(abs(c - 4000) < 300 for _, c in folds)


def test_stats_and_scores(spark):
    df = spark.createDataFrame([(v,) for v in ["1", "-1", "0", "[-1,1]", "2", "1.0"]], "a string")
    assert rows(aggregate.aspect_stats(df, ["a"])) == [("a", 1, 1, 1, 1, 2, 4, 66.7)]
    scored = spark.createDataFrame([("1",), ("0",), ("-1",), ("2",)], "a string")
    assert rows(aggregate.aspect_scores(scored, [], ["a"])) == [("a", 50.0)]
    none = spark.createDataFrame([("2",), ("2",)], "a string")
    assert rows(aggregate.aspect_scores(none, [], ["a"], 50)) == [("a", 50.0)]
    assert rows(aggregate.aspect_scores(none, [], ["a"], 0)) == [("a", 0.0)]


def test_summary_lists_mixed_aspects(spark):
    df = spark.createDataFrame([("p", "[-1,1]", "2"), ("p", "1", "2")], "product string, a string, b string")
    assert rows(aggregate.aspect_summary(df, ["product"], ["a", "b"])) == [("p", "a", 1, 0, 0)]


def test_metrics(spark):
    folds = spark.createDataFrame([(1, 0.8), (2, 1.0), (3, 0.9), (4, 1.0)][:3], "fold int, combined_f1 double")
    mean, std, best, top = rows(metrics.kfold_summary(folds))[0]
    assert (round(mean, 4), round(std, 4), best, top) == (0.9, 0.0816, 2, 1.0)
    tie = spark.createDataFrame([(1, 0.8), (2, 1.0), (3, 1.0)], "fold int, combined_f1 double")
    assert rows(metrics.kfold_summary(tie))[0][2] == 2
    hot = spark.createDataFrame([(1, 1, 0, 1, 0, 0), (0, 0, 0, 0, 0, 0)], "t1 int, t2 int, t3 int, p1 int, p2 int, p3 int")
    got = rows(metrics.samples_f1(hot.limit(1), ["t1", "t2", "t3"], ["p1", "p2", "p3"], F.lit(True)))[0]
    assert round(got[0], 4) == 0.6667
    assert rows(metrics.samples_f1(hot, ["t1"], ["p1"], F.lit(False))) == [(0.0, 0.0, 0)]


def test_macro_f1_counts_classes_of_both_sides(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "t int, p int")
    # f1 by hand: class 0 2/3, class 1 2/4, class 2 0
    assert round(rows(metrics.macro_f1(df, "t", "p"))[0][0], 6) == round((2 / 3 + 0.5 + 0) / 3, 6)
    acc, weighted = rows(metrics.accuracy_f1(df, "t", "p"))[0]
    assert acc == 0.5 and round(weighted, 6) == round((2 * 2 / 3 + 0.5 + 0) / 4, 6)


def test_evaluator_agrees(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator as Ev

    df = spark.range(200).select((F.col("id") % 3).cast("double").alias("t"), (F.col("id") % 7 % 3).cast("double").alias("p"))
    acc, weighted = rows(metrics.accuracy_f1(df, "t", "p"))[0]
    assert abs(Ev(labelCol="t", predictionCol="p", metricName="accuracy").evaluate(df) - acc) < 1e-9
    assert abs(Ev(labelCol="t", predictionCol="p", metricName="weightedFMeasure").evaluate(df) - weighted) < 1e-9


def test_promotion(spark):
    runs = spark.createDataFrame([("m", 1, 0.39), ("m", 2, 0.395), ("m", 3, 0.41)], "model string, version long, best_f1 double")
    assert [r[-1] for r in rows(metrics.promotion_history(runs), "version")] == [True, False, True]
    old = runs.where("version = 1").select("model", "best_f1")
    got = rows(metrics.compare_models(old, metrics.latest_models(runs)))
    assert got == [("m", 0.39, 0.41, True)]


def test_completeness(spark):
    e = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string")
    p = spark.createDataFrame([("a",), ("c",), ("d",)], "k string")
    assert rows(relate.completeness(e, p, "k"), "k") == [
        ("a", 2, 1, "partial"), ("b", 1, 0, "missing"), ("c", 1, 1, "complete"), ("d", 0, 1, "complete"),
    ]


def test_projections(spark):
    df = spark.createDataFrame([(1, "x", None)], "id int, content string, reviewContent string")
    assert project.resolve_content(df, output="o").first()["o"] == ""
    assert project.resolve_content(df, project.CONTENT_PLAIN_FIRST, output="o").first()["o"] == "x"
    with pytest.raises(ValueError):
        project.resolve_content(df.select("id"), first_column_fallback=False)
    with pytest.raises(ValueError):
        project.existing_aspects(df, ["nope"])
    assert project.with_aspects(df, ["a"]).first()["a"] == "2"
    assert project.trim_names(df.toDF(" id ", "c", "d")).columns[0] == "id"


def test_number_within_is_exact_for_a_hot_key(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), ((F.col("id") * 7919) % 30000).alias("o"))
    from pyspark.sql import Window as W

    got = number_within(df, ["k"], "o")
    want = df.withColumn("w", F.row_number().over(W.partitionBy("k").orderBy("o")))
    assert got.join(want, ["k", "o"]).where("rn <> w").count() == 0 and got.count() == 30000
    assert number_within(df.limit(0), ["k"], "o").count() == 0


def test_latest_n_beyond_the_bound_of_spark(spark):
    from reviewlens.operators import sampling

    df = spark.range(3000).selectExpr("id AS o", "IF(id % 3 = 0, 'a', 'b') AS k")
    got = sampling.latest_n(df, ["o"], 1001, ["k"])
    assert {(r[0], r[1], r[2]) for r in got.groupBy("k").agg({"o": "min", "*": "count"}).select("k", "min(o)", "count(1)").collect()} == {("a", 0, 1000), ("b", 1499, 1001)}


def test_many_keywords_make_a_shallow_expression(spark):
    from reviewlens.operators import lexicon

    words = [f"w{i}x" for i in range(2000)]
    df = spark.createDataFrame([("w7x and w1999x",), ("none",)], "t string")
    got = df.select(lexicon.contains_any(df.t, words), lexicon.count_contained(df.t, words)).collect()
    assert sorted(map(tuple, got)) == [(False, 0), (True, 2)]


def test_folds_from_stored_features_equal_plain_folds(spark, tmp_path):
    """The stages that learn nothing run once, into a table of features by fold; the figures stay the same."""
    from reviewlens.operators import learn

    texts = ["tốt đẹp", "xấu tệ", "tốt lắm", "tệ quá", "đẹp quá", "xấu lắm"]
    df = spark.createDataFrame([(i, texts[i % 6], float(i % 2)) for i in range(60)], "i bigint, t string, y double")
    make = lambda: learn.mention_model("t", "y", size=1 << 8, iterations=3)
    path = str(tmp_path / "features")
    stored = learn.cross_validate(df, "i", "y", make, folds=3, path=path)
    plain = learn.cross_validate(df, "i", "y", make, folds=3)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, plain.collect()))
    features = spark.read.parquet(path)
    assert sorted(features.columns) == ["fold", "i", "tf", "y"] and features.count() == 60
