"""Aggregation, dedup, sampling, join and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.functions import labels as L
from reviewlens.functions.labels import ASPECTS
from reviewlens.operators import aggregate, dedup, metrics, project, relate, rules, sampling
from reviewlens.plans.q_label import MULTIPOLARITY, SIMPLE_LABELLED
from reviewlens.plans.q_text import signature_sql, strip
from reviewlens.plans.registry import query
from reviewlens.plans.views import (
    LABELLED_WIDE,
    LABELS_LONG,
    REVIEWS,
    SCORED,
    Tables,
    sql_text,
)

# -------------------------------------------------------------------- aggregation


def each_aspect(select: str, source: str, group: str = "") -> str:
    """UNION ALL of ``select`` over the aspect columns; {a} is the name, {c} the column."""
    return " UNION ALL ".join(
        f"SELECT {select.replace('{a}', sql_text(a)).replace('{c}', chr(34) + a + chr(34))} FROM {source} {group}" for a in ASPECTS
    )


SUMMARY = " UNION ALL ".join(
    f"SELECT product_id, {sql_text(a)} AS aspect, count(*) FILTER (\"{a}\" = '1') AS positive, "
    f"count(*) FILTER (\"{a}\" = '-1') AS negative, count(*) FILTER (\"{a}\" = '0') AS neutral FROM labelled "
    f"WHERE \"{a}\" <> '2' GROUP BY product_id"
    for a in ASPECTS
)


@query("aspect_summary", f"WITH {SIMPLE_LABELLED} {SUMMARY}")
def aspect_summary(t):
    """Flagship: rule labels of every review, counted per product and aspect."""
    return aggregate.aspect_summary(rules.rules_simple(t.reviews(), "content"), ["product_id"], ASPECTS)


@query(
    "aspect_summary_long",
    f"""WITH {LABELS_LONG} SELECT product_id, aspect, count(*) FILTER (label = '1') AS positive,
  count(*) FILTER (label = '-1') AS negative, count(*) FILTER (label = '0') AS neutral FROM labels_long WHERE label <> '2' GROUP BY ALL""",
)
def aspect_summary_long(t):
    return aggregate.aspect_summary_long(t.labels_long(), ["product_id"])


COUNTS = ", ".join(f"count(*) FILTER ({{c}} = '{v}') AS {n}" for v, n in (("1", "pos"), ("-1", "neg"), ("0", "neu")))
STATS = each_aspect(
    f"{{a}} AS aspect, {COUNTS}, count(*) FILTER (contains({{c}}, '[')) AS multi, count(*) AS total", "labelled_wide"
)


@query(
    "aspect_stats",
    f"WITH {LABELLED_WIDE}, s AS ({STATS}) SELECT aspect, pos, neg, neu, multi, total - pos - neg - neu - multi AS na, "
    "pos + neg + neu + multi AS mentioned, round((pos + neg + neu + multi) / total * 100, 1) AS pct FROM s",
)
def aspect_stats(t):
    return aggregate.aspect_stats(t.labelled_wide(), ASPECTS)


@query(
    "label_distribution",
    f"""WITH {LABELS_LONG}, c AS (SELECT aspect, label, count(*) AS n FROM labels_long GROUP BY ALL)
SELECT aspect, label, n, round(n / CAST(sum(n) OVER (PARTITION BY aspect) AS DOUBLE) * 100, 1) AS pct FROM c""",
)
def label_distribution(t):
    return aggregate.label_distribution(t.labels_long())


@query(
    "rating_histogram",
    f"WITH {REVIEWS} SELECT rating, count(*) AS n, count(DISTINCT product_id) AS n_unique FROM reviews GROUP BY rating",
)
def rating_histogram(t):
    return aggregate.rating_histogram(t.reviews(), "rating", "product_id")


@query("category_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def category_counts(t):
    return aggregate.value_counts(t.events, "event_type")


POINTS = "CASE label WHEN '1' THEN 100.0 WHEN '0' THEN 50.0 WHEN '-1' THEN 0.0 END"


def scores_sql(default: int) -> str:
    return (
        f"WITH {LABELS_LONG} SELECT product_id, aspect, round(coalesce(avg({POINTS}::DOUBLE), {default}.0), 6) AS score "
        "FROM labels_long GROUP BY ALL"
    )


def rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query("aspect_scores_default50", scores_sql(50))
def aspect_scores_default50(t):
    return rounded(aggregate.aspect_scores_long(t.labels_long(), ["product_id"], 50))


@query("aspect_scores_default0", scores_sql(0))
def aspect_scores_default0(t):
    return rounded(aggregate.aspect_scores_long(t.labels_long(), ["product_id"], 0))


WIDE_SCORES = " UNION ALL ".join(
    f"SELECT product_id, {sql_text(a)} AS aspect, round(coalesce(avg(CASE \"{a}\" WHEN '1' THEN 100.0 WHEN '0' THEN 50.0 "
    f"WHEN '-1' THEN 0.0 END::DOUBLE), 50.0), 6) AS score FROM labelled GROUP BY product_id"
    for a in ASPECTS
)


@query("aspect_scores_wide", f"WITH {SIMPLE_LABELLED} {WIDE_SCORES}")
def aspect_scores_wide(t):
    return rounded(aggregate.aspect_scores(rules.rules_simple(t.reviews(), "content"), ["product_id"], ASPECTS))


@query("basic_counts", f"WITH {REVIEWS} SELECT count(*) AS reviews, count(DISTINCT product_id) AS products, count(content) AS with_content FROM reviews")
def basic_counts(t):
    return t.reviews().agg(
        F.count("*").alias("reviews"), F.count_distinct("product_id").alias("products"), F.count("content").alias("with_content")
    )


@query(
    "multi_polarity_count",
    f"WITH parsed AS ({MULTIPOLARITY}) SELECT count(*) FILTER (neg + pos + neu > 1) AS multi_cells, "
    "count(*) FILTER (mention = 1) AS mentions, count(*) AS cells FROM parsed",
)
def multi_polarity_count(t):
    parsed = t.cells().select(L.parse_multipolarity("cell").alias("m"))
    return aggregate.multi_polarity_count(parsed, F.col("m"))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "product_comparison",
    f"WITH {LABELS_LONG}, s AS (SELECT product_id, aspect, round(coalesce(avg({POINTS}::DOUBLE), 50.0), 6) AS score FROM labels_long GROUP BY ALL) "
    "SELECT product_id, " + ", ".join(f"max(score) FILTER (aspect = '{e}') AS {e}" for e in EVENT_TYPES) + " FROM s GROUP BY product_id",
)
def product_comparison(t):
    return aggregate.product_comparison(rounded(aggregate.aspect_scores_long(t.labels_long(), ["product_id"])), "product_id", EVENT_TYPES)


@query(
    "summary_json",
    f"""WITH {LABELS_LONG}, s AS (SELECT product_id, aspect, count(*) FILTER (label = '1') AS p,
  count(*) FILTER (label = '-1') AS n, count(*) FILTER (label = '0') AS u FROM labels_long WHERE label <> '2' GROUP BY ALL)
SELECT product_id, '{{' || string_agg('"' || aspect || '":{{"positive":' || p || ',"negative":' || n || ',"neutral":' || u || '}}', ','
  ORDER BY aspect) || '}}' AS summary FROM s GROUP BY product_id""".replace("{{", "{").replace("}}", "}"),
)
def summary_json(t):
    return aggregate.summary_json(aggregate.aspect_summary_long(t.labels_long(), ["product_id"]), ["product_id"])


@query(
    "sentiment_trend",
    f"""WITH {LABELS_LONG}, w AS (SELECT product_id, time_bucket(INTERVAL 1 DAY, ts) AS d, count(*) AS n,
  count(*) FILTER (label = '-1') AS negatives FROM labels_long WHERE label IN ('1', '0', '-1') GROUP BY ALL),
s AS (SELECT *, negatives / n AS share FROM w)
SELECT product_id, strftime(d, '%Y-%m-%d') AS day, n, negatives, round(share, 6) AS negative_share,
  coalesce(share - lag(share) OVER (PARTITION BY product_id ORDER BY d) >= 0.1, false) AS alert FROM s""",
)
def sentiment_trend(t):
    stamped = t.labels_long().withColumn("ts", F.col("ts").cast("timestamp"))
    return aggregate.sentiment_trend(stamped, "product_id", "ts").select(
        "product_id",
        F.date_format("window_start", "yyyy-MM-dd").alias("day"),
        "n",
        "negatives",
        F.round("negative_share", 6).alias("negative_share"),
        "alert",
    )


# --------------------------------------------------------------------------- dedup

SIGNED = f"""{REVIEWS}, s AS (SELECT review_id, {strip("coalesce(content, '')")} AS content, {signature_sql('content')} AS sig FROM reviews),
r AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY review_id) AS k FROM s)"""


@query("fuzzy_dedup", f"WITH {SIGNED} SELECT review_id, content FROM r WHERE k = 1 AND content <> ''")
def fuzzy_dedup(t):
    return dedup.fuzzy_dedup(t.reviews().select("review_id", "content"), "content", "review_id")


@query(
    "fuzzy_dedup_stats",
    f"WITH {SIGNED} SELECT count(*) AS rows_before, count(*) - count(*) FILTER (k = 1 AND content <> '') AS rows_removed, "
    "count(*) FILTER (k = 1 AND content <> '') AS rows_after FROM r",
)
def fuzzy_dedup_stats(t):
    return dedup.fuzzy_dedup_stats(t.reviews(), "content", "review_id")


@query(
    "merge_keep_last",
    f"""WITH {REVIEWS}, m AS (SELECT 0 AS part, review_id, content, NULL AS rating FROM long_reviews
  UNION ALL SELECT 1, review_id, content, rating FROM short_reviews),
r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY part DESC, review_id DESC) AS k FROM m)
SELECT review_id, content, rating FROM r WHERE k = 1""",
)
def merge_keep_last(t):
    old = t.long_reviews().select("review_id", "content")
    new = t.short_reviews().select("review_id", "content", "rating")
    return dedup.merge_keep_last(old, new, "content", "review_id")


RAW_IDS = f"""{REVIEWS}, raw AS (SELECT review_id AS seq, content,
  CASE WHEN rating = 1 THEN NULL WHEN rating = 2 THEN '' ELSE CAST(review_id // 4 AS VARCHAR) END AS rate_id,
  CASE WHEN rating = 2 THEN '0' ELSE CAST(review_id // 3 AS VARCHAR) END AS id FROM reviews)"""


@query(
    "dedup_by_id",
    f"""WITH {RAW_IDS}, k AS (SELECT seq, content, coalesce(CASE WHEN rate_id NOT IN ('', '0') THEN 'i' || rate_id END,
  CASE WHEN id NOT IN ('', '0') THEN 'i' || id END, 't' || coalesce(content, '')) AS key FROM raw),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM k) SELECT seq, content FROM r WHERE n = 1""",
)
def dedup_by_id(t):
    q = F.floor(F.col("review_id") / 4).cast("bigint").cast("string")
    raw = t.reviews().select(
        F.col("review_id").alias("seq"),
        "content",
        F.when(F.col("rating") == 1, None).when(F.col("rating") == 2, "").otherwise(q).alias("rate_id"),
        F.when(F.col("rating") == 2, "0").otherwise(F.floor(F.col("review_id") / 3).cast("bigint").cast("string")).alias("id"),
    )
    return dedup.dedup_by_id(raw, ["rate_id", "id"], "content", "seq").select("seq", "content")


# The store holds the earlier half of the events; the batch repeats some of them, has rows
# without ids and copies of its own.
STORE = """store AS (SELECT CAST(user_id AS VARCHAR) AS product_id, CAST(event_id AS VARCHAR) AS review_id, event_id AS seq
  FROM events WHERE ts < TIMESTAMP '2024-01-16'),
batch AS (SELECT CAST(user_id AS VARCHAR) AS product_id,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN CAST(event_id - event_id % 3 AS VARCHAR) ELSE CAST(event_id AS VARCHAR) END AS review_id,
  event_id + 1000000000 AS seq FROM events)"""


def store_and_batch(t: Tables):
    e = t.events
    product = F.col("user_id").cast("string").alias("product_id")
    store = e.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).select(
        product, F.col("event_id").cast("string").alias("review_id"), F.col("event_id").alias("seq")
    )
    i = F.col("event_id")
    rid = F.when(i % 5 == 0, None).when(i % 5 == 1, "").when(i % 5 == 2, (i - i % 3).cast("string")).otherwise(i.cast("string"))
    batch = e.select(product, rid.alias("review_id"), (i + 1000000000).alias("seq"))
    return store, batch


@query(
    "upsert_predictions",
    f"""WITH {STORE} SELECT * FROM store UNION ALL SELECT * FROM batch b WHERE b.review_id IS NULL OR b.review_id = ''
  OR NOT EXISTS (SELECT 1 FROM store s WHERE s.product_id = b.product_id AND s.review_id = b.review_id)""",
)
def upsert_predictions(t):
    store, batch = store_and_batch(t)
    return dedup.upsert_predictions(store, batch, "review_id", ["product_id"])


@query(
    "concat_by_name",
    f"WITH {REVIEWS} SELECT review_id, content, rating, NULL AS product_id FROM short_reviews UNION ALL SELECT review_id, content, NULL, product_id FROM long_reviews",
)
def concat_by_name(t):
    return dedup.concat_by_name(t.short_reviews().select("review_id", "content", "rating"), t.long_reviews().select("review_id", "content", "product_id"))


@query(
    "product_upsert",
    """WITH listed AS (SELECT p_partkey AS item_id, p_name AS name, p_retailprice AS price FROM part WHERE p_partkey % 3 = 0),
fresh AS (SELECT p_partkey AS item_id, p_name AS name, p_retailprice AS price FROM part WHERE p_partkey % 2 = 0),
inserted AS (SELECT * FROM listed UNION ALL SELECT * FROM fresh WHERE item_id NOT IN (SELECT item_id FROM listed)),
kept AS (SELECT * FROM inserted WHERE item_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 = 0))
SELECT item_id, name, CASE WHEN item_id % 5 = 0 THEN 1.5 ELSE CAST(price AS DOUBLE) END AS price FROM kept""",
)
def product_upsert(t):
    """Insert if absent, remove, update."""
    p = t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_retailprice").cast("double").alias("price"))
    inserted = dedup.insert_products(p.where("item_id % 3 = 0"), p.where("item_id % 2 = 0"), "item_id", "item_id")
    kept = dedup.remove_products(inserted, p.where("item_id % 7 = 0"), "item_id")
    changes = p.where("item_id % 5 = 0").withColumn("price", F.lit(1.5))
    return dedup.update_products(kept, changes, "item_id", ["price"])


# ------------------------------------------------------------------------ sampling

@query(
    "balanced_sample",
    f"""WITH {REVIEWS}, r AS (SELECT review_id, product_id, rating, row_number() OVER (PARTITION BY product_id, rating ORDER BY review_id) AS k FROM reviews)
SELECT review_id, product_id, rating FROM r WHERE k <= CASE rating WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN 30 WHEN 4 THEN 2 ELSE 8 END""",
)
def balanced_sample(t):
    r = t.reviews().select("review_id", "product_id", "rating")
    return sampling.balanced_sample(r, "product_id", "rating", "review_id", {1: 5, 2: 3, 3: 30, 4: 2}, default=8)


@query(
    "balanced_unique",
    f"""WITH {REVIEWS}, r AS (SELECT *, row_number() OVER (PARTITION BY product_id, rating ORDER BY review_id) AS k,
  CASE WHEN review_id % 3 = 0 THEN '' ELSE CAST(review_id % 40 AS VARCHAR) END AS rate_id FROM reviews),
s AS (SELECT *, CASE WHEN rate_id NOT IN ('', '0') THEN 'i' || rate_id ELSE 't' || coalesce(content, '') END AS key FROM r WHERE k <= 20),
u AS (SELECT *, row_number() OVER (PARTITION BY product_id, key ORDER BY rating, review_id) AS n FROM s) SELECT review_id, product_id, rating FROM u WHERE n = 1""",
)
def balanced_unique(t):
    i = F.col("review_id")
    r = t.reviews().withColumn("rate_id", F.when(i % 3 == 0, "").otherwise((i % 40).cast("string")))
    kept = sampling.balanced_unique(r, "product_id", "rating", "review_id", ["rate_id"], "content", {}, default=20)
    return kept.select("review_id", "product_id", "rating")


@query("hash_sample", "SELECT event_id, event_type FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 500")
def hash_sample(t):
    return sampling.hash_sample(t.events, "event_id", 500).select("event_id", "event_type")


@query("head_limit", f"WITH {REVIEWS} SELECT review_id, content FROM reviews ORDER BY review_id LIMIT 100")
def head_limit(t):
    return sampling.head_limit(t.reviews().select("review_id", "content"), "review_id", 100)


@query("latest_n", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def latest_n(t):
    return sampling.latest_n(t.events.select("event_id", "user_id", "ts"), ["ts", "event_id"], 50).drop("ts")


@query(
    "latest_n_per_product",
    "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50",
)
def latest_n_per_product(t):
    return sampling.latest_n(t.events.select("event_id", "user_id", "ts"), ["ts", "event_id"], 50, ["user_id"]).drop("ts")


UNIT = "substr(md5('42:' || event_id), 1, 8)"
BORDER = format(int(0.8 * 2**32), "08x")


@query("split_counts", f"SELECT CASE WHEN {UNIT} < '{BORDER}' THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM events GROUP BY ALL")
def split_counts(t):
    return aggregate.value_counts(sampling.assign_split(t.events, "event_id"), "split")


@query("kfold_assign", f"SELECT event_id, CAST(CAST('0x' || {UNIT} AS BIGINT) % 5 AS INTEGER) AS fold FROM events")
def kfold_assign(t):
    return sampling.assign_fold(t.events, "event_id").select("event_id", "fold")


@query(
    "file_batches",
    f"WITH {REVIEWS}, f AS (SELECT product_id, dense_rank() OVER (ORDER BY product_id) AS k FROM (SELECT DISTINCT product_id FROM reviews)) "
    "SELECT CAST(ceil(k / 10) AS INTEGER) AS batch, count(*) AS n, count(DISTINCT r.product_id) AS files FROM reviews r JOIN f USING (product_id) GROUP BY ALL",
)
def file_batches(t):
    numbered = sampling.file_batches(t.reviews().select("review_id", "product_id"), "product_id")
    return numbered.groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("product_id").alias("files"))


# --------------------------------------------------------------------------- joins

PRED = """pred AS (SELECT l.doc_id AS review_id, CAST(l.quality AS INTEGER) AS truth, CAST(d.n_chars > 1500 AS INTEGER) AS pred
  FROM labels l JOIN documents d USING (doc_id))"""


def pred_truth(t: Tables):
    pred = t.documents.select(F.col("doc_id").alias("review_id"), (F.col("n_chars") > 1500).cast("int").alias("pred"))
    truth = t.labels.select(F.col("doc_id").alias("review_id"), F.col("quality").cast("int").alias("truth"))
    return relate.join_pred_truth(pred, truth, ["review_id"])


@query("join_pred_truth", f"WITH {PRED} SELECT review_id, pred, truth FROM pred")
def join_pred_truth(t):
    return pred_truth(t)


@query(
    "reattach_product",
    f"WITH {REVIEWS} SELECT review_id, length(coalesce(content, '')) AS score, product_id, rating FROM reviews",
)
def reattach_product(t):
    r = t.reviews()
    scored = r.select("review_id", F.length(F.coalesce("content", F.lit(""))).cast("bigint").alias("score"))
    return relate.reattach(scored, r, "review_id", ["product_id", "rating"])


@query(
    "completeness",
    """WITH e AS (SELECT user_id, count(*) AS expected FROM events GROUP BY ALL),
p AS (SELECT user_id, count(*) AS processed FROM events WHERE event_type <> 'error' AND user_id % 9 <> 0 GROUP BY ALL)
SELECT user_id, coalesce(expected, 0) AS expected, coalesce(processed, 0) AS processed,
  CASE WHEN coalesce(processed, 0) >= coalesce(expected, 0) THEN 'complete' WHEN processed > 0 THEN 'partial' ELSE 'missing' END AS status
FROM e FULL JOIN p USING (user_id)""",
)
def completeness(t):
    e = t.events
    return relate.completeness(e, e.where("event_type <> 'error' AND user_id % 9 <> 0"), "user_id")


@query(
    "training_pairs",
    f"WITH {SIMPLE_LABELLED} SELECT content, \"{ASPECTS[0]}\" AS label FROM labelled WHERE content IS NOT NULL AND \"{ASPECTS[0]}\" <> '2'",
)
def training_pairs(t):
    return project.training_pairs(rules.rules_simple(t.reviews(), "content"), "content", ASPECTS[0])


# ------------------------------------------------------------------------- metrics

CLASSES = """cls AS (SELECT c AS class, count(*) FILTER (truth = c AND pred = c) AS tp, count(*) FILTER (truth = c) AS support,
  count(*) FILTER (pred = c) AS predicted FROM scored, (SELECT DISTINCT truth AS c FROM scored UNION SELECT DISTINCT pred FROM scored) GROUP BY c)"""
F1 = "CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END"


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    "eval_accuracy_f1",
    f"WITH {SCORED}, {CLASSES} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum({F1} * support) / sum(support), 6) AS weighted_f1 FROM cls",
)
def eval_accuracy_f1(t):
    return r6(metrics.accuracy_f1(t.scored(), "truth", "pred"), "accuracy", "weighted_f1")


@query("eval_macro_f1", f"WITH {SCORED}, {CLASSES} SELECT round(avg({F1}), 6) AS macro_f1 FROM cls")
def eval_macro_f1(t):
    return r6(metrics.macro_f1(t.scored(), "truth", "pred"), "macro_f1")


@query(
    "eval_per_aspect",
    f"""WITH {SCORED}, c AS (SELECT aspect, c AS class, count(*) FILTER (truth = c AND pred = c) AS tp, count(*) FILTER (truth = c) AS support,
  count(*) FILTER (pred = c) AS predicted FROM scored, (SELECT unnest([-1, 0, 1, 2]) AS c) GROUP BY ALL)
SELECT aspect, class, tp, support, predicted, round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END, 6) AS precision,
  round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall, round({F1}, 6) AS f1 FROM c WHERE support + predicted > 0""",
)
def eval_per_aspect(t):
    return r6(metrics.class_scores(t.scored(), "truth", "pred", ["aspect"]), "precision", "recall", "f1")


@query(
    "eval_multilabel",
    f"""WITH {SCORED}, m AS (SELECT aspect, count(*) FILTER (truth <> 2 AND pred <> 2) AS tp, count(*) FILTER (truth <> 2) AS support,
  count(*) FILTER (pred <> 2) AS predicted FROM scored GROUP BY aspect),
a AS (SELECT avg({F1}) AS mention_f1 FROM m), {CLASSES},
s AS (SELECT avg({F1}) AS sentiment_f1, sum(tp) / sum(support) AS sentiment_acc FROM cls)
SELECT round(mention_f1, 6) AS mention_f1, round(sentiment_f1, 6) AS sentiment_f1, round(sentiment_acc, 6) AS sentiment_acc,
  round((mention_f1 + sentiment_f1) / 2, 6) AS combined_f1 FROM a, s""",
)
def eval_multilabel(t):
    df = t.scored().withColumns({"tm": (F.col("truth") != 2).cast("int"), "pm": (F.col("pred") != 2).cast("int")})
    out = metrics.multilabel_scores(df, "aspect", "tm", "pm", "truth", "pred")
    return r6(out, "mention_f1", "sentiment_f1", "sentiment_acc", "combined_f1")


HOT = """hot AS (SELECT review_id, CAST(truth <> 2 AS INTEGER) AS m, CAST(truth = -1 OR review_id % 11 = 0 AS INTEGER) AS t1, CAST(truth = 1 OR review_id % 11 = 0 AS INTEGER) AS t2,
  CAST(truth = 0 AS INTEGER) AS t3, CAST(pred = -1 OR review_id % 13 = 0 AS INTEGER) AS p1, CAST(pred = 1 OR review_id % 13 = 0 AS INTEGER) AS p2, CAST(pred = 0 AS INTEGER) AS p3 FROM scored)"""


@query(
    "eval_samples_f1",
    f"""WITH {SCORED}, {HOT}, r AS (SELECT t1 * p1 + t2 * p2 + t3 * p3 AS tp, t1 + t2 + t3 AS t, p1 + p2 + p3 AS p FROM hot WHERE m = 1)
SELECT round(avg(CASE WHEN t + p > 0 THEN 2 * tp / (t + p) ELSE 0 END), 6) AS samples_f1,
  round(2 * sum(tp) / (sum(t) + sum(p)), 6) AS micro_f1, count(*) AS n FROM r""",
)
def eval_samples_f1(t):
    i = F.col("review_id")
    hot = t.scored().select(
        (F.col("truth") != 2).alias("m"),
        *[((F.col(c) == v) | (F.lit(v != 0) & (i % k == 0))).cast("int").alias(f"{n}{j}")
          for c, n, k in (("truth", "t", 11), ("pred", "p", 13)) for j, v in ((1, -1), (2, 1), (3, 0))],
    )
    out = metrics.samples_f1(hot, ["t1", "t2", "t3"], ["p1", "p2", "p3"], F.col("m"))
    return r6(out, "samples_f1", "micro_f1")


FOLD_OF = "CAST(CAST('0x' || substr(md5('42:' || review_id), 1, 8) AS BIGINT) % 5 AS INTEGER)"


@query(
    "kfold_summary",
    f"""WITH {SCORED}, f AS (SELECT {FOLD_OF} AS fold, truth, pred FROM scored),
c AS (SELECT fold, c, count(*) FILTER (truth = c AND pred = c) AS tp, count(*) FILTER (truth = c) AS support,
  count(*) FILTER (pred = c) AS predicted FROM f, (SELECT unnest([-1, 0, 1, 2]) AS c) GROUP BY ALL),
s AS (SELECT fold, avg({F1}) AS f1 FROM c WHERE support + predicted > 0 GROUP BY fold)
SELECT round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1,
  (SELECT fold FROM s ORDER BY f1 DESC, fold LIMIT 1) AS best_fold, round(max(f1), 6) AS best_f1 FROM s""",
)
def kfold_summary(t):
    folds = sampling.assign_fold(t.scored(), "review_id")
    scores = metrics.macro_f1(folds, "truth", "pred", ["fold"]).withColumnRenamed("macro_f1", "combined_f1")
    return r6(metrics.kfold_summary(scores), "mean_f1", "std_f1", "best_f1")


@query(
    "confusion_matrix",
    f"WITH {SCORED} SELECT truth, " + ", ".join(f"count(*) FILTER (pred = {v}) AS \"{v}\"" for v in (-1, 0, 1, 2)) + " FROM scored GROUP BY truth",
)
def confusion_matrix(t):
    return metrics.confusion_matrix(t.scored(), "truth", "pred", [-1, 0, 1, 2])


@query(
    "cohen_kappa",
    f"""WITH {SCORED}, {CLASSES}, k AS (SELECT sum(support) AS n, sum(tp) / sum(support) AS po,
  sum(CAST(support AS DOUBLE) * predicted) / (CAST(sum(support) AS DOUBLE) * sum(support)) AS pe FROM cls)
SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS observed, round((po - pe) / (1 - pe), 6) AS kappa FROM k""",
)
def cohen_kappa(t):
    return r6(metrics.cohen_kappa(t.scored(), "truth", "pred"), "observed", "kappa")


RUNS = """runs AS (SELECT event_type AS model, CAST(epoch(ts) AS BIGINT) // 86400 AS version, round(avg(value) / 1000, 4) AS best_f1
  FROM events GROUP BY ALL)"""


def runs(t: Tables):
    """Daily mean values as a stand-in for the metrics table: model, version, best_f1."""
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).cast("bigint")
    return t.events.groupBy(F.col("event_type").alias("model"), day.alias("version")).agg(
        F.round(F.avg("value") / 1000, 4).alias("best_f1")
    )


@query(
    "promotion_gate",
    f"""WITH RECURSIVE {RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY version) AS k FROM runs),
g AS (SELECT model, version, k, best_f1 AS new_f1, CAST(0.0 AS DOUBLE) AS old_f1, best_f1 - 0.0 >= 0.01 AS should_update FROM o WHERE k = 1
  UNION ALL SELECT o.model, o.version, o.k, o.best_f1, CASE WHEN g.should_update THEN g.new_f1 ELSE g.old_f1 END,
    o.best_f1 - CASE WHEN g.should_update THEN g.new_f1 ELSE g.old_f1 END >= 0.01 FROM g JOIN o ON o.model = g.model AND o.k = g.k + 1)
SELECT model, version, new_f1, old_f1, should_update FROM g""",
)
def promotion_gate(t):
    return metrics.promotion_history(runs(t))


@query(
    "model_comparison",
    f"""WITH {RUNS}, n AS (SELECT model, max_by(best_f1, version) AS new_f1 FROM runs GROUP BY model),
o AS (SELECT model, min_by(best_f1, version) AS old_f1 FROM runs WHERE model <> 'view' GROUP BY model)
SELECT model, coalesce(old_f1, 0.0) AS old_f1, new_f1, new_f1 - coalesce(old_f1, 0.0) >= 0.01 AS should_update FROM n LEFT JOIN o USING (model)""",
)
def model_comparison(t):
    r = runs(t)
    old = r.where("model <> 'view'").groupBy("model").agg(F.min_by("best_f1", "version").alias("best_f1"))
    return metrics.compare_models(old, metrics.latest_models(r))

