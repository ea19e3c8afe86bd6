"""Review-shaped views over the given tables, in Spark and in SQL.

The tables hold no reviews, so each view derives them row by row from a whole table:
document texts with a review phrase appended, and short reviews built from events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.labels import ASPECTS
from reviewlens.plans.session import spread

PHRASES: list[str | None] = [
    "Sản phẩm tuyệt vời! <br> Giao hàng nhanh.",
    "SP đẹpppp   quá!!! ok 😀😀",
    "Áo đẹp nhưng vải hơi mỏng",
    "Tốt",
    "Giày đẹp, ship nhanh",
    "Hàng giả, thất vọng",
    "bình thường",
    "ko đúng mô tả , shop k trả lời...",
    "đóng gói cẩn thận, giao chậm nhưng shop nhiệt tình",
    "giá rẻ mà chất lượng kém; tuy nhiên đổi nhanh",
    "aaaaaaaaaaaaaaaaaaaaaaaaaabcbc",
    "   ",
    "",
    "!!!",
    "Pin hao, máy lag, khó dùng\nkhông hiệu quả",
    "hàng thật auth, mặc dù hộp móp",
    "cũng được, tạm ổn",
    "[Sale] mã giảm 50%_off \\ dc r nha j vs ad",
    '"Đúng hình"\tnhư ảnh… 5 sao ⭐⭐',
    "ok",
    "tạm được nhưng đắt",
    None,
]

# A second phrase for every other short review, chosen by another number.
N = len(PHRASES)


def sql_text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(sql_text(i) for i in items) + "]"


def _phrase(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (index % N + 1).cast("int"))


@dataclass
class Tables:
    """The given tables and the views on them."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def long_reviews(self) -> DataFrame:
        return spread(self.documents).select(
            (F.col("doc_id") * 2).alias("review_id"),
            F.col("source").alias("product_id"),
            (F.col("doc_id") % 5 + 1).cast("int").alias("rating"),
            F.concat(F.col("text"), F.lit(" "), F.coalesce(_phrase(F.col("doc_id")), F.lit(""))).alias("content"),
        )

    def short_reviews(self) -> DataFrame:
        one = _phrase(F.col("event_id"))
        two = _phrase(F.col("user_id") * 7)
        return spread(self.events).select(
            (F.col("event_id") * 2 + 1).alias("review_id"),
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("product_id"),
            (F.col("event_id") % 5 + 1).cast("int").alias("rating"),
            F.when(F.col("event_id") % 2 == 0, one).otherwise(F.concat(one, F.lit(". "), two)).alias("content"),
        )

    def reviews(self) -> DataFrame:
        """review_id (unique, also the order), product_id, rating, content (may be null)."""
        return self.long_reviews().unionByName(self.short_reviews())

    def labels_long(self) -> DataFrame:
        """review_id, product_id, aspect, label, ts: canonical label text per event."""
        v = F.col("value")
        label = (
            F.when(F.col("event_id") % 11 == 0, "[-1,1]")
            .when(v < 100, "-1")
            .when(v < 200, "0")
            .when(v < 300, "1")
            .otherwise("2")
        )
        return self.events.select(
            F.col("event_id").alias("review_id"),
            F.col("user_id").alias("product_id"),
            F.col("event_type").alias("aspect"),
            label.alias("label"),
            "ts",
        )

    def cells(self) -> DataFrame:
        """review_id, cell: label cells as found in sheets, odd ones included."""
        return self.events.select(
            F.col("event_id").alias("review_id"),
            F.element_at(F.array(*[F.lit(c) for c in CELLS]), (F.col("event_id") % len(CELLS) + 1).cast("int")).alias("cell"),
        )

    def scored(self) -> DataFrame:
        """review_id, aspect, truth, pred: two labels in -1, 0, 1, 2 for every event."""

        def cut(v: Column) -> Column:
            return F.when(v < 60, -1).when(v < 120, 0).when(v < 240, 1).otherwise(2)

        v = F.col("value")
        return self.events.select(
            F.col("event_id").alias("review_id"),
            F.col("event_type").alias("aspect"),
            cut(v).alias("truth"),
            cut(v + (F.col("event_id") % 4) * 30 - 30).alias("pred"),
        )

    def labelled_wide(self) -> DataFrame:
        """review_id, file, content and one label column per aspect, for all reviews."""
        choices = F.array(*[F.lit(c) for c in WIDE_LABELS])
        r = self.reviews()
        labels = {
            a: F.element_at(choices, ((F.col("review_id") * (i + 3) + F.col("rating") * i) % len(WIDE_LABELS) + 1).cast("int"))
            for i, a in enumerate(ASPECTS)
        }
        return r.select("review_id", F.col("product_id").alias("file"), "content", *[c.alias(a) for a, c in labels.items()])


CELLS: list[str | None] = [
    None, "2", "", "nan", "-1", "1", "0", "[-1,1]", "-1, 1", "[-1,0,1]", "2,1", "-1,x", "5", "abc", "2.0", "1.0", " 1 ",
]
WIDE_LABELS: list[str | None] = ["2", "1", "-1", "0", "[-1,1]", "2", "2", "1.0", "2", "1", None]


# ------------------------------------------------------------------------ SQL side

_PHR = f"phr AS (SELECT {sql_list(PHRASES)} AS p)"

LONG_REVIEWS = f"""{_PHR},
long_reviews AS (
  SELECT doc_id * 2 AS review_id, source AS product_id, CAST(doc_id % 5 + 1 AS INTEGER) AS rating,
         text || ' ' || coalesce(p[doc_id % {N} + 1], '') AS content
  FROM documents, phr)"""

SHORT_REVIEWS = f"""{_PHR},
short_reviews AS (
  SELECT event_id * 2 + 1 AS review_id, 'u' || CAST(user_id AS VARCHAR) AS product_id,
         CAST(event_id % 5 + 1 AS INTEGER) AS rating,
         CASE WHEN event_id % 2 = 0 THEN p[event_id % {N} + 1]
              ELSE p[event_id % {N} + 1] || '. ' || p[(user_id * 7) % {N} + 1] END AS content
  FROM events, phr)"""

REVIEWS = f"""{LONG_REVIEWS},
{SHORT_REVIEWS[len(_PHR) + 2:]},
reviews AS (SELECT * FROM long_reviews UNION ALL SELECT * FROM short_reviews)"""

LABELS_LONG = """labels_long AS (
  SELECT event_id AS review_id, user_id AS product_id, event_type AS aspect,
         CASE WHEN event_id % 11 = 0 THEN '[-1,1]' WHEN value < 100 THEN '-1' WHEN value < 200 THEN '0'
              WHEN value < 300 THEN '1' ELSE '2' END AS label, ts
  FROM events)"""

CELLS_SQL = f"""cells AS (
  SELECT event_id AS review_id, {sql_list(CELLS)}[event_id % {len(CELLS)} + 1] AS cell FROM events)"""


def _cut(v: str) -> str:
    return f"CASE WHEN {v} < 60 THEN -1 WHEN {v} < 120 THEN 0 WHEN {v} < 240 THEN 1 ELSE 2 END"


SCORED = f"""scored AS (
  SELECT event_id AS review_id, event_type AS aspect, {_cut('value')} AS truth,
         {_cut('(value + (event_id % 4) * 30 - 30)')} AS pred
  FROM events)"""

LABELLED_WIDE = f"""{REVIEWS},
labelled_wide AS (
  SELECT review_id, product_id AS file, content, """ + ", ".join(
    f"{sql_list(WIDE_LABELS)}[(review_id * {i + 3} + rating * {i}) % {len(WIDE_LABELS)} + 1] AS \"{a}\""
    for i, a in enumerate(ASPECTS)
) + """
  FROM reviews)"""
