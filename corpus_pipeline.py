"""Corpus preparation: language, near duplicates, benchmark text, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again before the
next. All but the last return the columns of ``documents``. A stage reads the whole of what the one before
it kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import decontaminate, jaccard, language, packing, pii
from reviewlens.llm.common import removed, saved, table
from reviewlens.llm.queries import END_ID, VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5
NEAR_WORDS, NEAR_PERCENT = 5, 80  # near copies: shingles of so many words, so much in common


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or of whose letters less than half are of their best language.

    The model learns from the documents' own labels, as in the query; a kept document stays as it is.
    """
    model = language.learn(docs.filter(~language.is_held_out()))
    found = language.identify(docs.select("doc_id", F.struct(*COLUMNS).alias("row")), model, text="row.text", keep=("row",))
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links tie together the row with the smallest doc_id stays. Rows with a doc_id in common but
    different texts are different rows. Rows without doc_id all stay."""
    return jaccard.one_of_each(docs.select(*COLUMNS), NEAR_WORDS, NEAR_PERCENT)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a window of a benchmark item."""
    found = decontaminate.decontaminate(docs.select("doc_id", F.struct(*COLUMNS).alias("row"), "text"), table(spark, sf_dir, "benchmark"), keep=("row",))
    return found.filter(~F.col("contaminated")).select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span is put as its kind in brackets; n_chars follows the text. All documents stay."""
    found = pii.find(docs.select("doc_id", F.struct(*COLUMNS).alias("row"), "text"), keep=("row",))
    kind = "array<struct<at:int,stop:int,kind:string>>"
    spans = F.concat(*(F.transform(F.concat(f"base_{k}", f"added_{k}"), lambda s: F.struct(s["at"].alias("at"), s["stop"].alias("stop"), F.lit(k).alias("kind"))).cast(kind) for k in pii.KINDS))
    out = found.select("row.*", spans.alias("spans"))
    out = out.withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    changed = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences, without ids."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), END_ID)


STAGES: list[tuple[str, Stage]] = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("benchmark", drop_benchmark_text),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]
# Learned languages, boosted trees and token ids have no SQL; a test holds run() on the smallest tables against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            removed(before)
        before = docs
    return docs
