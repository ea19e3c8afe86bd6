"""The queries of this folder, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from reviewlens.llm import align, chat, decontaminate, jaccard, language, packing, pages, pii, runs, shards, tokens, topk, urls
from reviewlens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "word_bpe_49k.json"
END_ID = 2


def op1_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.filter(~language.is_held_out()))
    out = language.identify(docs, model).withColumn("held_out", F.coalesce(language.is_held_out(), F.lit(False)))
    return out.select("doc_id", "held_out", "lang_pred", "score", "n_spans")


def op2_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_path_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(rows, urls.labels_of_pages(rows, table(spark, sf_dir, "labels")))


def op4_candidate_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), END_ID)


def op6_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"), words=4, percent=85)


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op8_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = f"{chat.END}{chat.START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digest(chat.conversations(chat.fold(chat.log_of(rows))))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), 2048)


def op11_suffix_automaton_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.find_runs(table(spark, sf_dir, "documents"), planted=True, whole=False)


def op12_spill_counted_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), 8)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_language_spans, op2_voronoi_top_k, op3_path_template_tree, op4_candidate_boosted_pii, op5_harmonic_packing, op6_set_relation_join, op7_site_style_tree, op8_event_sourced_chat, op9_benchmark_decontamination, op10_token_counts, op11_suffix_automaton_runs, op12_spill_counted_alignment, op13_differencing_shards, pipeline)}
ORACLES: dict[str, str] = {"op2_voronoi_top_k": topk.SQL, "op6_set_relation_join": jaccard.SQL, "op8_event_sourced_chat": chat.SQL, "op9_benchmark_decontamination": decontaminate.SQL}
