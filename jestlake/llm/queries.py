"""Queries of the training-data problems, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from . import bpe, consensus, langid, mixing, neardup, overlap, pairs, sentences, truncation, unify

TOKENIZERS = "/opt/tokenizers"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.label_items(table(spark, sf_dir, "data_llm_eval")).select("item_id", "label")


def p1_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.label_items(table(spark, sf_dir, "data_llm_eval"))


def p1_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.reliability(table(spark, sf_dir, "data_llm_eval"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective(spread(table(spark, sf_dir, "submissions")), table(spark, sf_dir, "rl_df_test"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.same_pairs(spread(table(spark, sf_dir, "combined_jokes_full")), "joke_id", "joke", "joke_id_a", "joke_id_b")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.same_groups(spread(table(spark, sf_dir, "combined_jokes_full")), "joke_id", "joke")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.gather(
        [
            ("combined_jokes_full", spread(table(spark, sf_dir, "combined_jokes_full")), "joke_id", "joke"),
            ("submissions", spread(table(spark, sf_dir, "submissions")), "submission_id", "text"),
            ("documents", spread(table(spark, sf_dir, "documents")), "doc_id", "text"),
        ]
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.found(_labelled(spark, sf_dir))


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_labelled(spark, sf_dir))


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.segments(_labelled(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.found(spread(table(spark, sf_dir, "submissions")))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.report(spread(table(spark, sf_dir, "submissions")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.found(spread(table(spark, sf_dir, "combined_jokes_full")))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.report(spread(table(spark, sf_dir, "combined_jokes_full")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    jokes = unify.same_look_pairs(spread(table(spark, sf_dir, "combined_jokes_full")), "joke_id", "joke")
    heads = unify.same_look_pairs(spread(table(spark, sf_dir, "task_a_zh")), "task_no", "headline")
    return jokes.select(F.lit("combined_jokes_full").alias("src_table"), "*").unionByName(heads.select(F.lit("task_a_zh").alias("src_table"), "*"))


def p7_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    jokes = unify.unify(spread(table(spark, sf_dir, "combined_jokes_full")), "joke_id", "joke").withColumnRenamed("joke_id", "rec_id")
    heads = unify.unify(spread(table(spark, sf_dir, "task_a_zh")), "task_no", "headline").withColumnRenamed("task_no", "rec_id")
    return jokes.select(F.lit("combined_jokes_full").alias("src_table"), "rec_id", "form").unionByName(heads.select(F.lit("task_a_zh").alias("src_table"), "rec_id", "form"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


def p8_ids_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(spread(table(spark, sf_dir, "documents")), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")


def p8_ids_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_by_library(spread(table(spark, sf_dir, "documents")), "doc_id", "text", f"{TOKENIZERS}/word_bpe_49k.json")


def p8_ids_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_by_library(spread(table(spark, sf_dir, "documents")), "doc_id", "text", f"{TOKENIZERS}/piece_bpe_32k.model")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.chosen(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_documents(spread(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """None of these operators can be expressed in SQL over whole tables in good time; tests hold them against brute force."""
    return {}
