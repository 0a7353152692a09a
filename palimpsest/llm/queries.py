"""The opN_ queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import chat_format, decontaminate, html_extract, jaccard_join, language_id, mixing, secret_scan, suffix_dedup, topk_search
from palimpsest.llm.oracle import ORACLE_SQL as ORACLE_SQL
from palimpsest.llm.substring_dedup import dedup_substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_digest(chat_format.with_control_conversation(_table(spark, sf_dir, "conversations")))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search_digest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_suffixes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_digest(_table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_chat_format, op3_topk_search, op4_ngram_jaccard_join, op5_html_extract, op6_suffix_dedup, op7_language_id, op8_mix_sources, op9_substring_dedup, op10_decontaminate)}
