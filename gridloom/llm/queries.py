"""Registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import (
    chat, decontaminate, divergence, fingerprint, fixity, hosts, line_dedup, mixing, near_dup, phrases, pii, quality, secrets,
)
from gridloom.llm.common import table
from gridloom.llm.sql import TEXTS

c = F.col


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_lines", "n_removed_words", F.sha2("cleaned_text", 256).alias("cleaned_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed_lines", "removed", F.sha2("deduped_text", 256).alias("deduped_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with faults at places that follow from the url: some pages lost, some with a changed byte."""
    draw = F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 2)
    flipped = F.concat(F.lit("?"), F.substring("html", 2, 2147483647))
    return pages.where(draw != "a7").select("page_id", "url", F.when(draw.isin("0b", "0c"), flipped).otherwise(c("html")).alias("html"))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return fixity.fixity_report(pages, damaged(pages))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.url_verdicts(table(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), fingerprint.as_text(c("sketch")).alias("fingerprint"),
        fingerprint.as_text(c("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", "n_distinct", "kept_share")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def all_queries():
    jobs = [op1_quality_rules, op2_line_dedup, op3_mixing, op4_decontaminate, op5_near_dup, op6_chat_format, op7_pii,
            op8_warc_fixity, op9_secrets, op10_url_filter, op11_source_divergence, op12_fingerprints, op13_phrases, pipeline]
    return {job.__name__: job for job in jobs}, TEXTS
