"""The registered queries of the operators for training data, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimlens.llm import (
    conversation_repair, exact_dedup, html_extract, line_dedup, minhash, mixing, oracles, periodic_runs, permutation_index, pii_crf,
    quality, sentencepiece_bpe, suffix_dedup, token_counts)
from claimlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@register("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_rows(table(spark, sf_dir, "documents"), ["doc_id"], digests=True)


@register("op3_quality_rules", oracles.QUALITY)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op6_minhash")
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents"))


@register("op8_exact_dedup", oracles.EXACT_DEDUP)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", (found.doc_id.eqNullSafe(found.keep_id)).alias("kept"), "text_sha256")


@register("op10_pfair_mixing", oracles.MIXING)
def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_slots(table(spark, sf_dir, "documents"))


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


@register("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_tokens(table(spark, sf_dir, "documents"))


@register("op7_line_dedup", oracles.LINE_DEDUP)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_spread_lines(table(spark, sf_dir, "documents"))


@register("op4_html_extract")
def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@register("op9_pii_crf")
def op9_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.personal_data(table(spark, sf_dir, "documents"))


@register("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


@register("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digests(table(spark, sf_dir, "conversations"))


@register("op11_permutation_index")
def op11_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.every_twentieth(table(spark, sf_dir, "embeddings"))
