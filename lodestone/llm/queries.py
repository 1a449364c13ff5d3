"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import chat, license_scan, media_audio, mixing, ngram_join, packing, periodic_runs, phrase_fingerprint, quality_classifier, quality_rules, spelling_variants, token_counts, toxicity
from lodestone.llm.shared import table


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_audio.media_digests(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place and length in flat token files that are written from the documents and then scanned."""
    return token_counts.document_tokens(table(spark, sf_dir, "documents"))


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, -7, whose texts are control strings of another template."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], turns.schema)
    return chat.read_back(chat.format_windows(turns.unionByName(extra)))


def op7_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score_quality(docs, quality_classifier.learn(docs, table(spark, sf_dir, "labels")))


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op9_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(table(spark, sf_dir, "documents"))


def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op11_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.document_variants(table(spark, sf_dir, "documents"))


_ALL = (
    op1_mpeg_audio,
    op2_ngram_jaccard,
    op3_best_fit_packing,
    op4_source_mixing,
    op5_separator_scan,
    op6_chat_windows,
    op7_co_training,
    op8_license_diagonals,
    op9_rule_cascade,
    op10_compression_toxicity,
    op11_phrase_fingerprint,
    op12_periodic_runs,
    op13_spelling_variants,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard": ngram_join.ORACLE,
    "op8_license_diagonals": license_scan.oracle(),
    "op9_rule_cascade": quality_rules.ORACLE,
}
