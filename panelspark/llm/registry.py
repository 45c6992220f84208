"""Registered queries of the training-data operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, filter_audit, id_files, line_dedup, main_text, near_dedup, packing, quality_classifier, quality_rules, sentence_pieces, suffix_dedup, token_counts, whitening
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(audio.stored_media(table(spark, sf_dir, "documents")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.scored(table(spark, sf_dir, "documents"))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.piece_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.written_and_read(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.without_repeats(table(spark, sf_dir, "documents")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_telephony_audio, op2_token_counts, op3_line_dedup, op4_quality_rules, op5_sentence_pieces, op6_token_id_files, op7_main_text, op8_quality_classifier, op9_best_fit_packing, op10_minhash_near_dedup, op11_suffix_dedup, op12_filter_audit, op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.oracle(), "op11_suffix_dedup": suffix_dedup.oracle(), "op12_filter_audit": filter_audit.oracle()}
