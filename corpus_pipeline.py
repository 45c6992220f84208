"""Corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

Rows that the base rule, the rules' posterior or the classifier reject go; repeated line runs go from later copies; of
each near-duplicate group one row stays; the rest is packed into sequences.

Defined results: rows are judged one by one, whatever they share. Null and empty texts fail the base rule and go in the
first stage; a stage that is given them alone keeps them, but for the classifier, which scores them as any text. Of rows
that repeat doc_id and text one stays. Very long texts are taken whole. An empty table gives an empty table. All but the
last stage return the columns of their input in order, whatever their names; n_chars, where it is there, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import line_dedup, near_dedup, packing, quality_classifier, quality_rules
from panelspark.llm.registry import tokenizer
from panelspark.llm.shared import stored, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.kept_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("line_dedup", lines), ("minhash_near_dedup", near), ("best_fit_packing", packing_plan)]

#: The rules' and the classifier's fits are iterative: no SQL. tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
