"""Corpus pipeline: stages that each take the documents the stage before kept.

Every stage but the last returns the columns of documents; the last returns the mix, a row for each document with the
words taken of it. What a stage returns is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import compression_rules, decontaminate, mixing, secret_scan, simhash_dedup
from panelwright.llm.queries import quality_limits, table
from panelwright.llm.shared import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with low limits fitted to the folder's labels, if any.

    Null and short texts go. Rows keep their own columns, as in all stages.
    """
    return compression_rules.kept_rows(docs, rules=quality_limits(spark, docs, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; of equal rows one, of rows without id the last."""
    return simhash_dedup.one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text; null and empty texts stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; null and empty texts stay."""
    return secret_scan.mask_secrets(docs, secret_scan.train(words=secret_scan.corpus_words(docs)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, and its training positions, in the order of the first of them.

    A row for each row of docs, repeated ones too; null texts take nothing, null sources are one. No documents, no rows.
    """
    return mixing.in_order(mixing.mixed(docs))


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing to target weights", mix),
]

#: Compression ratios, fingerprints and the forest are beyond SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
