"""From raw documents to a training mix: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returns_risk.llm import decontaminate, mixing, near_dedup, quality, secrets
from returns_risk.llm.common import table
from returns_risk.sources.store import write_once


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (five-word shingles, 0.8 or more) the smallest id stays."""
    return near_dedup.one_of_each(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    return secrets.redacted(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words from, with these numbers: doc_id, source, size, source_size, target, taken."""
    return mixing.mix(docs).where(F.col("taken") > 0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing_sources),
]

#: Trained models and MinHash have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in order, each written and read again but the last.

    Documents without text or words fail the quality rules. Repeated rows, like copies, become one. Rows without an id go
    through like others; of a group that has ids, one with an id stays. A null language or source is one of its own. Texts of
    any length are read as a whole. Columns besides those of ``documents`` are kept up to the last stage, whatever their
    names. Empty tables give no rows; without labels or benchmark the stages that read them only use their fixed rules.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
