"""A training-corpus pipeline over ``documents``: five stages, each applied to all rows that the
one before it kept.

1. ``quality``: documents that the classifier rejects go.
2. ``near_dups``: one document of each near-duplicate class stays.
3. ``decontamination``: documents that hold benchmark passages go.
4. ``secrets``: secrets in the texts are replaced by a mark.
5. ``tokens``: every text becomes token ids (and the text decoded from them).

Between stages the rows are written as Parquet below the shared checkpoint folder and read again.
Any column may hold nulls; a null text is kept as the stages' own contracts say.  An empty table
goes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm import decontaminate, near_dups, quality, registry, secret_scan, tokens
from relspark.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores at least ``quality.THRESHOLD``; learned from ``labels``."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: that of the smallest ``doc_id``."""
    return near_dups.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by ``benchmark``."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in ``text`` replaced by ``secret_scan.MARK`` and ``n_chars`` counted again."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded`` of every row."""
    coded = tokens.encode(docs, registry.vocabulary_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", quality_stage),
    ("near_dups", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]

ORACLE_SQL = None  # scores and signatures are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
