"""Corpus pipeline: quality rules, exact and near duplicates, mixing to target weights, BPE encoding.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``; all
but the last return the columns of ``documents``.  ``run`` writes each stage's
rows as Parquet in the shared folder and reads them back for the next one.
Rows with null ids, null texts or repeated rows are treated as the operators
define it; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfscope.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from shelfscope.llm.common import stored, table
from shelfscope.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.accepted(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (3-word shingles, at most 2 differing bits)."""
    return simhash.representatives(docs, shingle=3, bits=2)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, twice where it takes them twice."""
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every row."""
    return bpe.encode(docs, vocabulary("byte_bpe_50k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
                      keys=("doc_id", "lang", "source"))


STAGES = [("quality_rules", quality_stage), ("exact_dedup", exact_stage), ("simhash", near_stage),
          ("mixing", mixing_stage), ("bpe", encoding_stage)]

# fingerprints, balanced sampling and tokens are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
