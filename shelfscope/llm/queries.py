"""Registered queries of the training-data operators: each applies its operator
to the whole table with production settings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import (bpe, conversations, cotrain, exact_dedup, lattice_lm, mixing, oracle,
                            packing, quality_rules, simhash, suffix_dedup, toxicity, warc, whitening)
from shelfscope.llm.common import table
from shelfscope.session import checkpoint_dir


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_archives(spark, path))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"), shingle=3, bits=2).select(
        "doc_id", "fingerprint", "component_id")


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                      outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it does not fit a long (from about 1e8 vectors)."""
    return (whitening.whiten(table(spark, sf_dir, "embeddings"), vector="embedding", keys=("vec_id",), components=16)
            .withColumn("deviation", F.col("deviation").try_cast("long")))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), length=2048, end=1)


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with damage by ``crc32("conv_id:turn") % 20``: 0 marks the row ``gone``, 1 empties its
    text, 2 removes its sentence marks, 3 repeats it, 4 makes it a user's.  Nulls become one space."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.col("kind")
    text = F.coalesce("text", F.lit(" "))
    return (rows.select("conv_id", "turn", "role", "text", (F.crc32(name.cast("binary")) % 20).alias("kind"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))))
            .select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
                    F.when(kind.isin(0, 1), F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
                    .otherwise(text).alias("text"), (kind == 0).alias("gone")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(damaged(table(spark, sf_dir, "conversations")), absent=F.col("gone"))


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_quality_rules, op3_exact_dedup, op4_suffix_dedup, op5_toxicity,
                                    op6_simhash, op7_lattice_lm, op8_bpe, op9_cotraining, op10_mixing,
                                    op11_whitening, op12_packing, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return oracle.build()
