"""Social API documents -> posts and insight metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSTS_SCHEMA = ("struct<data: array<struct<id: string, message: string, created_time: string, "
                "likes: struct<summary: struct<total_count: bigint>>, "
                "comments: struct<summary: struct<total_count: bigint>>, shares: struct<count: bigint>>>>")


def posts_from_json(df: DataFrame, col: str = "doc") -> DataFrame:
    """One row per post; missing counters are 0; created_time parsed (UTC)."""
    p = df.select(F.explode(F.from_json(F.col(col), POSTS_SCHEMA).getField("data")).alias("p"))
    ts = F.try_to_timestamp(F.col("p.created_time"), F.lit("yyyy-MM-dd'T'HH:mm:ssZ"))
    return p.select(
        F.col("p.id").alias("post_id"), F.col("p.message").alias("message"),
        F.col("p.created_time").alias("created_raw"),
        F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")).alias("created_time"),
        F.coalesce(F.col("p.likes.summary.total_count"), F.lit(0)).alias("likes"),
        F.coalesce(F.col("p.comments.summary.total_count"), F.lit(0)).alias("comments"),
        F.coalesce(F.col("p.shares.count"), F.lit(0)).alias("shares"))


def display_date(raw) -> F.Column:
    """Dashboard date: first 16 characters with 'T' as a blank."""
    return F.replace(F.substring(F.coalesce(raw, F.lit("")), 1, 16), F.lit("T"), F.lit(" "))


def insights_from_json(df: DataFrame, col: str = "doc", top: int = 5) -> DataFrame:
    """S7 + K5: per metric, the value of the last element of ``values``: a number
    (``valor``) or a map whose top entries by value are kept (``top_entradas``)."""
    v = F.try_parse_json(F.col(col))
    metrics = df.select(F.explode(F.try_variant_get(v, "$.data", "array<variant>")).alias("m"))
    last = F.try_element_at(F.try_variant_get(F.col("m"), "$.values", "array<variant>"), F.lit(-1))
    mp = F.try_variant_get(last, "$.value", "map<string, bigint>")
    entries = F.array_sort(F.map_entries(mp), lambda a, b: F.when(a["value"] > b["value"], -1)
                           .when(a["value"] < b["value"], 1).otherwise(0))
    return metrics.select(
        F.try_variant_get("m", "$.name", "string").alias("metrica"),
        F.try_variant_get("m", "$.title", "string").alias("titulo"),
        F.try_variant_get(last, "$.value", "bigint").alias("valor"),
        F.when(mp.isNotNull(), F.slice(entries, 1, top)).alias("top_entradas"))
