"""Driver tables and the views derived from them.

Every view is a lazy DataFrame over the parquet scan, so Catalyst prunes
columns and pushes filters into the reader.  The derivations are the ones the
correctness oracle repeats in SQL (see ``shelfscope.plans.oracle``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.functions import rules
from shelfscope.functions.pricing import (commission_one_tier, commission_two_tier, discount_pct,
                                          estimated_profit, store_from_sku)
from shelfscope.functions.text import any_substring, clean_summary, round_n, topic_key, url_key

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

NEWS_EPOCH = "2024-01-01 00:00:00"  # start of the derived feed clock (UTC wall clock)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def sku_for(key_col, prefix_every: int = 4):
    """Store-prefixed SKU: every 4th key belongs to store A, the rest to store B."""
    k = F.col(key_col) if isinstance(key_col, str) else key_col
    return F.concat(F.when(k % prefix_every == 0, F.lit(rules.SKU_PREFIX_A))
                    .otherwise(F.lit(rules.SKU_PREFIX_B)), k.cast("string"))


# --------------------------------------------------------------------------- F2
def price_observations(lineitem: DataFrame, key: str = "l_suppkey") -> DataFrame:
    """One price observation per line item, keyed by supplier (default) or part.

    Title / category are blank on some rows so the "last non-blank" rule of the
    daily compaction is exercised.
    """
    sku = sku_for(key)
    return lineitem.select(
        sku.alias("sku"),
        store_from_sku(sku).alias("loja"),
        F.to_date("l_shipdate").alias("data_coleta"),
        round_n(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("preco"),
        F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(
            F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("titulo"),
        F.when(F.col("l_linestatus") == "O", F.lit("")).otherwise(F.col("l_returnflag")).alias("categoria"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("seq1"),
        F.col("l_linenumber").cast("bigint").alias("seq2"),
    )


# --------------------------------------------------------------------------- F1
def offers_catalog(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Current offers: one per part, priced by its latest line item.

    old price = unit list price, current price = unit price after discount,
    seller = supplier (every third supplier is the store itself: 1P).
    Uses the test rule tables because part names are "colour/size + noun".
    """
    latest = (lineitem
              .groupBy("l_partkey")
              .agg(F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice",
                                  "l_quantity", "l_discount", "l_suppkey")).alias("m")))
    sku = sku_for("p_partkey")
    base = (part.join(latest, part.p_partkey == latest.l_partkey, "inner")
            .select(
                F.col("p_partkey").alias("ord"),
                sku.alias("sku"),
                F.col("p_name").alias("nome_produto"),
                store_from_sku(sku).alias("loja"),
                round_n(F.col("m.l_extendedprice") / F.col("m.l_quantity") * (1 - F.col("m.l_discount")), 2)
                .alias("preco_atual"),
                round_n(F.col("m.l_extendedprice") / F.col("m.l_quantity"), 2).alias("preco_antigo"),
                F.col("p_type").alias("categoria"),
                F.when(F.col("m.l_suppkey") % 3 == 0, F.lit(rules.DEFAULT_SELLER))
                .otherwise(F.concat(F.lit("seller"), F.col("m.l_suppkey").cast("string"))).alias("seller_id"),
                F.concat(F.lit("https://img.example.com/p/"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
                .alias("imagem_url"),
                F.concat(F.lit("https://shop.example.com/item/"), F.col("p_partkey").cast("string"))
                .alias("url_afiliado"),
                F.to_date("m.l_shipdate").alias("oferta_dia"),
            ))
    with_rates = base.withColumn("percentual_desconto", discount_pct("preco_antigo", "preco_atual")).withColumn(
        "comissao_percent",
        F.when(F.col("loja") == rules.STORE_A,
               commission_two_tier("categoria", "nome_produto", "seller_id",
                                   table=rules.TEST_COMMISSION_TWO_TIER))
        .otherwise(commission_one_tier("categoria", "nome_produto", table=rules.TEST_COMMISSION_ONE_TIER)))
    out = with_rates.withColumn("lucro_estimado_reais", estimated_profit("preco_atual", "comissao_percent"))
    # P8 banned names, P9 implausible discount, P10 required fields
    out = out.filter(~any_substring(F.lower("nome_produto"), rules.TEST_BANNED_TERMS))
    out = out.filter(F.col("percentual_desconto") <= rules.IMPLAUSIBLE_DISCOUNT_PCT)
    out = out.filter(F.col("sku").isNotNull() & (F.col("nome_produto") != "") & (F.col("preco_atual") > 0))
    return out


# --------------------------------------------------------------------------- F3
def posted_log(events: DataFrame) -> DataFrame:
    """Posted offers: purchases, sku = user id."""
    return (events.filter(F.col("event_type") == "purchase")
            .select(F.col("user_id").cast("string").alias("sku"), F.col("ts").alias("postado_em"),
                    F.col("value").alias("preco_postado")))


def user_offers(events: DataFrame) -> DataFrame:
    """The offer universe of the repeat lock: one offer per user id."""
    return events.select(F.col("user_id").cast("string").alias("sku")).distinct()


# --------------------------------------------------------------------------- F4
def feed_items(documents: DataFrame) -> DataFrame:
    """News items: one per document; published = 2024-01-01 + doc_id minutes."""
    # wall-clock arithmetic on TIMESTAMP_NTZ: independent of the session time zone
    pub = F.timestamp_add("MINUTE", F.col("doc_id"), F.lit(NEWS_EPOCH).cast("timestamp_ntz"))
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/news/"), F.col("doc_id").cast("string"))
    return documents.select(
        "doc_id",
        F.col("source").alias("fonte"),
        F.col("text").alias("titulo"),
        url.alias("url"),
        pub.alias("publicado_em"),
        F.col("lang"),
    ).withColumn("tema_normalizado", topic_key("titulo")).withColumn("url_hash", url_key("url"))


def feed_items_with_summary(documents: DataFrame) -> DataFrame:
    return feed_items(documents).withColumn("resumo", clean_summary("titulo"))


# --------------------------------------------------------------------------- F5
def page_log(pages: DataFrame) -> DataFrame:
    """Fetch log: seq = page_id, store from the host, status 403 injected on one residue class."""
    return pages.select(
        F.when(F.col("url").contains(".example.com"), F.lit(rules.STORE_B))
        .otherwise(F.lit(rules.STORE_A)).alias("loja"),
        "url",
        F.col("page_id").alias("seq"),
        F.when(F.col("page_id") % 10 == 7, F.lit(403)).otherwise(F.lit(200)).alias("status_code"),
        F.when(F.col("page_id") % 10 == 7, F.concat(F.col("html"), F.lit("<div>captcha</div>")))
        .otherwise(F.col("html")).alias("body"),
    )


# --------------------------------------------------------------------------- F6
def social_posts(events: DataFrame) -> DataFrame:
    """Posts: one per (user, hour); click -> likes, signup -> comments, purchase -> shares."""
    # hour of the wall clock, computed on TIMESTAMP_NTZ (no session-zone shift)
    hour = F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:00:00"))
    return (events.groupBy("user_id", hour.alias("created_time"))
            .agg(F.count_if(F.col("event_type") == "click").alias("likes"),
                 F.count_if(F.col("event_type") == "signup").alias("comments"),
                 F.count_if(F.col("event_type") == "purchase").alias("shares"),
                 F.count(F.lit(1)).alias("_n"),
                 # distinct types only: bounded by the type vocabulary, not by a hot user-hour
                 F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("_types"))
            .withColumn("message", F.concat(F.lit("post of user "), F.col("user_id").cast("string"),
                                            F.lit("\n"), F.col("_n").cast("string"), F.lit(" events: "),
                                            F.col("_types")))
            .drop("_types", "_n"))


# --------------------------------------------------------------------------- F7
def run_metrics(events: DataFrame) -> DataFrame:
    """Run telemetry: one run per event date."""
    et = F.col("event_type")
    return (events.groupBy(F.to_date("ts").alias("run_date"))
            .agg(F.count_if(et == "view").alias("raspados_ml"),
                 F.count_if(et == "click").alias("raspados_magalu"),
                 F.count_if(et == "purchase").alias("postados_telegram"),
                 F.count_if(et == "signup").alias("postados_threads"),
                 F.count_if(et == "error").alias("postados_facebook"),
                 F.count_if((et == "purchase") & (F.col("value") > 50)).alias("postados_x"),
                 F.count_distinct("user_id").alias("membros_telegram"),
                 F.max(F.when((et == "signup") & (F.col("value") > 90), F.col("user_id"))).alias("seguidores_facebook"),
                 F.count_distinct(F.when(et == "view", F.col("user_id"))).alias("alcance_fb_28d")))


# --------------------------------------------------------------------------- F8
def sales_ledger(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("platform"),
        (F.col("o_custkey") % 50).alias("clicks"),
        (F.col("o_custkey") % 5).alias("sales"),
        round_n(F.col("o_totalprice") * 0.05, 2).alias("commission"),
        F.col("o_orderstatus").alias("note"),
    )
