"""Price radar: daily compaction, trailing 180-day statistics, real-drop flags.

Scale notes
* ``daily_compaction`` is a single hash aggregate on (sku, store, day) with
  partial (map-side) aggregation: min / max(struct) combine before the
  shuffle, so a hot SKU costs one partial row per task, not its raw rows.
* After compaction a (sku, store) key holds at most one row per day, so every
  later per-key step (range join, window frame, percentile) is bounded by the
  number of days, never by the number of raw observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions import rules
from shelfscope.functions.text import py_strip, round_n
from shelfscope.functions.pricing import store_from_sku

KEY = ["sku", "loja"]


def admit_observations(obs: DataFrame) -> DataFrame:
    """Trim sku, default store from prefix, round price, drop blank sku / bad price."""
    sku = py_strip(F.col("sku").cast("string"))
    loja = py_strip(F.coalesce(F.col("loja"), F.lit("")))
    price = round_n(F.col("preco").try_cast("double"), 2)
    out = (obs.withColumn("sku", sku)
           .withColumn("loja", F.when(loja == "", store_from_sku(sku)).otherwise(loja))
           .withColumn("preco", price))
    if "preco_min_inicial" in obs.columns:
        init = round_n(F.col("preco_min_inicial").try_cast("double"), 2)
        out = out.withColumn("preco_min", F.when(init > 0, F.least("preco", init)).otherwise(F.col("preco")))
    else:
        out = out.withColumn("preco_min", F.col("preco"))
    return out.filter((F.col("sku") != "") & (F.col("preco") > 0))


def daily_compaction(obs: DataFrame) -> DataFrame:
    """A2/M1: per (sku, store, day) the minimum price, the last price, the last
    non-blank title and category, and the last update time.

    "Last" is ordered by (ts, seq1, seq2); the ordinal columns make re-runs and
    ties deterministic.  Input columns: sku, loja, data_coleta, preco,
    [preco_min], titulo, categoria, ts, seq1, seq2.
    """
    pmin = F.col("preco_min") if "preco_min" in obs.columns else F.col("preco")
    # an optional write-batch ordinal sorts first: a later upsert batch wins
    # "last" regardless of its timestamps, as in an upsert-on-conflict table
    order = ([F.col("batch")] if "batch" in obs.columns else []) + [F.col("ts"), F.col("seq1"), F.col("seq2")]
    t, c = F.coalesce(F.col("titulo"), F.lit("")), F.coalesce(F.col("categoria"), F.lit(""))
    last = F.max(F.struct(*order, F.col("preco").alias("v")))
    return (obs.groupBy("sku", "loja", "data_coleta")
            .agg(F.min(pmin).alias("preco_min_dia"),
                 last.getField("v").alias("preco_ultimo"),
                 F.coalesce(F.max(F.when(t != "", F.struct(*order, t.alias("v")))).getField("v"),
                            F.lit("")).alias("titulo"),
                 F.coalesce(F.max(F.when(c != "", F.struct(*order, c.alias("v")))).getField("v"),
                            F.lit("")).alias("categoria"),
                 last.getField("ts").alias("atualizado_em")))


def offers_on_or_after(history: DataFrame, ref_dates: list[str]) -> DataFrame:
    """Offer of a reference date: each key's first daily price on or after it."""
    day = F.struct("data_coleta", "preco_min_dia")
    # one aggregate a date over a single scan: no history row is repeated per date
    per_date = F.array(*[F.struct(F.lit(d).cast("date").alias("ref_date"),
                                  F.min(F.when(F.col("data_coleta") >= F.lit(d).cast("date"), day)).alias("m"))
                         for d in ref_dates])
    first = history.groupBy(*KEY).agg(per_date.alias("dates")).select(*KEY, F.inline("dates"))
    return first.filter(F.col("m").isNotNull()).select(
        "ref_date", *KEY, F.col("m.data_coleta").alias("oferta_dia"), F.col("m.preco_min_dia").alias("preco_atual"))


def trailing_stats(offers: DataFrame, history: DataFrame, days: int = rules.HISTORY_DAYS,
                   offer_keys=("ref_date",)) -> DataFrame:
    """A1 + J1 read phase: per offer, stats of its key's history in
    [offer_day - days, offer_day], the offer day itself excluded, prices > 0.

    A range join on the equi-key (sku, store) plus a day-range predicate: each
    offer meets at most ``days`` compacted rows, whatever the raw volume.
    """
    h = history.select(F.col("sku").alias("h_sku"), F.col("loja").alias("h_loja"),
                       F.col("data_coleta").alias("h_day"), F.col("preco_min_dia").alias("h_p")
                       ).filter(F.col("h_p") > 0)
    cond = ((F.col("sku") == F.col("h_sku")) & (F.col("loja") == F.col("h_loja"))
            & (F.col("h_day") >= F.date_sub("oferta_dia", days)) & (F.col("h_day") <= F.col("oferta_dia"))
            & (F.col("h_day") != F.col("oferta_dia")))
    joined = offers.join(h, cond, "left")
    keys = [*offer_keys, *KEY, "oferta_dia", "preco_atual"]
    cents = cents_of(F.col("h_p"))
    return (joined.groupBy(*keys)
            .agg(round_n(F.min("h_p"), 2).alias("min_180d"),
                 round_n(F.percentile(cents, 0.5) / 100.0, 2).alias("mediana_180d"),
                 round_n(F.sum(cents).cast("double") / F.count(cents) / 100.0, 2).alias("media_180d"),
                 F.count("h_p").alias("dias_observados")))


def cents_of(price):
    """Prices carry 2 decimals; median and mean are taken over exact integer
    cents so the result does not depend on summation order across tasks."""
    return F.floor(price * 100.0 + 0.5).cast("bigint")


def radar_flags(stats: DataFrame, warmup: int = rules.WARMUP_DAYS) -> DataFrame:
    """J1 decision: drop % vs the rounded median, strict minimum after warm-up."""
    p, med, mn = F.col("preco_atual"), F.col("mediana_180d"), F.col("min_180d")
    valid = (p > 0)
    drop = F.when(valid & med.isNotNull() & (med > 0) & (med > p), round_n((med - p) / med * 100.0, 1)
                  ).otherwise(F.lit(0.0))
    is_min = valid & (F.col("dias_observados") >= warmup) & mn.isNotNull() & (p < mn)
    ref = F.when(valid & med.isNotNull() & (med > 0), med).otherwise(F.lit(0.0))
    return (stats.withColumn("queda_real_percent", drop)
            .withColumn("menor_preco_historico", F.coalesce(is_min, F.lit(False)))
            .withColumn("preco_medio_historico", ref))


def price_radar(history: DataFrame, ref_dates: list[str], days: int = rules.HISTORY_DAYS) -> DataFrame:
    offers = offers_on_or_after(history, ref_dates)
    return radar_flags(trailing_stats(offers, history, days))


def radar_counters(radar: DataFrame, by=("ref_date",)) -> DataFrame:
    """A3: number of minima and of drops >= 5 % per run."""
    return (radar.groupBy(*by)
            .agg(F.count_if("menor_preco_historico").alias("qtd_minimas"),
                 F.count_if(F.col("queda_real_percent") >= rules.DROP_ALERT_PCT).alias("qtd_quedas"),
                 F.count("*").alias("qtd_ofertas")))


def radar_backfill(history: DataFrame, days: int = rules.HISTORY_DAYS) -> DataFrame:
    """J1 for every (sku, store, day) at once: trailing window over day numbers.

    The frame is ``rangeBetween(-days, -1)`` on the epoch-day, i.e. the same
    window as the snapshot radar with the current day excluded.  A partition
    is one (sku, store) key and holds at most one row per day.
    """
    dn = F.datediff("data_coleta", F.lit("1970-01-01"))
    w = Window.partitionBy(*KEY).orderBy(dn).rangeBetween(-days, -1)
    p = F.when(F.col("preco_min_dia") > 0, F.col("preco_min_dia"))
    c = cents_of(p)
    stats = history.select(*KEY, "data_coleta", F.col("preco_min_dia").alias("preco_atual"),
                           round_n(F.min(p).over(w), 2).alias("min_180d"),
                           round_n(F.percentile(c, 0.5).over(w) / 100.0, 2).alias("mediana_180d"),
                           round_n(F.sum(c).over(w).cast("double") / F.count(c).over(w) / 100.0, 2)
                           .alias("media_180d"),
                           F.count(p).over(w).alias("dias_observados"))
    return radar_flags(stats)
