"""Radar golden cases (daily compaction, warm-up, strict minimum, median vs spike)."""

import datetime as dt

from pyspark.sql import functions as F

from shelfscope.functions.pricing import quality_score
from shelfscope.operators import radar

OBS_SCHEMA = ("sku string, loja string, data_coleta date, preco double, titulo string, categoria string, "
              "ts timestamp_ntz, seq1 long, seq2 long")
D = dt.date.fromisoformat


def _obs(spark, rows):
    out = []
    for i, (sku, day, price, *title) in enumerate(rows):
        d = D(day)
        out.append((sku, "Mercado Livre" if sku.startswith("ML_") else "Magalu", d, float(price),
                    title[0] if title else "", "", dt.datetime(d.year, d.month, d.day, 10, 0) + dt.timedelta(
                        minutes=i), i, 0))
    return spark.createDataFrame(out, OBS_SCHEMA)


def _run(spark, history_rows, offers, day="2026-11-25"):
    hist = radar.daily_compaction(_obs(spark, history_rows))
    off = spark.createDataFrame([(s, "Mercado Livre" if s.startswith("ML_") else "Magalu", D(day), float(p))
                                 for s, p in offers], "sku string, loja string, oferta_dia date, preco_atual double")
    res = radar.radar_flags(radar.trailing_stats(off, hist, offer_keys=()))
    return {r["sku"]: r for r in res.collect()}


def test_daily_min_last_and_nonblank_title(spark):
    rows = [("ML_A", "2026-11-25", 250.0, "Mouse Gamer"), ("ML_A", "2026-11-25", 199.90, ""),
            ("ML_A", "2026-11-25", 279.00, "")]
    r = radar.daily_compaction(_obs(spark, rows)).collect()[0]
    assert (r["preco_min_dia"], r["preco_ultimo"], r["titulo"]) == (199.90, 279.00, "Mouse Gamer")


def test_median_resists_spike(spark):
    rows = [("MAGALU_P", f"2026-11-{d}", p) for d, p in zip(range(20, 25), [200, 200, 200, 200, 800])]
    hist = radar.daily_compaction(_obs(spark, rows))
    off = spark.createDataFrame([("MAGALU_P", "Magalu", D("2026-11-25"), 100.0)],
                                "sku string, loja string, oferta_dia date, preco_atual double")
    r = radar.trailing_stats(off, hist, offer_keys=()).collect()[0]
    assert (r["dias_observados"], r["min_180d"], r["mediana_180d"], r["media_180d"]) == (5, 200.0, 200.0, 320.0)


def test_warmup_too_short(spark):
    rows = [("ML_W", f"2026-11-{d}", 300.0) for d in (21, 22, 23, 24)]
    r = _run(spark, rows, [("ML_W", 199.90)])["ML_W"]
    assert r["menor_preco_historico"] is False
    assert r["preco_medio_historico"] == 300.0
    assert r["queda_real_percent"] == 33.4


def test_warmup_met_strict_minimum_and_score(spark):
    rows = ([("ML_MIN", f"2026-11-{d}", 300.0) for d in range(20, 25)]
            + [("ML_EQ", f"2026-11-{d}", 300.0) for d in range(20, 25)])
    res = _run(spark, rows, [("ML_MIN", 240.0), ("ML_EQ", 300.0)])
    assert res["ML_MIN"]["menor_preco_historico"] is True
    assert res["ML_MIN"]["queda_real_percent"] == 20.0
    assert res["ML_EQ"]["menor_preco_historico"] is False
    df = spark.createDataFrame([(True, 20.0, 240.0), (False, 0.0, 300.0)],
                               "m boolean, q double, p double")
    s = [r[0] for r in df.select(quality_score("m", "q", F.lit(20.0), F.lit(15.0), "p")).collect()]
    assert s[0] - s[1] == 75.0


def test_false_spike(spark):
    rows = [("MAGALU_S", f"2026-11-{d}", p) for d, p in zip(range(20, 25), [200, 200, 200, 200, 900])]
    r = _run(spark, rows, [("MAGALU_S", 210.0)])["MAGALU_S"]
    assert (r["preco_medio_historico"], r["queda_real_percent"], r["menor_preco_historico"]) == (200.0, 0.0, False)


def test_same_day_rerun_reads_before_write(spark):
    base = [("ML_O", f"2026-11-{d}", 300.0) for d in range(20, 25)]
    r1 = _run(spark, base, [("ML_O", 250.0)])["ML_O"]
    assert r1["menor_preco_historico"] is True
    # the first run's observation is written; the second run of the same day excludes today
    after = base + [("ML_O", "2026-11-25", 250.0)]
    r2 = _run(spark, after, [("ML_O", 240.0)])["ML_O"]
    assert r2["menor_preco_historico"] is True
    day = radar.daily_compaction(_obs(spark, after + [("ML_O", "2026-11-25", 240.0)])).filter(
        F.col("data_coleta") == D("2026-11-25")).collect()[0]
    assert (day["preco_min_dia"], day["preco_ultimo"]) == (240.0, 240.0)


def test_backfill_equals_snapshot(spark):
    rows = [("ML_B", f"2026-{m:02d}-{d:02d}", 100 + (m * d) % 37) for m in (1, 3, 5, 7) for d in (1, 9, 17, 25)]
    hist = radar.daily_compaction(_obs(spark, rows))
    back = {r["data_coleta"]: r for r in radar.radar_backfill(hist).collect()}
    offers = hist.select("sku", "loja", F.col("data_coleta").alias("oferta_dia"),
                         F.col("preco_min_dia").alias("preco_atual"))
    snap = radar.radar_flags(radar.trailing_stats(offers, hist, offer_keys=())).collect()
    for r in snap:
        b = back[r["oferta_dia"]]
        assert (b["mediana_180d"], b["min_180d"], b["dias_observados"], b["queda_real_percent"]) == (
            r["mediana_180d"], r["min_180d"], r["dias_observados"], r["queda_real_percent"])
