"""Maintenance golden cases: upsert re-run safety, retention + guard, legacy JSON."""

import datetime as dt
import json
import tempfile

from pyspark.sql import functions as F

from shelfscope.operators import maintenance as Mt

OBS = "sku string, loja string, data_coleta date, preco double, titulo string, categoria string, " \
      "ts timestamp_ntz, seq1 long, seq2 long"


def _obs(spark, rows):
    return spark.createDataFrame([(s, "", dt.date.fromisoformat(d), p, t, "", dt.datetime.fromisoformat(ts), i, 0)
                                  for i, (s, d, p, t, ts) in enumerate(rows)], OBS)


def test_upsert_rerun_and_min_never_rises(spark):
    path = tempfile.mkdtemp(prefix="shelfscope-test-hist-") + "/hist"
    first = _obs(spark, [("ML_1", "2026-11-25", 250.0, "SSD", "2026-11-25T10:00:00"),
                         ("MAGALU_2", "2026-10-01", 99.9, "Mouse", "2026-10-01T10:00:00")])
    Mt.upsert_price_days(spark, path, first)
    Mt.upsert_price_days(spark, path, first)  # same batch again: no change
    second = _obs(spark, [("ML_1", "2026-11-25", 260.0, "", "2026-11-25T09:00:00")])
    Mt.upsert_price_days(spark, path, second)
    rows = {(r["sku"], str(r["data_coleta"])): r for r in spark.read.parquet(path).collect()}
    assert len(rows) == 2
    r = rows[("ML_1", "2026-11-25")]
    assert (r["preco_min_dia"], r["preco_ultimo"], r["titulo"], r["loja"]) == (250.0, 260.0, "SSD", "Mercado Livre")
    assert rows[("MAGALU_2", "2026-10-01")]["loja"] == "Magalu"


def test_retention_and_guard(spark):
    rows = [(f"ML_{i}", "2026-01-01", 10.0 + i, "", "2026-01-01T00:00:00") for i in range(10)] + \
           [("ML_a", "2026-11-20", 5.0, "", "2026-11-20T00:00:00"), ("ML_b", "2026-11-24", 6.0, "", "2026-11-24T00:00:00")]
    path = tempfile.mkdtemp(prefix="shelfscope-test-ret-") + "/hist"
    Mt.upsert_price_days(spark, path, _obs(spark, rows))
    removed = Mt.purge_price_history(spark, path, "2026-11-25", 180)
    left = spark.read.parquet(path).count()
    assert (removed, left) == (10, 2)
    # again: nothing is left to remove; the boundary month alone, then a month without any row left
    assert Mt.purge_price_history(spark, path, "2026-11-25", 180) == 0
    assert Mt.purge_price_history(spark, path, "2026-11-25", 3) == 1
    assert [r["sku"] for r in spark.read.parquet(path).collect()] == ["ML_b"]
    assert Mt.purge_price_history(spark, path, "2026-11-25", 0) == 1
    assert Mt.purge_price_history(spark, path, "2026-11-25", 0) == 0
    df = spark.createDataFrame([(12, 2, 10), (20, 10, 0)], "b long, c long, j long")
    g = [tuple(r[0])[:2] for r in df.select(Mt.row_loss_guard(F.col("b"), F.col("c"), F.col("j"))).collect()]
    assert g[0] == (True, "ok")
    assert g[1][0] is False and g[1][1].startswith("queda_anomala_linhas")


def test_legacy_json_migration_is_idempotent(spark):
    prices = json.dumps({"ML_MLB999": {"min": 149, "avg": 160, "last": 165, "updated": "2026-11-20T10:00:00"},
                         "MAGALU_1": {"min": 0, "avg": 50}, "ML_X": {}})
    posts = json.dumps({"ML_MLB999": "2026-11-25T10:00:00", "MAGALU_1": "not-a-date"})
    docs = spark.createDataFrame([(prices, posts)], "p string, q string")
    obs = Mt.legacy_price_observations(docs, "p", "2026-11-25").collect()
    got = {r["sku"]: (r["loja"], r["preco"], r["preco_min_inicial"], str(r["data_coleta"])) for r in obs}
    assert got["ML_MLB999"] == ("Mercado Livre", 165.0, 149.0, "2026-11-20")
    assert got["MAGALU_1"] == ("Magalu", 50.0, 50.0, "2026-11-25")
    assert "ML_X" not in got
    p = Mt.legacy_posts(docs, "q").collect()
    assert [(r["sku"], r["canal_resumo"]) for r in p] == [("ML_MLB999", "legado_json")]
    path = tempfile.mkdtemp(prefix="shelfscope-test-post-") + "/posted"
    assert Mt.append_posts(spark, path, Mt.legacy_posts(docs, "q")) == 1
    assert Mt.append_posts(spark, path, Mt.legacy_posts(docs, "q")) == 0


def test_metadata_last_write_wins(spark):
    kv = spark.createDataFrame([("k", "1", dt.datetime(2026, 1, 1)), ("k", "2", dt.datetime(2026, 1, 2))],
                               "chave string, valor string, atualizado_em timestamp_ntz")
    assert Mt.metadata_get(kv, "k").first()["valor"] == "2"
    assert Mt.metadata_get(kv, "absent", "0").first()["valor"] == "0"


def test_upsert_reads_only_the_touched_months(spark):
    path = tempfile.mkdtemp(prefix="shelfscope-test-months-") + "/hist"
    Mt.upsert_price_days(spark, path, _obs(spark, [
        ("ML_a", "2026-09-10", 5.0, "", "2026-09-10T00:00:00"), ("ML_a", "2026-10-10", 6.0, "", "2026-10-10T00:00:00")]))
    hist = spark.read.schema(Mt.HISTORY_SCHEMA + ", mes string").parquet(path)
    touched = spark.createDataFrame([("2026-10",)], "mes string")
    pruned = Mt.in_months(hist, touched)
    assert [r["mes"] for r in pruned.collect()] == ["2026-10"]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "2026-10" in plan[plan.index("PartitionFilters"):]
