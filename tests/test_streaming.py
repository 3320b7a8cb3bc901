"""Streaming jobs against their batch counterparts (availableNow triggers)."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import maintenance as Mt
from shelfscope.operators import metrics as Mx
from shelfscope.operators import radar
from shelfscope.sources import tables as T
from shelfscope.sources.batches import BatchManifest
from shelfscope.streaming import lock as L
from shelfscope.streaming import streams as St

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _ckpt(name):
    return tempfile.mkdtemp(prefix=f"shelfscope-test-ckpt-{name}-")


def _rows(spark, checkpoint, schema=None):
    """What Spark's file sink has committed."""
    r = spark.read.schema(schema) if schema else spark.read
    return r.parquet(f"{checkpoint}/rows")


def _as_stream(spark, df, name):
    path = tempfile.mkdtemp(prefix=f"shelfscope-test-{name}-") + "/src"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_engagement_per_hour_matches_batch(spark):
    posts = Mx.post_engagement(T.social_posts(T.table(spark, SF, "events"))).select("created_time", "score")
    q = St.start(St.engagement_per_hour(_as_stream(spark, posts, "t6")), spark, "t6_test", checkpoint=(c := _ckpt("t6")))
    q.awaitTermination()
    got = {r["hora"]: (r["posts"], r["eng"]) for r in _rows(spark, c).collect()}
    exp = {r["created_time"]: (r["posts"], r["eng"]) for r in
           posts.groupBy("created_time").agg(F.count(F.lit(1)).alias("posts"), F.sum("score").alias("eng")).collect()}
    assert got and all(exp[h] == v for h, v in got.items())
    last = max(exp)
    assert set(exp) - set(got) <= {h for h in exp if h > last - dt.timedelta(hours=3)}


def test_daily_stream_upserts_history(spark):
    obs = T.price_observations(T.table(spark, SF, "lineitem"))
    hist_path = tempfile.mkdtemp(prefix="shelfscope-test-t1-") + "/hist"
    q = St.start(St.daily_price_stream(_as_stream(spark, obs, "t1")), spark, "t1_test",
                 sink=St.upsert_daily_batches(spark, hist_path), checkpoint=_ckpt("t1"))
    q.awaitTermination()
    got = {(r["sku"], r["data_coleta"]): r["preco_min_dia"] for r in spark.read.parquet(hist_path).collect()}
    exp = {(r["sku"], r["data_coleta"]): r["preco_min_dia"] for r in radar.daily_compaction(obs).collect()}
    assert got and all(exp[k] == v for k, v in got.items())


def test_daily_stream_keeps_titles_and_survives_replays(spark):
    """Every closed day equals the batch compaction in all columns; a batch that runs again changes nothing."""
    obs = T.price_observations(T.table(spark, SF, "lineitem"))
    path, seen = tempfile.mkdtemp(prefix="shelfscope-test-t1r-") + "/hist", []
    sink = St.upsert_daily_batches(spark, path)

    def twice(batch, batch_id):
        sink(batch, batch_id)
        sink(batch, batch_id)
        seen.append(batch_id)
    q = St.start(St.daily_price_stream(_as_stream(spark, obs.repartition(2), "t1r")), spark, "t1r_test", sink=twice,
                 checkpoint=_ckpt("t1r"))
    q.awaitTermination()
    cols = ["sku", "loja", "data_coleta", "preco_min_dia", "preco_ultimo", "titulo", "categoria", "atualizado_em"]
    got = {tuple(r) for r in spark.read.parquet(path).select(cols).collect()}
    exp = {tuple(r) for r in radar.daily_compaction(obs).select(cols).collect()}
    assert seen and got and got <= exp
    assert any(r[5] for r in got) and len(exp) - len(got) <= 0.1 * len(exp)


DAYS = ["sku", "loja", "data_coleta", "preco_min_dia", "preco_ultimo", "titulo", "categoria", "atualizado_em"]
OBS = "sku string, loja string, data_coleta date, preco double, titulo string, categoria string, " \
      "ts timestamp_ntz, seq1 long, seq2 long"


def _arrivals(spark, files, name):
    """A stream that reads one file a batch, in order."""
    path = tempfile.mkdtemp(prefix=f"shelfscope-test-{name}-")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, OBS).coalesce(1).write.parquet(f"{path}/w{i}")
        [part] = [f for f in os.listdir(f"{path}/w{i}") if f.startswith("part-")]
        os.makedirs(f"{path}/src", exist_ok=True)
        os.rename(f"{path}/w{i}/{part}", f"{path}/src/{i}.parquet")
        os.utime(f"{path}/src/{i}.parquet", (1_700_000_000 + 60 * i,) * 2)
    return spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(f"{path}/src")


def _obs_row(sku, day, hour, price, seq, title="", category=""):
    ts = dt.datetime(2026, 1, 1, hour) + dt.timedelta(days=day)
    return (sku, "Magalu", ts.date(), price, title, category, ts, seq, 0)


def _history(spark, path):
    return {tuple(r) for r in spark.read.schema(Mt.HISTORY_SCHEMA).parquet(path).select(DAYS).collect()}


def test_daily_stream_state_does_not_grow_with_products(spark):
    """Spark's state holds a row per open day, not one per product and day."""
    days, skus = 6, 200
    rows = [_obs_row(f"MAGALU_{k}", d, 10, 10.0 + k, k) for d in range(days) for k in range(skus)]
    path = tempfile.mkdtemp(prefix="shelfscope-test-t1s-") + "/hist"
    q = St.start(St.daily_price_stream(_arrivals(spark, [rows], "t1s")), spark, "t1s_test",
                 sink=St.upsert_daily_batches(spark, path), checkpoint=_ckpt("t1s"))
    q.awaitTermination()
    held = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    assert held and max(held) <= days
    assert len(_history(spark, path)) == skus * (days - 2)      # the last two days are open


def test_daily_stream_equals_windows_in_spark_state(spark):
    """Late rows, open days and days that meet rows of several batches, against a window aggregate kept as Spark's state."""
    rng, files = random.Random(5), []
    for i in range(6):
        files.append([_obs_row(f"MAGALU_{rng.randrange(5)}", rng.randrange(max(0, 3 * i - 6), 3 * i + 4), rng.randrange(24),
                               rng.randrange(1, 900) / 10, 1000 * i + k, rng.choice(["", "a", "b"]), rng.choice(["", "c"]))
                      for k in range(60)])
    kept = (_arrivals(spark, files, "t1w").withColumn("_et", St.event_time("ts")).withWatermark("_et", "1 day")
            .groupBy(F.window("_et", "1 day").alias("w"), "sku", "loja")
            .agg(F.collect_list(F.struct("preco", "titulo", "categoria", "ts", "seq1", "seq2")).alias("x")))
    St.start(kept, spark, "t1w_state", checkpoint=(c := _ckpt("t1w"))).awaitTermination()
    rows = _rows(spark, c, kept.schema).select("sku", "loja", F.to_date("w.start").alias("data_coleta"), F.inline("x"))
    exp = {tuple(r) for r in radar.daily_compaction(rows).select(DAYS).collect()}
    path, sent = tempfile.mkdtemp(prefix="shelfscope-test-t1w-") + "/hist", sum(map(len, files))
    St.start(St.daily_price_stream(_arrivals(spark, files, "t1x")), spark, "t1w_test",
             sink=St.upsert_daily_batches(spark, path), checkpoint=_ckpt("t1x")).awaitTermination()
    assert _history(spark, path) == exp and 0 < rows.count() < sent
    newest = max(r[2] for r in exp)
    assert rows.where(F.col("data_coleta") <= newest).count() < sum(r[2] <= newest for f in files for r in f)   # some came too late


def test_daily_stream_goes_on_after_a_broken_merge(spark, monkeypatch):
    """A job that dies between its closed days and their merge goes on there; another job starts from its own rows."""
    files = [[_obs_row("MAGALU_1", d, 9, 50.0 - d, d, "t") for d in range(5)], [_obs_row("MAGALU_1", 9, 9, 7.0, 9)]]
    path, ckpt, upsert = tempfile.mkdtemp(prefix="shelfscope-test-t1b-") + "/hist", _ckpt("t1b"), Mt.upsert_price_days
    stream = _arrivals(spark, files, "t1b")

    def run(df, checkpoint):
        St.start(St.daily_price_stream(df), spark, "t1b_test", sink=St.upsert_daily_batches(spark, path),
                 checkpoint=checkpoint).awaitTermination()

    def broken(*args):
        raise RuntimeError("lost")
    monkeypatch.setattr(Mt, "upsert_price_days", broken)
    with pytest.raises(Exception, match="lost"):
        run(stream, ckpt)
    assert not os.path.exists(path)
    monkeypatch.setattr(Mt, "upsert_price_days", upsert)
    run(stream, ckpt)
    assert sorted((r[2].day, r[3], r[5]) for r in _history(spark, path)) == [(d + 1, 50.0 - d, "t") for d in range(5)]
    run(_arrivals(spark, [[_obs_row("MAGALU_1", 0, 8, 3.0, 1), _obs_row("MAGALU_2", 7, 8, 4.0, 1)]], "t1c"), _ckpt("t1c"))
    got = {(r[0], r[2].day): (r[3], r[4]) for r in _history(spark, path)}
    assert len(got) == 5 and got["MAGALU_1", 1] == (3.0, 3.0) and got["MAGALU_1", 2] == (49.0, 49.0)


def test_replayed_batch_is_published_once(spark):
    manifest = BatchManifest(spark, tempfile.mkdtemp(prefix="shelfscope-test-man-") + "/out")
    schema = "id long"
    assert manifest.read("ok", schema).count() == 0
    sink = manifest.sink(lambda b: {"ok": b.where("id % 2 = 0"), "side": b.where("id % 2 = 1")})
    for batch_id in (0, 1, 1, 0):
        sink(spark.range(10 * batch_id, 10 * batch_id + 10), batch_id)
    assert sorted(r["id"] for r in manifest.read("ok", schema).collect()) == list(range(0, 20, 2))
    assert manifest.read("side", schema).count() == 10
    # an attempt that died before it published: its rows are invisible, the batch runs again
    spark.range(100, 110).write.parquet(f"{manifest.path}/data/ok/batch=2-lost")
    assert manifest.read("ok", schema).count() == 10
    sink(spark.range(20, 30), 2)
    assert manifest.read("ok", schema).count() == 15 and manifest.vacuum() == 1
    assert manifest.read("ok", schema).count() == 15 and not manifest.publish(2, {"ok": spark.range(5)})


def _lock_by_loop(rows, hours=72):
    """Decisions of a plain loop: {event id: (free, post that locks it)}."""
    out, last = {}, {}
    for sku, evento, tipo, quando in sorted(rows, key=lambda r: (r[3], r[2] != "post", r[1])):
        before = last.get(sku)
        if tipo == "post":
            last[sku] = quando
            continue
        free = before is None or quando - before >= dt.timedelta(hours=hours)
        out[evento] = (free, None if free else before)
        if free:
            last[sku] = quando
    return out


def test_sliding_lock_equals_a_loop_over_events(spark):
    """All events, out of order inside the delay, over several batches and a restart in the middle."""
    schema = "sku string, evento_id long, tipo string, quando timestamp"
    rows = [(str(r["user_id"]), r["event_id"], L.POST if r["event_type"] == "purchase" else L.OFFER, r["ts"])
            for r in T.table(spark, SF, "events").collect()]
    base = rows[0][3]
    rows += [("edge", 10_000_001, L.POST, base), ("edge", 10_000_002, L.OFFER, base + dt.timedelta(hours=72) - dt.timedelta(microseconds=1)),
             ("edge", 10_000_003, L.OFFER, base + dt.timedelta(hours=72)),
             ("edge", 10_000_004, L.OFFER, base + dt.timedelta(hours=144) - dt.timedelta(microseconds=1)),
             ("tie", 10_000_005, L.OFFER, base), ("tie", 10_000_006, L.POST, base)]
    rows.sort(key=lambda r: r[3])
    rows = [x for k in range(0, len(rows), 20) for x in reversed(rows[k:k + 20])]      # out of order
    path, ckpt = tempfile.mkdtemp(prefix="shelfscope-test-lock-") + "/src", _ckpt("lock")
    cut = len(rows) // 2
    end = [("zz", 99_000_000, L.POST, max(r[3] for r in rows) + dt.timedelta(days=30))]
    for part in (rows[:cut], rows[cut:], end):       # the job is started anew for each part
        df = spark.createDataFrame([(s, e, t, q.astimezone() if q.tzinfo else q) for s, e, t, q in part], schema)
        df.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        St.start(L.sliding_lock(stream, delay="3 days"), spark, "lock_test", checkpoint=ckpt,
                 conf=L.STATE_STORE).awaitTermination()
    got = {r["evento_id"]: (r["livre"], r["ultimo_post"]) for r in _rows(spark, ckpt).collect()}
    exp = _lock_by_loop(rows)
    assert got == exp
    assert {True, False} == {free for free, _ in got.values()} and got[10_000_002][0] is False and got[10_000_003][0]


def test_first_post_and_url_within_window(spark):
    base = dt.datetime(2024, 1, 1)
    posts = spark.createDataFrame([("a", base), ("a", base + dt.timedelta(hours=5)), ("b", base)],
                                  "sku string, postado_em timestamp_ntz")
    q = St.start(St.first_post_within(_as_stream(spark, posts, "t2")), spark, "t2_test", checkpoint=(c := _ckpt("t2")))
    q.awaitTermination()
    assert sorted(r["sku"] for r in _rows(spark, c).collect()) == ["a", "b"]
    items = spark.createDataFrame([("h1", base), ("h1", base + dt.timedelta(days=1)), ("h2", base)],
                                  "url_hash string, publicado_em timestamp_ntz")
    q = St.start(St.first_url_within(_as_stream(spark, items, "t3")), spark, "t3_test", checkpoint=(c := _ckpt("t3")))
    q.awaitTermination()
    assert _rows(spark, c).count() == 2


def test_recency_routing_and_stream_static_radar(spark):
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    items = spark.createDataFrame([("ok", now - dt.timedelta(hours=1)), ("late", now - dt.timedelta(hours=48)),
                                   ("future", now + dt.timedelta(hours=2))], "id string, publicado_em timestamp_ntz")
    manifest = BatchManifest(spark, tempfile.mkdtemp(prefix="shelfscope-test-t4-") + "/news")
    tagged = St.split_by_recency(_as_stream(spark, items, "t4"))
    q = St.start(tagged, spark, "t4_test", sink=St.route_by_recency(manifest), checkpoint=_ckpt("t4"))
    q.awaitTermination()
    schema = "id string, publicado_em timestamp_ntz, faixa string"
    assert [r["id"] for r in manifest.read("ok", schema).collect()] == ["ok"]
    assert sorted((r["id"], r["faixa"]) for r in manifest.read("side", schema).collect()) == [
        ("future", "future"), ("late", "late")]
    stats = spark.createDataFrame([("ML_1", "Mercado Livre", 300.0, 300.0, 300.0, 5)],
                                  "sku string, loja string, min_180d double, mediana_180d double, "
                                  "media_180d double, dias_observados long")
    offers = spark.createDataFrame([("ML_1", "Mercado Livre", 240.0), ("ML_2", "Mercado Livre", 10.0)],
                                   "sku string, loja string, preco_atual double")
    q = St.start(St.radar_on_arrivals(_as_stream(spark, offers, "t5"), stats), spark, "t5_test", checkpoint=(c := _ckpt("t5")))
    q.awaitTermination()
    got = {r["sku"]: (r["menor_preco_historico"], r["queda_real_percent"]) for r in _rows(spark, c).collect()}
    assert got == {"ML_1": (True, 20.0), "ML_2": (False, 0.0)}
