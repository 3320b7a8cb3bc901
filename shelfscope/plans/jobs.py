"""Registered queries of the stateful jobs: streams, logs, retention, marts, responses of
many runs, breaker, feeds and exports.

A query writes the rows a job expects (in its schema, derived from the driver tables) to a
folder of its own under ``spark.checkpoint.dir``, runs the job, and returns what the job's
tables hold; the folder is removed once that is checkpointed.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfscope.functions import rules
from shelfscope.functions.pricing import store_from_sku
from shelfscope.functions.text import url_key
from shelfscope.operators import ingest as I
from shelfscope.operators import maintenance as Mt
from shelfscope.operators import metrics as Mx
from shelfscope.operators import radar
from shelfscope.operators import responses as Rs
from shelfscope.operators.marts import DashboardMarts
from shelfscope.plans import catalog as C
from shelfscope.session import checkpoint_dir, materialize
from shelfscope.sources import csv_export, feeds as Fd
from shelfscope.sources import tables as T
from shelfscope.sources.batches import BatchManifest
from shelfscope.streaming import lock as L
from shelfscope.streaming import streams as St


class JobFolder:
    """A folder of one run under the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{checkpoint_dir(spark).rstrip('/')}/jobs/{name}-{uuid.uuid4().hex}"

    def __truediv__(self, name: str) -> str:
        return f"{self.path}/{name}"

    def finished(self, result: DataFrame) -> DataFrame:
        """``result`` checkpointed, and the folder removed."""
        out = materialize(result)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return out


def arriving(folder: JobFolder, parts: list[DataFrame], run: Callable[[DataFrame, str], None]) -> None:
    """Write one part after the other to a folder and let the job, started anew each time, read what is new."""
    source, checkpoint = folder / "source", folder / "stream"
    for part in parts:
        part.write.mode("append").parquet(source)
        run(folder.spark.readStream.schema(part.schema).parquet(source), checkpoint)


def _rows(folder: JobFolder, df: DataFrame) -> DataFrame:
    """What Spark's file sink has committed."""
    return folder.spark.read.schema(df.schema).parquet(folder / "stream/rows")


# ------------------------------------------------------------------------ streams
def q_stream_daily_prices(spark, sf):
    """T1 + M1: observations arrive in three parts, the last one a marker that closes every day."""
    folder, obs = JobFolder(spark, "t1"), T.price_observations(T.table(spark, sf, "lineitem"))
    obs = obs.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    lo, hi = F.min("ts"), F.max("ts")
    split, end = (F.lit(x).cast("timestamp_ntz") for x in obs.agg(
        F.date_trunc("month", lo + (hi - lo) / 2).cast("timestamp_ntz").cast("string"),
        (hi + F.make_dt_interval(F.lit(400))).cast("string")).first())
    marker = obs.limit(1).withColumn("sku", F.lit("~fim")).withColumn("ts", end)
    sink = St.upsert_daily_batches(spark, folder / "hist")
    arriving(folder, [obs.where(F.col("ts") < split), obs.where(F.col("ts") >= split), marker], lambda df, ckpt: St.start(
        St.daily_price_stream(df), spark, "precos_diarios", sink=sink, checkpoint=ckpt).awaitTermination())
    hist = spark.read.schema(Mt.HISTORY_SCHEMA).parquet(folder / "hist")
    return folder.finished(hist.where("sku <> '~fim'").drop("mes"))


def _lock_events(events: DataFrame) -> DataFrame:
    """Purchases are posts, everything else is an offer of the product (sku = user id)."""
    return events.select(F.col("user_id").cast("string").alias("sku"), F.col("event_id").alias("evento_id"),
                         F.when(F.col("event_type") == "purchase", L.POST).otherwise(L.OFFER).alias("tipo"),
                         St.event_time("ts").alias("quando"))


def q_stream_repeat_lock(spark, sf):
    """Events arrive in two halves and a marker that moves the watermark past all of them."""
    folder, ev = JobFolder(spark, "t2"), _lock_events(T.table(spark, sf, "events"))
    split = ev.select(F.min("quando") + (F.max("quando") - F.min("quando")) / 2).scalar()
    marker = ev.select(F.lit("~fim").alias("sku"), F.lit(-1).cast("long").alias("evento_id"), F.lit(L.POST).alias("tipo"),
                       F.max("quando").alias("quando")).withColumn("quando", F.col("quando") + F.make_dt_interval(F.lit(30)))

    def run(df, ckpt):
        St.start(L.sliding_lock(df), spark, "trava_72h", checkpoint=ckpt, conf=L.STATE_STORE).awaitTermination()
    arriving(folder, [ev.where(F.col("quando") < split), ev.where(F.col("quando") >= split), marker], run)
    schema = "sku string, evento_id long, quando timestamp, livre boolean, ultimo_post timestamp"
    out = spark.read.schema(schema).parquet(folder / "stream/rows")
    return folder.finished(out.select("sku", "evento_id", "livre", F.unix_micros("ultimo_post").alias("ultimo_post_us")))


def q_stream_recency(spark, sf):
    """T4: items in time and the others go to two tables of one published batch; ``now`` is the newest item's day."""
    folder, feed = JobFolder(spark, "t4"), C._feed(spark, sf).select("doc_id", "publicado_em")
    newest = feed.select(F.date_format(F.date_trunc("hour", F.max("publicado_em")), "yyyy-MM-dd HH:mm:ss")).first()[0]
    manifest = BatchManifest(spark, folder / "news")

    def run(df, ckpt):
        St.start(St.split_by_recency(df, now=F.lit(newest).cast("timestamp")), spark, "recencia",
                 sink=St.route_by_recency(manifest), checkpoint=ckpt).awaitTermination()
    arriving(folder, [feed.where("doc_id % 2 = 0"), feed.where("doc_id % 2 = 1")], run)
    schema = "doc_id bigint, publicado_em timestamp_ntz, faixa string"
    both = [manifest.read(t, schema).withColumn("tabela", F.lit(t)) for t in ("ok", "side")]
    return folder.finished(both[0].unionByName(both[1]).select("doc_id", "faixa", "tabela"))


def q_stream_radar(spark, sf):
    """T5: offers arrive and meet the snapshot of their trailing statistics."""
    folder = JobFolder(spark, "t5")
    hist = C._stored_hist(spark, sf)
    offers = hist.groupBy("sku", "loja").agg(F.max("data_coleta").alias("oferta_dia"),
                                             F.max_by("preco_min_dia", "data_coleta").alias("preco_atual"))
    offers = materialize(offers)
    stats = materialize(radar.trailing_stats(offers, hist, offer_keys=()))
    arriving(folder, [offers.select("sku", "loja", "preco_atual")], lambda df, ckpt: St.start(
        St.radar_on_arrivals(df, stats), spark, "radar", checkpoint=ckpt).awaitTermination())
    out = spark.read.schema("sku string, loja string, preco_atual double, queda_real_percent double, "
                            "menor_preco_historico boolean, preco_medio_historico double").parquet(folder / "stream/rows")
    return folder.finished(out)


def q_stream_engagement(spark, sf):
    """Posts arrive in two parts; a marker closes the last hours."""
    folder = JobFolder(spark, "t6")
    posts = Mx.post_engagement(T.social_posts(T.table(spark, sf, "events"))).select("user_id", "created_time", "score")
    marker = posts.agg(F.lit(-1).cast("long").alias("user_id"), F.max("created_time").alias("created_time"),
                       F.lit(0).cast("long").alias("score")).withColumn(
        "created_time", F.col("created_time") + F.make_dt_interval(F.lit(2)))
    split = posts.select(F.to_timestamp_ntz(F.date_trunc("day", F.min("created_time") + (F.max("created_time") - F.min("created_time")) / 2))).scalar()
    arriving(folder, [posts.where(F.col("created_time") < split), posts.where(F.col("created_time") >= split), marker],
             lambda df, ckpt: St.start(St.engagement_per_hour(df), spark, "engajamento", checkpoint=ckpt).awaitTermination())
    return folder.finished(spark.read.schema("hora timestamp_ntz, posts bigint, eng bigint").parquet(folder / "stream/rows"))


# --------------------------------------------------------------------------- logs
def q_post_log(spark, sf):
    """M2: posts of a product and day are written in three batches, the second one twice; the first write stays."""
    folder, ev = JobFolder(spark, "m2"), T.table(spark, sf, "events")
    posts = ev.where("event_type = 'purchase'").select(
        T.sku_for("user_id").alias("sku"), F.lit("").alias("loja"),
        F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd 00:00:00")).alias("postado_em"),
        F.col("value").alias("preco_postado"), F.col("event_id").cast("string").alias("canal_resumo"),
        (F.col("event_id") % 3).alias("lote"))
    posts = materialize(posts)
    for lote in (0, 1, 1, 2):
        Mt.append_posts(spark, folder / "log", posts.where(F.col("lote") == lote).drop("lote"), batch_id=lote)
    return folder.finished(Mt.posted_log(spark, folder / "log").read())


def q_topic_log(spark, sf):
    """M3: topics with a URL that others share are written in two batches; the first write of a URL stays."""
    folder, d = JobFolder(spark, "m3"), T.table(spark, sf, "documents")
    url = F.concat(F.lit("https://news.example.com/"), F.floor(F.col("doc_id") / 3).cast("string"))
    pub = F.timestamp_add("MINUTE", F.col("doc_id"), F.lit(T.NEWS_EPOCH).cast("timestamp_ntz"))
    topics = d.select(url_key(url).alias("url_hash"), F.concat(url, F.lit("#"), F.col("doc_id").cast("string")).alias("url"),
                      F.col("source").alias("fonte"), F.substring("text", 1, 80).alias("titulo"),
                      F.substring("text", 1, 20).alias("tema_normalizado"), pub.alias("publicado_em"),
                      F.col("lang").alias("canais_postados"), (F.col("doc_id") % 2).alias("lote"))
    topics = materialize(topics)
    for lote in (1, 0):
        Mt.append_topics(spark, folder / "log", topics.where(F.col("lote") == lote).drop("lote"))
    return folder.finished(Mt.topic_log(spark, folder / "log").read().select("url_hash", "url", "fonte", "publicado_em"))


# ---------------------------------------------------------------------- retention
def q_retention_run(spark, sf):
    """M5 on three tables: prices as of their last day, posts and topics as of a day by which half of them are too
    old; the run is repeated, and the stored count stays."""
    folder, ev, feed = JobFolder(spark, "m5"), T.table(spark, sf, "events"), C._feed(spark, sf)
    base, far = folder / "base", 36500
    Mt.upsert_price_days(spark, f"{base}/precos", T.price_observations(T.table(spark, sf, "lineitem")))
    Mt.append_posts(spark, f"{base}/postados", T.posted_log(ev).withColumns(
        {"loja": F.lit(rules.STORE_A), "canal_resumo": F.lit("x")}))
    Mt.append_topics(spark, f"{base}/pautas", feed.select(
        "url_hash", "url", "fonte", F.lit("").alias("titulo"), F.lit("").alias("tema_normalizado"), "publicado_em",
        F.lit("").alias("canais_postados")))
    hist = Mt.read_or_empty(spark, f"{base}/precos", Mt.HISTORY_SCHEMA)
    posted, topics = (Mt.posted_log(spark, f"{base}/postados"), Mt.topic_log(spark, f"{base}/pautas"))

    def middle(df, c):
        return df.select(F.min(c) + (F.max(c) - F.min(c)) / 2).first()[0]
    last = hist.select(F.max("data_coleta")).first()[0]
    refs = {"precos": dt.datetime(last.year, last.month, last.day),
            "postados": middle(posted.read(), "postado_em") + dt.timedelta(days=rules.RETENTION_POSTED_DAYS),
            "pautas": middle(topics.read(), "publicado_em") + dt.timedelta(days=rules.RETENTION_TOPIC_DAYS)}
    removed = Mt.run_retention(spark, base, refs["precos"], refs)
    again = Mt.run_retention(spark, base, refs["precos"], refs)
    stored = Mt.metadata_latest(Mt.read_metadata(spark, f"{base}/metadados")).where(F.col("chave") == Mt.LAST_PURGE_REMOVED)
    out = None
    for name, key, df in (("precos", "precos_removidos", Mt.read_or_empty(spark, f"{base}/precos", Mt.HISTORY_SCHEMA)),
                          ("postados", "postados_removidos", posted.read()), ("pautas", "rss_removidos", topics.read())):
        row = df.agg(F.lit(name).alias("tabela"), F.lit(removed[key]).cast("long").alias("removidos"),
                     F.lit(again[key]).cast("long").alias("de_novo"), F.count(F.lit(1)).alias("restantes"))
        out = row if out is None else out.unionByName(row)
    out = out.withColumn("contagem_guardada", F.when(F.col("tabela") == "precos", stored.select(
        F.col("valor").cast("long")).scalar()))
    return folder.finished(out)


def q_legacy_migration(spark, sf):
    """M7: legacy price and post documents go into the tables, twice; the second run changes nothing."""
    folder = JobFolder(spark, "m7")
    base, prices = folder / "base", materialize(C.legacy_price_docs(spark, sf))
    ev = T.table(spark, sf, "events").where("event_type = 'purchase'")
    posts = ev.select(F.to_json(F.create_map(T.sku_for("user_id"), F.when(
        F.col("event_id") % 11 == 0, F.lit("not-a-date")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))).alias("doc"))
    posts = materialize(posts)
    for _ in range(2):
        Mt.migrate_legacy(spark, base, prices, posts, "2026-01-01")
    hist = Mt.read_or_empty(spark, f"{base}/precos", Mt.HISTORY_SCHEMA).select(
        F.lit("precos").alias("tabela"), "sku", "loja", F.col("data_coleta").cast("string").alias("quando"),
        F.col("preco_ultimo").alias("preco"), F.col("preco_min_dia").alias("minimo"))
    log = Mt.posted_log(spark, f"{base}/postados").read().select(
        F.lit("postados").alias("tabela"), "sku", "loja", F.date_format("postado_em", "yyyy-MM-dd HH:mm:ss").alias("quando"),
        F.col("preco_postado").alias("preco"), F.lit(None).cast("double").alias("minimo"))
    return folder.finished(hist.unionByName(log))


def q_purge_guard(spark, sf):
    """M6 with its lookup: row-loss checks (derived from orders) against purges at most six hours before them."""
    o = T.table(spark, sf, "orders")
    at = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"), (F.col("o_custkey") % 60).cast("int"))
    purges = o.where("o_orderkey % 3 = 0").select(F.col("o_orderpriority").alias("base"), at.alias("limpo_em"),
                                                  (F.col("o_custkey") % 400).alias("removidos"))
    checks = o.where("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").alias("conferencia"), F.col("o_orderpriority").alias("base"), at.alias("conferido_em"),
        F.lit(1000).cast("long").alias("baseline"), (1000 - F.col("o_custkey") % 500).alias("atuais"))
    return Mt.guarded_checks(checks, purges).select("conferencia", "base", "justificados", "ok", "motivo",
                                                    "queda_injustificada_pct")


# ------------------------------------------------------------------------ breaker
def scoped_log(spark, sf) -> DataFrame:
    """Page log with a route, runs that begin every 60 fetches, and retries."""
    return I.block_diagnosis(C._page_log(spark, sf)).withColumns({
        "rota": F.concat(F.lit("rota"), (F.col("seq") % 4).cast("string")), "inicio": F.col("seq") % 60 < 4,
        "tentativa": F.when(F.col("seq") % 9 == 0, 2).otherwise(1)})


def q_breaker_scan(spark, sf):
    return I.breaker_scan(scoped_log(spark, sf)).select("loja", "rota", "seq", "execucao", "cortada", "gatilho")


def q_breaker_calls(spark, sf):
    return I.breaker_calls(I.breaker_scan(scoped_log(spark, sf)))


# ---------------------------------------------------------------- responses of runs
RUN_PARTS = 40


def run_candidates(spark, sf) -> DataFrame:
    """Offers of a run: those of ``RUN_PARTS`` consecutive parts."""
    return C.enriched_offers(spark, sf).withColumn("run_id", F.floor(F.col("ord") / RUN_PARTS))


def run_responses(spark, sf) -> DataFrame:
    """One response per run, in five shapes: all items of even parts; fenced array of every fifth; cut text of
    every third; text without items; items of every eighth under another key."""
    part = T.table(spark, sf, "part").withColumn("run_id", F.floor(F.col("p_partkey") / RUN_PARTS))
    shape, k = F.col("run_id") % 5, F.col("p_partkey")
    told = (F.when(shape == 0, k % 2 == 0).when(shape == 1, k % 5 == 0).when(shape == 2, k % 3 == 0)
            .when(shape == 3, F.lit(False)).otherwise(k % 8 == 0))
    item = F.concat(F.lit('{"sku_selecionado":"'), T.sku_for("p_partkey"), F.lit('","nome_produto":"'), F.col("p_name"),
                    F.lit('","loja":"'), store_from_sku(T.sku_for("p_partkey")), F.lit('","categoria":"IA"}'))
    g = part.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
        told, F.struct("p_partkey", item.alias("v"))))), lambda x: x["v"]), ",").alias("_xs"))
    whole = F.concat(F.lit('{"oportunidades":['), F.col("_xs"), F.lit("]}"))
    shape = F.col("run_id") % 5
    text = (F.when(shape == 0, whole).when(shape == 1, F.concat(F.lit("```json\n["), F.col("_xs"), F.lit("]\n```")))
            .when(shape == 2, F.left(whole, F.length(whole) - 30)).when(shape == 3, F.lit("sem ofertas hoje"))
            .otherwise(F.concat(F.lit('Segue: {"ofertas":['), F.col("_xs"), F.lit("]}"))))
    return g.select("run_id", text.alias("texto"))


def _resolved(spark, sf):
    parsed = materialize(Rs.parse_responses(materialize(run_responses(spark, sf))).select("run_id", "itens_raw", "origem"))
    return parsed, Rs.resolve_runs(parsed, run_candidates(spark, sf))


def q_response_top_up(spark, sf):
    return _resolved(spark, sf)[1].select("run_id", "pos", "origem", "sku_selecionado", "nome_produto", "loja",
                                          "categoria", "preco_atual", "razao_selecao", "copy_titulo", "imagem_url")


def q_response_provenance(spark, sf):
    return Rs.run_provenance(*_resolved(spark, sf))


RECOVERY_PARTS = 15


def cut_responses(spark, sf) -> DataFrame:
    """Responses that break off: nested objects, braces and quotes inside strings, objects named only further in."""
    part = T.table(spark, sf, "part")
    named = F.concat(F.lit('{"sku_selecionado":"'), T.sku_for("p_partkey"),
                     F.lit('","extra":{"nota":"a } b { \\" c","n":[1,{"z":2.5e3}]},"nome_produto":"'), F.col("p_name"), F.lit('"}'))
    k = F.col("p_partkey")
    item = (F.when(k % 5 == 0, F.concat(F.lit('{"dentro":['), named, F.lit("]}")))
            .when(k % 7 == 0, F.lit('{"sku_selecionado":"","preco":1}')).otherwise(named))
    g = part.groupBy(F.floor(k / RECOVERY_PARTS).alias("resposta_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("v")))), lambda x: x["v"]), ",").alias("_xs"))
    whole = F.concat(F.lit('{"w":{"lista":['), F.col("_xs"), F.lit("]}}"))
    return g.select("resposta_id", F.left(whole, F.floor(F.length(whole) * (0.3 + 0.05 * (F.col("resposta_id") % 13))).cast("int")).alias("texto"))


def q_response_recovery(spark, sf):
    """L4 alone: the named objects that are complete in texts that break off."""
    r = materialize(cut_responses(spark, sf)).withColumn("o", Rs.recovered_objects(F.col("texto")))
    return (r.select("resposta_id", F.posexplode("o").alias("pos", "o"))
            .select("resposta_id", "pos", F.try_variant_get("o", "$.sku_selecionado", "string").alias("sku"),
                    F.try_variant_get("o", "$.extra.n[1].z", "double").alias("z")))


# ---------------------------------------------------------------------- editorial
EDITION = 10


def edition_candidates(spark, sf) -> DataFrame:
    """Ten consecutive documents are the candidates of an edition."""
    d = T.table(spark, sf, "documents").withColumn("run_id", F.floor(F.col("doc_id") / EDITION))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("doc_id"))     # ten rows an edition
    return d.select("run_id", "doc_id", place.alias("id_curto"), F.col("doc_id").cast("string").alias("id"),
                    F.col("source").alias("fonte"), F.substring("text", 1, 120).alias("titulo"),
                    F.concat(F.lit("https://"), F.lower("source"), F.lit(".example.com/News/"), F.col("doc_id").cast("string"),
                             F.lit("/")).alias("url"),
                    F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://img.example.com/"), F.col("doc_id").cast("string"))
                           ).alias("imagem_url"))


def edition_responses(candidates: DataFrame) -> DataFrame:
    """One response an edition about its fourth article, named by id, place, URL or title, or unusable."""
    c = candidates.where("id_curto = 4").withColumn("k", F.col("run_id") % 8)
    k = F.col("k")
    key = F.struct(
        F.when(k.isin(0, 5), F.col("id")).when(k == 1, F.lit("4")).when(k == 6, F.lit("99999999")).alias("noticia_id"),
        F.when(k == 2, F.upper(F.regexp_replace("url", "/$", ""))).when(k == 3, F.concat(F.regexp_replace("url", "/$", ""), F.lit("#topo")))
        .alias("url_escolhida"), F.when(k == 4, F.upper("titulo")).otherwise(F.lit(None)).alias("titulo_original"),
        F.when(F.col("run_id") % 3 == 0, F.lit("Manchete curta do dia sobre uma novidade que interessa a todos")).alias("headline_card"),
        F.lit("novidade").alias("destaque_card"), F.when(F.col("run_id") % 2 == 0, F.lit(" hardware e afins ")).alias("tag_categoria"),
        F.when(k != 5, F.concat(F.lit("Leia em www.example.com/x agora: "), F.substring("titulo", 1, 40))).alias("texto_facebook"),
        F.when(F.col("run_id") % 5 == 0, F.concat(F.lit("Via "), F.col("fonte"), F.lit(" no canal t.me/canal hoje"))).alias("texto_telegram"),
        F.when(F.col("run_id") % 4 == 1, F.lit("  texto   do  X em exemplo.com.br/abc  ")).alias("texto_x"),
        F.lit("linha um\n  linha dois").alias("roteiro_reel"), (F.col("run_id") % 2 == 0).alias("tem_match_oferta"),
        F.concat(F.lit(" ML_"), (F.col("run_id") % 6).cast("string"), F.lit(" ")).alias("sku_oferta_relacionada"))
    body = F.to_json(key)
    text = (F.when(k == 7, F.lit("nada de json")).when(F.col("run_id") % 3 == 1, F.concat(F.lit("```json\n["), body, F.lit("]\n```")))
            .otherwise(F.concat(F.lit("Resposta: "), body, F.lit(" fim"))))
    # without a text for both channels (k = 5, and no telegram text) nothing can be published
    return c.select("run_id", text.alias("texto"))


def edition_offers(candidates: DataFrame) -> DataFrame:
    """Offers of an edition; the first of a sku counts, also if it has no URL."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f"ML_{sku}").alias("sku"), F.lit(url).cast("string").alias("url_afiliado"))
                            for i, (sku, url) in enumerate([(0, "https://a.example.com/0"), (2, ""), (2, "https://a.example.com/2"),
                                                            (4, " https://a.example.com/4 ")])]))
    return candidates.where("id_curto = 1").select("run_id", o.alias("o")).select("run_id", "o.*")


def q_editorial_picks(spark, sf):
    c = materialize(edition_candidates(spark, sf))
    return Rs.editorial_picks(materialize(edition_responses(c)), c, edition_offers(c))


# --------------------------------------------------------------------------- URLs
def raw_links(spark, sf) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 9
    url = (F.when(kind == 0, F.concat(F.lit("  //produto.example.com/MLB"), k, F.lit("?a=1&b=&a=2#topo ")))
           .when(kind == 1, F.concat(F.lit("/p/MLB"), k, F.lit("?matt_tool=&z=1")))
           .when(kind == 2, F.concat(F.lit("https://x.example.com/"), k, F.lit("?matt_word=outro&forceInApp=false&foo")))
           .when(kind == 3, F.concat(F.lit("http://x.example.com/"), k))
           .when(kind == 4, F.concat(F.lit("ftp://x.example.com/"), k))
           .when(kind == 5, F.concat(F.lit("https://x.example.com/"), k, F.lit("?q=a+b%20c&u=%C3%A9*~&&page=3&=v")))
           .when(kind == 6, F.lit("#so-fragmento")).when(kind == 7, F.lit(None))
           .otherwise(F.concat(F.lit("https://x.example.com/"), k, F.lit("?matt_tool=1&page=9&matt_tool=&p=a=b"))))
    return T.table(spark, sf, "part").select("p_partkey", url.alias("url"))


def q_affiliate_urls(spark, sf):
    """P13."""
    return raw_links(spark, sf).select("p_partkey", I.affiliate_url("url").alias("afiliado"),
                                       I.paged_url("url", F.col("p_partkey") % 4).alias("pagina"))


# --------------------------------------------------------------------------- feeds
def scattered_feeds(spark, sf) -> DataFrame:
    """Feed documents of 20 consecutive documents each, in four forms: items beside the channel, items deep inside
    other elements, Atom, and cut off in the middle."""
    items = T.feed_items(T.table(spark, sf, "documents")).withColumn("bloco", F.floor(F.col("doc_id") / 20))
    form, url = F.col("bloco") % 4, C._xml_escape(F.col("url"))
    title = C._xml_escape(F.regexp_replace(F.substring("titulo", 1, 90), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    offset = F.when(F.col("doc_id") % 2 == 0, F.lit("+0000")).otherwise(F.lit("Z"))
    iso = F.concat(F.date_format("publicado_em", "yyyy-MM-dd'T'HH:mm:ss"), offset)
    rfc = F.concat(F.date_format("publicado_em", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    picture = F.concat(F.lit('<enclosure url="https://img.example.com/'), F.col("doc_id").cast("string"),
                       F.when(F.col("doc_id") % 2 == 0, F.lit('.PNG?w=1"/>')).otherwise(F.lit('.mp3" type="audio/mpeg"/>')))
    rss = F.concat(F.lit("<item><title>"), title, F.lit("</title><link> "), url, F.lit(" </link><pubDate>"), rfc,
                   F.lit("</pubDate>"), picture, F.lit("</item>"))
    atom = F.concat(F.lit("<entry><title>"), title, F.lit('</title><link href="'), url, F.lit('"/><updated>'), iso,
                    F.lit("</updated></entry>"))
    g = items.groupBy("bloco").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.when(
        form == 2, atom).otherwise(rss).alias("x")))), lambda e: e["x"]), "").alias("_x"))
    form = F.col("bloco") % 4
    xml = (F.when(form == 0, F.concat(F.lit("<rss><channel><title>c</title></channel>"), F.col("_x"), F.lit("</rss>")))
           .when(form == 1, F.concat(F.lit("<a><b><c>"), F.col("_x"), F.lit("</c></b><item><title></title></item></a>")))
           .when(form == 2, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.col("_x"), F.lit("</feed>")))
           .otherwise(F.concat(F.lit("<rss><channel>"), F.col("_x"), F.lit("</channel>"))))
    return g.select(F.lit("fonte").alias("fonte"), F.col("bloco").alias("feed_ord"), xml.alias("xml"))


def q_feed_tree_items(spark, sf):
    """Items anywhere in a document, Atom, malformed feeds."""
    e = Fd.feed_entries(materialize(scattered_feeds(spark, sf)))
    return e.select("feed_ord", "pos", "title", "link", Fd.parse_feed_date("published").alias("publicado_em"), "image_url")


# --------------------------------------------------------------------------- export
def q_offers_csv(spark, sf):
    """The offer catalogue as CSV files with a byte-order mark, read back as bytes and as rows."""
    folder, offers = JobFolder(spark, "s11"), C.enriched_offers(spark, sf)
    offers = offers.select("sku", F.concat(F.col("nome_produto"), F.lit(' "'), F.col("categoria"), F.lit('"; ok')).alias("nome_produto"),
                           F.when(F.col("ord") % 7 == 0, None).otherwise(F.col("loja")).alias("loja"), "ord")
    csv_export.write_csv_with_mark(offers, folder / "ofertas")
    files = spark.read.format("binaryFile").load(folder / "ofertas")
    marked = files.select(F.bool_and(F.hex(F.substring("content", 1, 3)) == "EFBBBF")).scalar()
    lines = spark.read.schema("sku string, nome_produto string, loja string, ord long").csv(
        folder / "ofertas", sep=";", header=True, quote='"', escape='"', encoding="UTF-8", enforceSchema=True)
    return folder.finished(lines.withColumn("com_marca", marked))


# ---------------------------------------------------------------------------- marts
def q_dashboard_marts(spark, sf):
    """Three batches of runs, posts and sales folded into the marts, one of them twice; then every table."""
    folder, ev, orders = JobFolder(spark, "s14"), T.table(spark, sf, "events"), T.table(spark, sf, "orders")
    marts = DashboardMarts(spark, folder / "marts")
    day = F.dayofmonth("ts")
    for batch, (here, third) in enumerate([(day <= 10, 0), (day.between(11, 20), 1), (day > 20, 2), (day > 20, 2)]):
        e = ev.where(here)
        runs = materialize(Mx.run_status(T.run_metrics(e)))
        posts = Mx.post_engagement(T.social_posts(e)).withColumn("hora", F.hour(C.N.local_time_fixed(F.col("created_time"))))
        counts = Mx.category_counts(e.withColumn("run_date", F.to_date("ts")), "run_date", "event_type")
        marts.fold({"execucoes": runs, "categorias": counts, "postagens": posts,
                    "vendas": T.sales_ledger(orders.where(F.col("o_orderkey") % 3 == third))}, batch_id=min(batch, 2))
    return folder.finished(long_marts(marts.tables()))


_MART_KEYS = {"categorias": "categoria", "ultimas": "run_date", "horas": "hora", "plataformas": "platform", "conversao": "id"}


def long_marts(tables: dict[str, DataFrame]) -> DataFrame:
    """All numbers of the marts as rows (mart, chave, medida, valor)."""
    out = None
    for name, df in tables.items():
        key = _MART_KEYS.get(name)
        numbers = [f.name for f in df.schema.fields if f.name != key and f.dataType.typeName() in ("long", "integer", "double")]
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("medida"), F.col(c).cast("double").alias("valor")) for c in numbers]))
        rows = df.select(F.lit(name).alias("mart"), (F.col(key).cast("string") if key else F.lit("")).alias("chave"),
                         cells.alias("c")).select("mart", "chave", "c.medida", "c.valor")
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {f.__name__[2:]: f for f in (
    q_stream_daily_prices, q_stream_repeat_lock, q_stream_recency, q_stream_radar, q_stream_engagement, q_post_log,
    q_topic_log, q_retention_run, q_legacy_migration, q_purge_guard, q_breaker_scan, q_breaker_calls, q_response_top_up,
    q_response_provenance, q_response_recovery, q_editorial_picks, q_affiliate_urls, q_feed_tree_items, q_offers_csv,
    q_dashboard_marts)}


def build():
    return dict(QUERIES)
