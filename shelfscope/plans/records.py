"""Registered queries over derived documents and files: listing pages (JSON and cards), API
documents, run files, card texts, history scans, and branches that the plain driver tables
never reach.

Only the stand-in documents are made here, in the form a job expects, from the driver
tables; the work on them is the library's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscope.functions import rules
from shelfscope.functions.text import url_key
from shelfscope.operators import ingest as I
from shelfscope.operators import metrics as Mx
from shelfscope.operators import payloads as Pl
from shelfscope.operators import selection as S
from shelfscope.operators.maintenance import HISTORY_SCHEMA, upsert_price_days
from shelfscope.plans import catalog as C
from shelfscope.plans.jobs import JobFolder, arriving
from shelfscope.session import materialize
from shelfscope.sources import sinks as Sk
from shelfscope.sources import social as So
from shelfscope.sources import tables as T
from shelfscope.streaming import streams as St

PAGE_PARTS = 12


def _collected(df, key, item):
    return df.groupBy(key.alias("seq")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("v")))),
                                                        lambda x: x["v"]).alias("xs"))


# ------------------------------------------------------------------- listing pages
def json_pages(spark, sf):
    """Pages of twelve consecutive parts with embedded listing JSON; sellers and images in all their forms, prices
    absent, bad or implausible on some products, every fifth page not served, every seventh blocked."""
    k, retail = F.col("p_partkey"), F.col("p_retailprice")
    cur = F.floor(retail * F.when(k % 17 == 0, F.lit(0.05)).otherwise(0.5 + (k % 40) / 100.0) * 100.0 + 0.5) / 100.0
    price = F.concat(F.lit('{"price":"'), retail.cast("string"), F.lit('"'), F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(
        F.lit(',"fullPrice":"'), F.when(k % 13 == 0, F.lit("consulte")).otherwise(cur.cast("string")), F.lit('"'))), F.lit("}"))
    seller = (F.when(k % 4 == 0, F.lit(',"seller":{"id":"MagazineLuiza"}')).when(k % 4 == 1, F.lit(',"seller":{"id":"","description":"Loja D"}'))
              .when(k % 4 == 2, F.lit(',"seller":"Loja T"')).otherwise(F.lit("")))
    image = (F.when(k % 3 == 0, F.concat(F.lit(',"image":"//img.example.com/{w}x{h}/'), k.cast("string"), F.lit('.jpg"')))
             .when(k % 3 == 1, F.concat(F.lit(',"image":{"url":"https://img.example.com/'), k.cast("string"), F.lit('"}')))
             .otherwise(F.concat(F.lit(',"images":["https://img.example.com/l/'), k.cast("string"), F.lit('"]'))))
    title = F.concat(F.col("p_name"), F.when(k % 19 == 0, F.lit(" com cabo")).otherwise(F.lit("")))
    item = F.concat(F.lit('{"id":"'), k.cast("string"), F.lit('","title":"'), title, F.lit('","url":"/p/'), k.cast("string"),
                    F.lit("/?seller_id=loja"), (k % 3).cast("string"), F.lit('","price":'), price, F.lit(',"category":{"name":"'),
                    F.when(k % 6 == 0, F.lit("")).otherwise(F.col("p_type")), F.lit('"}'), seller, image, F.lit("}"))
    page = F.floor(k / PAGE_PARTS)
    g = _collected(T.table(spark, sf, "part"), page, item)
    paging = F.when(F.col("seq") % 6 == 0, F.lit("")).otherwise(
        F.concat(F.lit(',"pagination":{"pages":'), (F.col("seq") % 7 + 1).cast("string"), F.lit("}")))
    doc = F.concat(F.lit('{"props":{"pageProps":{"data":{"search":{"products":['), F.array_join("xs", ","), F.lit("]"), paging,
                   F.lit("}}}}}"))
    body = F.when(F.col("seq") % 7 == 6, F.lit("<html>captcha</html>")).otherwise(F.concat(
        F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), doc, F.lit("</script></html>")))
    return g.select("seq", F.when(F.col("seq") % 5 == 4, 503).otherwise(200).alias("status_code"), body.alias("body"))


def _json_offers(spark, sf):
    return I.page_json_offers(materialize(json_pages(spark, sf))).drop("status_code")


def q_listing_json_offers(spark, sf):
    """S1 with P1, P2, P4, P6 to P10."""
    return _json_offers(spark, sf)


def _brl(units):
    """Whole cents as Brazilian price text without currency."""
    return F.concat(F.replace(F.format_number(F.floor(units / 100), 0), F.lit(","), F.lit(".")), F.lit(","),
                    F.lpad((units % 100).cast("string"), 2, "0"))


def card_pages(spark, sf):
    """Pages of twelve consecutive parts as listing cards, in the three layouts; on every eighth page the layouts mix."""
    k, retail = F.col("p_partkey"), F.col("p_retailprice")
    cur, old = F.floor(retail * 0.8 * 100.0 + 0.5).cast("long"), F.floor(retail * 100.0 + 0.5).cast("long")
    ks = k.cast("string")
    href = (F.when(k % 3 == 0, F.concat(F.lit("https://produto.example.com/MLB-"), ks, F.lit("-x#pos=1")))
            .when(k % 3 == 1, F.concat(F.lit("/nome/p/mlb"), ks, F.lit("?matt_tool=&amp;pos=2"))).otherwise(
        F.concat(F.lit("//produto.example.com/MLB"), ks)))
    title = F.concat(F.lit("  "), F.col("p_name"), F.lit("\n gamer "), F.when(k % 10 == 3, F.lit("com cabo")).when(
        k % 10 == 4, F.lit("fechadura")).otherwise(F.lit("X")))
    badge = F.when(k % 3 == 0, F.lit('<span class="poly-price__discount">35% OFF</span>')).otherwise(F.lit(""))
    fraction = F.concat(F.lit('<span class="andes-money-amount__fraction">'), F.split(_brl(cur), ",")[0],
                        F.lit('</span>,<span class="andes-money-amount__cents">'), F.split(_brl(cur), ",")[1], F.lit("</span>"))
    image = (F.when(k % 4 == 0, F.concat(F.lit('src="data:image/gif;base64,AA" data-src="https://img.example.com/'), ks, F.lit('.webp"')))
             .when(k % 4 == 1, F.concat(F.lit('srcset="//img.example.com/'), ks, F.lit('-2x.webp 2x, //img.example.com/s.webp 1x"')))
             .when(k % 4 == 2, F.concat(F.lit('src="https://img.example.com/'), ks, F.lit('.png"'))).otherwise(F.lit('src="data:,"')))
    before = F.when(k % 4 != 0, F.concat(F.lit("R$ "), _brl(old)))
    poly = F.concat(F.lit('<div class="poly-card"><img class="poly-component__picture" '), image, F.lit('><a class="poly-component__title" href="'),
                    href, F.lit('">'), title, F.lit("</a>"), F.coalesce(F.concat(F.lit('<s class="andes-money-amount">'), before, F.lit("</s>")), F.lit("")),
                    F.lit('<div class="poly-price__current">'), fraction, F.lit("</div>"), badge, F.lit("</div>"))
    promo = F.concat(F.lit('<li class="promotion-item"><a href="'), href, F.lit('"><img class="promotion-item__img" '), image,
                     F.lit('><p class="promotion-item__title">'), title, F.lit("</p>"),
                     F.coalesce(F.concat(F.lit('<span class="promotion-item__oldprice">'), before, F.lit("</span>")), F.lit("")),
                     F.lit('<span class="promotion-item__price">'), fraction, F.lit("</span>"), badge, F.lit("</a></li>"))
    search = F.concat(F.lit('<li class="ui-search-layout__item"><h2>'), title, F.lit('</h2><a href="'), href, F.lit('">x</a><img '), image,
                      F.lit('><div class="ui-search-price__second-line">R$ '), _brl(cur), F.lit("</div>"),
                      F.coalesce(F.concat(F.lit('<span class="ui-search-price__part--original">'), before, F.lit("</span>")), F.lit("")), badge, F.lit("</li>"))
    page = F.floor(k / PAGE_PARTS)
    layout = page % 3
    mixed = (page % 8 == 7) & (k % 2 == 0)
    g = _collected(T.table(spark, sf, "part"), page, F.when(mixed, search).when(layout == 0, poly).when(layout == 1, promo).otherwise(search))
    return g.select(F.col("seq").alias("page_key"), F.concat(F.lit("<html><body><ol>"), F.array_join("xs", "\n"), F.lit("</ol></body>")).alias("body"))


def _card_offers(spark, sf):
    return I.html_card_offers(materialize(card_pages(spark, sf)))


def q_listing_card_offers(spark, sf):
    """S2 with P3, P5, P11 to P13, P15."""
    return _card_offers(spark, sf)


def q_offers_union(spark, sf):
    """Offers of both stores' pages in one table (columns that one lacks are null), first row of a sku."""
    both = S.union_routes(_json_offers(spark, sf).withColumn("rota", F.lit("json")), _card_offers(spark, sf).withColumn("rota", F.lit("cards")))
    both = materialize(both)      # read twice: the pages are parsed once
    again = S.union_routes(both, both.withColumn("rota", F.lit("outra")))
    first = S.keep_first(again, "sku", ["rota", "idx"])
    return first.select("sku", "rota", "idx", "seq", "page_key", "total_paginas", "preco_atual")


# --------------------------------------------------------------------- API documents
def q_social_documents(spark, sf):
    """A document a day of post objects, counters and texts absent on some."""
    p = T.social_posts(T.table(spark, sf, "events"))
    u = F.col("user_id")
    item = F.struct(
        F.concat_ws("_", u.cast("string"), F.date_format("created_time", "yyyyMMddHH")).alias("id"),
        F.when(u % 7 != 0, F.col("message")).alias("message"), F.date_format("created_time", "yyyy-MM-dd'T'HH:mm:ss+0000").alias("created_time"),
        F.when(u % 5 != 0, F.struct(F.struct(F.col("likes").alias("total_count")).alias("summary"))).alias("likes"),
        F.struct(F.struct(F.when(u % 3 != 0, F.col("comments")).alias("total_count")).alias("summary")).alias("comments"),
        F.when(F.col("shares") > 0, F.struct(F.col("shares").alias("count"))).alias("shares"))
    docs = materialize(p.groupBy(F.to_date("created_time").alias("dia"), (u % 16).alias("parte")).agg(
        F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("doc")).select("doc"))
    return Mx.post_engagement(So.posts_from_json(docs)).select("post_id", "created_time", "likes", "comments", "shares", "score", "title",
                                                               So.display_date(F.col("created_raw")).alias("data_painel"))


def q_insight_documents(spark, sf):
    """Per day a document of metrics, numbers and maps, of which the last value counts."""
    ev = T.table(spark, sf, "events")
    by = ev.groupBy(F.to_date("ts").alias("dia"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    d = by.groupBy("dia").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    more = F.map_concat("m", F.create_map(F.lit("zz"), F.lit(0).cast("long"), F.lit("aa"), F.lit(-1).cast("long")))

    def metric(name, *values):
        return F.concat(F.lit(f'{{"name":"{name}_'), F.col("dia").cast("string"), F.lit('","title":"t","values":['),
                        F.concat_ws(",", *[F.concat(F.lit('{"value":'), v, F.lit("}")) for v in values]), F.lit("]}"))
    doc = F.concat(F.lit('{"data":['), metric("alcance", F.lit("1"), F.col("total").cast("string")), F.lit(","),
                   metric("tipos", F.to_json(more)), F.lit(","), F.concat(F.lit('{"name":"vazio_'), F.col("dia").cast("string"), F.lit('","values":[]}')), F.lit("]}"))
    m = So.insights_from_json(materialize(d.select(doc.alias("doc"))))
    return m.select("metrica", "valor", F.array_join(F.transform("top_entradas", lambda e: e["value"].cast("string")), ",").alias("maiores"))


# ----------------------------------------------------------------------------- files
def q_run_files(spark, sf):
    """Runs appended as JSON lines, older ones in a file that holds one array, and a broken file, read back together."""
    folder = JobFolder(spark, "s8")
    runs = Mx.run_status(T.run_metrics(T.table(spark, sf, "events"))).withColumn("timestamp", F.date_format("run_date", "yyyy-MM-dd"))
    runs = materialize(runs)
    for half in (0, 1):
        Sk.append_run(folder / "runs", runs.where((F.dayofmonth("run_date") > 10) & (F.col("postados_x") % 2 == half)))
    old = runs.where(F.dayofmonth("run_date") <= 10).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(F.to_json(F.struct("*"))), ",\n"), F.lit("\n]")).alias("value"))
    old.coalesce(1).write.mode("append").text(folder / "runs")
    spark.createDataFrame([('[{"timestamp": "2020-01-01", "stat',)], "value string").write.mode("append").text(folder / "runs")
    return folder.finished(Sk.read_run_metrics(spark, folder / "runs").select("timestamp", "status", "postados_x", "custo_x_usd", "membros_telegram"))


def q_ledger_files(spark, sf):
    """The ledger exported as JSON lines, an entry deleted, read back as CSV lines."""
    folder = JobFolder(spark, "s9")
    ledger = T.sales_ledger(T.table(spark, sf, "orders")).select(
        F.col("id").cast("string").alias("id"), F.date_format("date", "yyyy-MM-dd").alias("date"), "platform", "clicks", "sales", "commission",
        F.concat(F.lit('nota "'), F.col("note"), F.lit('"; fim')).alias("note"))
    Sk.export_ledger(ledger, folder / "livro")
    back = Sk.delete_entry(Sk.read_ledger(spark, folder / "livro"), "1")
    return folder.finished(Sk.ledger_csv_lines(back))


def q_candidate_records(spark, sf):
    """Candidates as JSON without their internal fields, read back."""
    text = Sk.candidate_records(C.enriched_offers(spark, sf))
    row = F.from_json("json", "sku string, nome_produto string, preco_atual double, url_afiliado string, imagem_url string, score_qualidade double")
    return text.select(row.alias("r")).select("r.*")


def q_history_scan(spark, sf):
    """One product's days in a range of the stored history, read from its months alone."""
    folder = JobFolder(spark, "s10")
    upsert_price_days(spark, folder / "hist", T.price_observations(T.table(spark, sf, "lineitem")))
    hist = spark.read.schema(HISTORY_SCHEMA + ", mes string").parquet(folder / "hist")
    return folder.finished(Pl.scan_history(hist, "ML_1", rules.STORE_B, "1997-02-10", "1999-11-20").select(
        "sku", "loja", "data_coleta", "preco_min_dia", "preco_ultimo"))


# ------------------------------------------------------------------ texts and branches
def q_card_texts(spark, sf):
    """Price, old price, saving and badge texts of the offer cards."""
    offers = C.enriched_offers(spark, sf)
    return offers.select("sku", *[c.alias(n) for n, c in Pl.card_texts(offers).items()])


def q_channel_top_picks(spark, sf):
    """P14 over name, category and copy title, P19 and K2 on the run's picks."""
    p = C._picks(spark, sf).withColumnsRenamed({"sku_selecionado": "sku"}).withColumn("ord", F.col("pos").cast("long"))
    rows = S.add_niche_and_model(p, off=rules.TEST_OFF_NICHE_TERMS, strong=rules.TEST_STRONG_NICHE_TERMS,
                                 cat_terms=rules.TEST_CATEGORY_NICHE_TERMS, title_col="copy_titulo")
    return S.channel_top(materialize(rows.drop("pos")))


def q_publication_window(spark, sf):
    """P39 with zone and P40, over the times of all events."""
    local = C.N.local_time_zone(F.col("ts"))
    w = C.N.publication_window(local)
    return T.table(spark, sf, "events").select("event_id", F.hour(local).alias("hora"), w["executar"].alias("executar"), w["motivo"].alias("motivo"))


def q_social_image_pages(spark, sf):
    """P26 on pages (derived from documents) that carry social images in every form."""
    k = F.col("doc_id")
    url = F.concat(F.lit("cdn.example.com/i"), k.cast("string"), F.lit(".jpg?a=1&amp;b=2"))
    tag = (F.when(k % 7 == 0, F.concat(F.lit('<meta property="og:image" content="https://'), url, F.lit('">')))
           .when(k % 7 == 1, F.concat(F.lit("<META content='//"), url, F.lit("' data-x property='og:image:secure_url'/>")))
           .when(k % 7 == 2, F.concat(F.lit('<meta name="twitter:image:src" content="http://'), url, F.lit('">')))
           .when(k % 7 == 3, F.concat(F.lit('<meta content="https://'), url, F.lit('" name="twitter:image"><meta property="og:image" content="data:x">')))
           .when(k % 7 == 4, F.lit('<meta property="og:image" content="ftp://x">')).when(k % 7 == 5, F.lit('<meta property="og:title" content="https://x">'))
           .otherwise(F.concat(F.lit('<meta name="twitter:image" content="https://t.example.com/t"><meta property="og:image" content="https://'), url, F.lit('">'))))
    html = F.concat(F.lit("<html><head>"), tag, F.lit("</head>"), F.replace(F.coalesce("text", F.lit("")), F.lit("<"), F.lit(" ")))
    return T.table(spark, sf, "documents").select("doc_id", Pl.social_image(html).alias("imagem_url"))


def q_run_status_hourly(spark, sf):
    """P37 on runs of an hour and user group, where messages or a store may be missing."""
    ev = T.table(spark, sf, "events")
    et = F.col("event_type")
    runs = ev.groupBy(F.to_timestamp_ntz(F.date_trunc("hour", "ts")).alias("run"), (F.col("user_id") % 5).alias("grupo")).agg(
        F.count_if(et == "view").alias("raspados_ml"), F.count_if(et == "click").alias("raspados_magalu"),
        F.count_if(et == "purchase").alias("postados_telegram"), F.count_if(et == "signup").alias("postados_x"))
    return Mx.run_status(runs).select("run", "grupo", "status", "custo_x_usd")


def q_page_stop(spark, sf):
    """W2 where the stop fires: routes whose later pages repeat products, are empty or blocked."""
    li = T.table(spark, sf, "lineitem")
    items = li.select(F.col("l_suppkey").alias("route"), F.col("l_orderkey").alias("page"),
                      F.when(F.col("l_orderkey") % 97 != 0, (F.col("l_partkey") % 60).cast("string")).alias("sku"),
                      ((F.col("l_orderkey") % 1009 == 5) & (F.col("l_linenumber") == 1)).alias("bloqueada"))
    return I.page_prefix(items, blocked="bloqueada")


def q_candidate_balance_one_store(spark, sf):
    """K3: with only one store's offers the global ranking is taken."""
    offers = materialize(C.enriched_offers(spark, sf).where(F.col("loja") == rules.STORE_B))
    return S.balance_candidates(offers).select("ord", "sku", "loja", "score_qualidade")


def q_stream_first_url(spark, sf):
    """Items whose URL others share arrive in two parts; every URL comes once."""
    folder = JobFolder(spark, "t3")
    feed = C._feed(spark, sf).select("doc_id", "publicado_em").withColumn("url_hash", url_key(F.concat(
        F.lit("https://x.example.com/"), (F.floor(F.col("doc_id") / 4)).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.lit("/")).otherwise(F.lit("#a")))))
    arriving(folder, [feed.where("doc_id % 3 = 0"), feed.where("doc_id % 3 <> 0")], lambda df, ckpt: St.start(
        St.first_url_within(df), spark, "urls", checkpoint=ckpt).awaitTermination())
    out = spark.read.schema("doc_id long, publicado_em timestamp_ntz, url_hash string").parquet(folder / "stream/rows")
    return folder.finished(out.select("url_hash"))


QUERIES = {f.__name__[2:]: f for f in (
    q_listing_json_offers, q_listing_card_offers, q_offers_union, q_social_documents, q_insight_documents, q_run_files, q_ledger_files,
    q_candidate_records, q_history_scan, q_card_texts, q_channel_top_picks, q_publication_window, q_social_image_pages, q_run_status_hourly, q_page_stop,
    q_candidate_balance_one_store, q_stream_first_url)}


def build():
    return dict(QUERIES)
