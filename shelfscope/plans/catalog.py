"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or views Spark derives from them) in
full; parameters such as reference dates are query parameters, not row caps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfscope.operators import radar
from shelfscope.plans.oracle_sql import RADAR_DATES
from shelfscope.session import materialize
from shelfscope.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]


def _hist(spark, sf) -> DataFrame:
    return radar.daily_compaction(T.price_observations(T.table(spark, sf, "lineitem")))


def q_price_history_daily(spark, sf):
    return _hist(spark, sf)


def _stored_hist(spark, sf) -> DataFrame:
    """The price history as the radar reads it: a stored table (here the
    compaction of the driver observations, checkpointed once), so the offer
    lookup and the trailing window do not each recompute the compaction."""
    # only the columns the radar reads: Catalyst prunes the compaction to a
    # hash-aggregated min(price) with map-side combine before the checkpoint
    return materialize(_hist(spark, sf).select("sku", "loja", "data_coleta", "preco_min_dia"))


def q_price_radar(spark, sf):
    return radar.price_radar(_stored_hist(spark, sf), RADAR_DATES)


def q_radar_counters(spark, sf):
    return radar.radar_counters(radar.price_radar(_stored_hist(spark, sf), RADAR_DATES))


def q_radar_backfill(spark, sf):
    return radar.radar_backfill(_hist(spark, sf))




# ------------------------------------------------------------------ offers family
from pyspark.sql import functions as F  # noqa: E402

from shelfscope.functions import rules  # noqa: E402
from shelfscope.operators import selection as S  # noqa: E402
from shelfscope.session import materialize  # noqa: E402


def enriched_offers(spark, sf) -> DataFrame:
    """F1 catalogue + J1 radar on part-keyed history + P14/P23 + P18 score."""
    li, part = T.table(spark, sf, "lineitem"), T.table(spark, sf, "part")
    cat = T.offers_catalog(part, li)
    hist_part = radar.daily_compaction(T.price_observations(li, key="l_partkey"))
    offers = cat.select("sku", "loja", "oferta_dia", "preco_atual")
    flags = radar.radar_flags(radar.trailing_stats(offers, hist_part, offer_keys=()))
    cat = cat.join(flags.select("sku", "queda_real_percent", "menor_preco_historico", "preco_medio_historico"),
                   "sku", "left")
    cat = S.add_niche_and_model(cat, off=rules.TEST_OFF_NICHE_TERMS, strong=rules.TEST_STRONG_NICHE_TERMS,
                                cat_terms=rules.TEST_CATEGORY_NICHE_TERMS)
    return materialize(S.add_score(cat))


def q_offers_enriched(spark, sf):
    return enriched_offers(spark, sf)


def q_offers_dedup(spark, sf):
    li = T.table(spark, sf, "lineitem")
    listings = li.select(
        T.sku_for("l_partkey").alias("sku"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
        .alias("source_rank"),
        F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("idx"),
        F.col("l_suppkey").alias("seller"))
    return S.keep_first(listings, "sku", ["source_rank", "page", "idx"])


def q_route_counts(spark, sf):
    """A4: kept listings per store and route (route = source rank of the listing)."""
    d = q_offers_dedup(spark, sf)
    from shelfscope.functions.pricing import store_from_sku
    return d.groupBy(store_from_sku(F.col("sku")).alias("loja"), F.col("source_rank").alias("rota")).agg(
        F.count(F.lit(1)).alias("itens"))


def _events_now(ev):
    return ev.select(F.max("ts")).scalar()


def q_latest_posts(spark, sf):
    ev = T.table(spark, sf, "events")
    return S.latest_posts(T.posted_log(ev), _events_now(ev))


def q_repeat_lock(spark, sf):
    ev = T.table(spark, sf, "events")
    recent = S.latest_posts(T.posted_log(ev), _events_now(ev))
    return S.repeat_lock(T.user_offers(ev), recent)


def q_store_quota(spark, sf):
    return S.store_quota(enriched_offers(spark, sf))


def balanced(spark, sf) -> DataFrame:
    return materialize(S.balance_candidates(enriched_offers(spark, sf)))


def q_candidate_balance(spark, sf):
    return balanced(spark, sf).select("ord", "sku", "loja", "score_qualidade")


def q_fallback_selection(spark, sf):
    return S.fallback_selection(balanced(spark, sf))


def q_channel_top(spark, sf):
    return S.channel_top(enriched_offers(spark, sf))


def q_catalog_compaction(spark, sf):
    return S.compact_for_retry(balanced(spark, sf)).select("ord", "sku", "loja")


def opportunities_from(cat: DataFrame) -> DataFrame:
    """Model-response stand-in derived from the catalogue: some skus and URLs
    altered or blank, radar fields absent, so every lookup tier is exercised."""
    return cat.select(
        F.when(F.col("ord") % 3 == 0, F.concat(F.lit("X"), F.col("sku"))).otherwise(F.col("sku"))
        .alias("sku_selecionado"),
        F.upper(F.col("nome_produto")).alias("nome_produto"),
        F.when(F.col("ord") % 5 == 0, F.lit("")).otherwise(F.col("url_afiliado")).alias("url_afiliado"),
        F.lit(None).cast("string").alias("imagem_url"),
        F.lit(None).cast("double").alias("preco_antigo"),
        F.when(F.col("ord") % 2 == 0, F.col("categoria")).alias("categoria"),
        F.lit(None).cast("string").alias("loja"),
        F.lit(None).cast("double").alias("comissao_percent"),
        F.lit(None).cast("double").alias("lucro_estimado_reais"),
        F.lit(False).alias("menor_preco_historico"),
        F.lit(0.0).alias("queda_real_percent"),
        F.lit(0.0).alias("preco_medio_historico"),
    )


def q_rehydration(spark, sf):
    cat = enriched_offers(spark, sf)
    return S.rehydrate(opportunities_from(cat), cat)


def q_remaining_candidates(spark, sf):
    cands = balanced(spark, sf)
    picks = S.fallback_selection(cands)
    return S.remaining_candidates(cands, picks).select("ord", "sku", "nome_produto")


OFFERS_QUERIES = {
    "offers_enriched": q_offers_enriched,
    "offers_dedup": q_offers_dedup,
    "route_counts": q_route_counts,
    "latest_posts": q_latest_posts,
    "repeat_lock": q_repeat_lock,
    "store_quota": q_store_quota,
    "candidate_balance": q_candidate_balance,
    "fallback_selection": q_fallback_selection,
    "channel_top": q_channel_top,
    "catalog_compaction": q_catalog_compaction,
    "rehydration": q_rehydration,
    "remaining_candidates": q_remaining_candidates,
}


# -------------------------------------------------------------------- news family
from shelfscope.functions.text import clean_summary, headline, strip_urls, url_key  # noqa: E402
from shelfscope.operators import news as N  # noqa: E402


def _feed(spark, sf) -> DataFrame:
    return T.feed_items(T.table(spark, sf, "documents"))


def q_feed_items(spark, sf):
    return _feed(spark, sf).withColumn("resumo", clean_summary("titulo")).select(
        "doc_id", "fonte", "url", "publicado_em", "tema_normalizado", "url_hash", "resumo")


def _recent(spark, sf) -> DataFrame:
    f = _feed(spark, sf)
    return N.recent_window(f, f.select(F.max("publicado_em")).scalar())


def q_news_recent(spark, sf):
    return _recent(spark, sf).select("doc_id", "fonte", "publicado_em", "tema_normalizado")


def q_topic_dedup(spark, sf):
    return N.topic_coverage(_feed(spark, sf).select("doc_id", "publicado_em", "url_hash", "tema_normalizado")
                            ).select("doc_id", "ja_publicada", "tema_similar", "inedita")


def q_news_round_robin(spark, sf):
    return N.round_robin(_recent(spark, sf)).select("id_curto", "doc_id", "fonte", "publicado_em")


def q_page_url_dedup(spark, sf):
    pages = T.table(spark, sf, "pages").select("page_id", "url").withColumn("url_hash", url_key("url"))
    return S.keep_first(pages, "url_hash", ["page_id"]).select("url_hash", "page_id", "url")


def q_editorial_text(spark, sf):
    f = _feed(spark, sf)
    return N.editorial_columns(f).select("doc_id", "headline", "categoria_tag")


def q_editorial_footer(spark, sf):
    """P29 + P31."""
    f = _feed(spark, sf)
    return f.select("doc_id", N.with_footer(F.col("titulo"), F.col("fonte")).alias("texto_rodape"))


def q_text_without_urls(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", strip_urls("text").alias("texto_limpo"))


def q_highlight_marking(spark, sf):
    f = _feed(spark, sf).withColumn("headline", headline("titulo")).withColumn(
        "destaque", F.try_element_at(F.split(F.col("tema_normalizado"), " "), F.lit(3)))
    marks = N.mark_highlight(F.col("headline"), F.col("destaque"))
    return f.select(
        "doc_id", N.validated_highlight(F.col("destaque"), F.col("headline")).alias("destaque_valido"),
        F.array_join(F.transform(F.filter(marks, lambda m: m["destaque"]), lambda m: m["palavra"]), " ")
        .alias("palavras_destacadas"))


def q_published_today(spark, sf):
    f = _feed(spark, sf)
    now = f.select(F.max("publicado_em")).scalar()
    return N.published_on_local_day(f, F.to_date(N.local_time_fixed(now)))


NEWS_QUERIES = {
    "feed_items": q_feed_items,
    "news_recent": q_news_recent,
    "topic_dedup": q_topic_dedup,
    "news_round_robin": q_news_round_robin,
    "page_url_dedup": q_page_url_dedup,
    "editorial_text": q_editorial_text,
    "editorial_footer": q_editorial_footer,
    "text_without_urls": q_text_without_urls,
    "highlight_marking": q_highlight_marking,
    "published_today": q_published_today,
}


# ------------------------------------------------------------------ metrics family
from shelfscope.operators import metrics as Mx  # noqa: E402


def _runs(spark, sf) -> DataFrame:
    return Mx.run_status(T.run_metrics(T.table(spark, sf, "events")))


def q_run_status(spark, sf):
    return _runs(spark, sf)


def q_category_totals(spark, sf):
    ev = T.table(spark, sf, "events")
    counts = Mx.category_counts(ev.withColumn("run_date", F.to_date("ts")), "run_date", "event_type")
    return Mx.category_totals(counts)


def q_run_kpis(spark, sf):
    return Mx.run_kpis(_runs(spark, sf))


def q_audience_deltas(spark, sf):
    return Mx.audience_deltas(_runs(spark, sf))


def q_recent_runs(spark, sf):
    return Mx.last_runs(_runs(spark, sf), 40).select("posicao", "run_date", "status", "custo_x_usd")


def q_member_curve(spark, sf):
    return Mx.member_curve_bounds(_runs(spark, sf))


def _posts(spark, sf) -> DataFrame:
    return Mx.post_engagement(T.social_posts(T.table(spark, sf, "events")))


def q_post_engagement(spark, sf):
    return _posts(spark, sf).select("user_id", "created_time", "likes", "comments", "shares", "score", "title")


def q_top_posts(spark, sf):
    return Mx.top_posts(_posts(spark, sf)).select("user_id", "created_time", "score", "title")


def q_engagement_by_hour(spark, sf):
    p = _posts(spark, sf)
    return Mx.engagement_by_hour(p, F.hour(N.local_time_fixed(F.col("created_time"))))


def q_mean_engagement(spark, sf):
    return _posts(spark, sf).agg((F.sum("score").cast("double") / F.count(F.lit(1))).alias("media_engajamento"),
                                 F.count(F.lit(1)).alias("posts"))


def _ledger(spark, sf) -> DataFrame:
    return T.sales_ledger(T.table(spark, sf, "orders"))


def q_sales_kpis(spark, sf):
    cost = Mx.run_kpis(_runs(spark, sf)).select("total_x_brl").scalar()
    return Mx.sales_kpis(_ledger(spark, sf), cost)


def q_sales_conversion(spark, sf):
    return Mx.sales_conversion(_ledger(spark, sf))


def q_commission_by_platform(spark, sf):
    return Mx.commission_by_platform(_ledger(spark, sf))


METRICS_QUERIES = {
    "run_status": q_run_status,
    "category_totals": q_category_totals,
    "run_kpis": q_run_kpis,
    "audience_deltas": q_audience_deltas,
    "recent_runs": q_recent_runs,
    "member_curve": q_member_curve,
    "post_engagement": q_post_engagement,
    "top_posts": q_top_posts,
    "engagement_by_hour": q_engagement_by_hour,
    "mean_engagement": q_mean_engagement,
    "sales_kpis": q_sales_kpis,
    "sales_conversion": q_sales_conversion,
    "commission_by_platform": q_commission_by_platform,
}


# -------------------------------------------------------------- maintenance family
from shelfscope.operators import maintenance as Mt  # noqa: E402

UPSERT_LAG_DAYS = 30


def _upsert_batches(spark, sf):
    """Two write batches over the whole lineitem table: the second batch is the
    'R' lines of the last 30 days (a late upsert on days already written)."""
    li = T.table(spark, sf, "lineitem")
    split = F.date_sub(li.select(F.max("l_shipdate")).scalar().cast("date"), UPSERT_LAG_DAYS)
    late = (F.to_date("l_shipdate") >= split) & (F.col("l_returnflag") == "R")
    return T.price_observations(li.filter(~late)), T.price_observations(li.filter(late))


def q_price_upsert_merge(spark, sf):
    first, second = _upsert_batches(spark, sf)
    return Mt.merge_price_days(radar.daily_compaction(first), second)


def q_history_row_count(spark, sf):
    return _hist(spark, sf).agg(F.count(F.lit(1)).alias("linhas"))


def _retention_inputs(spark, sf):
    hist = _hist(spark, sf)
    ev = T.table(spark, sf, "events")
    feed = _feed(spark, sf)
    ref_day = hist.select(F.max("data_coleta")).scalar()
    ref_ev = ev.select(F.max("ts")).scalar()
    ref_feed = feed.select(F.max("publicado_em")).scalar()
    return {
        "historico_precos": (hist, "data_coleta", F.date_sub(ref_day, rules.RETENTION_PRICE_DAYS)),
        "historico_postados": (T.posted_log(ev), "postado_em",
                               ref_ev - F.make_dt_interval(F.lit(rules.RETENTION_POSTED_DAYS))),
        "pautas_rss": (feed, "publicado_em", ref_feed - F.make_dt_interval(F.lit(rules.RETENTION_TOPIC_DAYS))),
    }


def q_retention_purge(spark, sf):
    return Mt.retention_counts(_retention_inputs(spark, sf))


def q_row_loss_guard(spark, sf):
    c = Mt.retention_counts({k: v for k, v in _retention_inputs(spark, sf).items() if k == "historico_precos"})
    scen = c.select(F.lit("expurgo_justificado").alias("cenario"), (F.col("removidos") + F.col("restantes"))
                    .alias("baseline"), F.col("restantes").alias("atuais"), F.col("removidos").alias("justificados"))
    scen = scen.unionByName(c.select(F.lit("sem_justificativa").alias("cenario"),
                                     (F.col("removidos") + F.col("restantes")).alias("baseline"),
                                     F.col("restantes").alias("atuais"), F.lit(0).cast("bigint").alias("justificados")))
    g = Mt.row_loss_guard(F.col("baseline"), F.col("atuais"), F.col("justificados"))
    return scen.select("*", g.getField("ok").alias("ok"), g.getField("motivo").alias("motivo"),
                       g.getField("queda_injustificada_pct").alias("queda_injustificada_pct"))


def legacy_price_docs(spark, sf) -> DataFrame:
    """Legacy price JSON documents derived from the history: one single-entry
    {sku: {min, avg, count, last, updated}} map per history row (the parser
    handles any number of entries; a document never grows with the catalogue)."""
    h = _hist(spark, sf)
    entry = F.struct(F.col("preco_min_dia").alias("min"), F.lit(None).cast("double").alias("avg"),
                     F.lit(1).alias("count"), F.when(F.col("titulo") != "", F.col("preco_ultimo")).alias("last"),
                     F.date_format("data_coleta", "yyyy-MM-dd").alias("updated"))
    return h.select(F.to_json(F.create_map(F.col("sku"), entry)).alias("doc"))


def q_legacy_price_migration(spark, sf):
    obs = Mt.legacy_price_observations(legacy_price_docs(spark, sf), "doc", "2026-01-01")
    return obs.select("sku", "loja", "data_coleta", "preco", "preco_min_inicial")


MAINT_QUERIES = {
    "price_upsert_merge": q_price_upsert_merge,
    "history_row_count": q_history_row_count,
    "retention_purge": q_retention_purge,
    "row_loss_guard": q_row_loss_guard,
    "legacy_price_migration": q_legacy_price_migration,
}


# ------------------------------------------------------------------ ingest family
from shelfscope.operators import ingest as I  # noqa: E402


def _page_log(spark, sf) -> DataFrame:
    return T.page_log(T.table(spark, sf, "pages"))


def q_block_diagnosis(spark, sf):
    return I.block_diagnosis(_page_log(spark, sf)).select(
        "seq", "loja", "status_code", "suspeita_waf", "indicio", "title", "bytes")


def q_breaker_prefix(spark, sf):
    return I.breaker_prefix(I.block_diagnosis(_page_log(spark, sf))).select(
        "loja", "seq", "url", "chamadas", "breaker_ativado")


def q_page_prefix(spark, sf):
    li = T.table(spark, sf, "lineitem")
    listings = li.select(F.col("l_returnflag").alias("route"), F.col("l_linenumber").alias("page"),
                         T.sku_for("l_partkey").alias("sku"))
    return I.page_prefix(listings)


def q_page_json_offers(spark, sf):
    """S1 over the stored pages (pages without embedded listing JSON give no rows)."""
    pages = _page_log(spark, sf).select("seq", "url", "body")
    return I.page_json_offers(pages).select("seq", "idx", "sku", "nome_produto", "preco_atual", "preco_antigo",
                                            "percentual_desconto", "comissao_percent", "lucro_estimado_reais")


def q_page_card_offers(spark, sf):
    """S2 over the stored pages (pages without listing cards give no rows)."""
    pages = _page_log(spark, sf).select(F.col("seq").alias("page_key"), "body")
    return I.html_card_offers(pages).select("page_key", "idx", "sku", "nome_produto", "preco_atual",
                                            "preco_antigo", "percentual_desconto", "url_afiliado")


INGEST_QUERIES = {
    "block_diagnosis": q_block_diagnosis,
    "breaker_prefix": q_breaker_prefix,
    "page_prefix": q_page_prefix,
    "page_json_offers": q_page_json_offers,
    "page_card_offers": q_page_card_offers,
}


# ---------------------------------------------------------------- responses family
from shelfscope.operators import responses as Rs  # noqa: E402

RESPONSE_ITEMS = 20


def derived_responses(spark, sf) -> DataFrame:
    """Model-response payloads derived from the catalogue: one response per
    block of 20 consecutive part keys (bounded size), in four shapes: keyed
    object, fenced array, truncated text (MAX_TOKENS) and prose-wrapped object.
    Callers checkpoint the extracted texts: they stand for a stored responses
    table, and the generating expressions must not be re-inlined into every
    parse step."""
    part = T.table(spark, sf, "part")
    item = F.struct(T.sku_for("p_partkey").alias("sku_selecionado"), F.col("p_name").alias("nome_produto"),
                    F.when(F.col("p_partkey") % 4 == 0, F.lit(rules.STORE_A)).otherwise(F.lit(rules.STORE_B))
                    .alias("loja"), F.col("p_retailprice").alias("preco_atual"),
                    F.struct(F.col("p_brand").alias("titulo")).alias("copy_venda"))
    g = (part.groupBy(F.floor(F.col("p_partkey") / RESPONSE_ITEMS).alias("resposta_id"))
         .agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), item.alias("v")))).alias("xs")))
    g = g.withColumn("_items", F.transform("xs", lambda x: x["v"]))
    g = g.withColumn("_obj", F.to_json(F.struct(F.col("_items").alias("oportunidades"))))
    shape = F.col("resposta_id") % 4
    text = (F.when(shape == 0, F.col("_obj"))
            .when(shape == 1, F.concat(F.lit("```json\n"), F.to_json("_items"), F.lit("\n```")))
            .when(shape == 2, F.substring("_obj", 1, (F.length("_obj") * 0.7).cast("int")))
            .otherwise(F.concat(F.lit("Segue a selecao: "), F.to_json(F.struct(F.col("_items").alias("ofertas"))),
                                F.lit(" fim."))))
    g = g.withColumn("_text", text)
    reason = F.when(shape == 2, F.lit("MAX_TOKENS")).otherwise(F.lit("STOP"))
    payload = F.to_json(F.struct(F.array(F.struct(reason.alias("finish_reason"), F.struct(F.array(
        F.struct(F.col("_text").alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    return g.select("resposta_id", payload.alias("payload"))


def q_response_parse(spark, sf):
    r = materialize(Rs.with_response_text(derived_responses(spark, sf)).select("resposta_id", "texto",
                                                                              "finish_reason"))
    p = Rs.parse_responses(r)
    return p.select("resposta_id", "finish_reason", Rs.needs_retry("texto", "finish_reason").alias("precisa_retry"),
                    "origem", F.size("itens").alias("n_itens"))


def q_response_picks(spark, sf):
    r = materialize(Rs.with_response_text(derived_responses(spark, sf)).select("resposta_id", "texto"))
    p = Rs.parse_responses(r)
    return Rs.explode_picks(p, ["resposta_id"]).select(
        "resposta_id", "pos", "sku_selecionado", "nome_produto", "loja", "preco_atual", "copy_titulo")


RESPONSE_QUERIES = {
    "response_parse": q_response_parse,
    "response_picks": q_response_picks,
}


# ----------------------------------------------------------------- payload family
from shelfscope.operators import payloads as Pl  # noqa: E402


def _picks(spark, sf) -> DataFrame:
    return materialize(S.fallback_selection(balanced(spark, sf)))


def q_caption_microblog(spark, sf):
    p = _picks(spark, sf)
    return p.select("pos", "sku_selecionado", Pl.microblog_caption(p).alias("legenda"))


def q_caption_threads(spark, sf):
    p = _picks(spark, sf)
    return p.select("pos", "sku_selecionado", Pl.threads_caption(p).alias("legenda"))


def q_caption_page(spark, sf):
    p = _picks(spark, sf)
    return p.select("pos", "sku_selecionado", Pl.page_caption(p).alias("legenda"))


def q_caption_messaging(spark, sf):
    p = _picks(spark, sf)
    m = Pl.messaging_caption(p)
    return p.select("pos", "sku_selecionado", m.getField("legenda").alias("legenda"),
                    m.getField("botao").alias("botao"), m.getField("url").alias("url_botao"))


def q_digest_html(spark, sf):
    return Pl.digest_html(_picks(spark, sf))


def q_narration_text(spark, sf):
    p = _picks(spark, sf)
    return p.select("pos", "sku_selecionado", Pl.narration_text(p).alias("locucao"))


def q_offer_summary(spark, sf):
    return Pl.offer_summary(_picks(spark, sf))


def q_posted_enrichment(spark, sf):
    ev = T.table(spark, sf, "events")
    recent = S.latest_posts(T.posted_log(ev), _events_now(ev)).select("sku")
    cat = enriched_offers(spark, sf)  # one checkpointed catalogue for picks and lookup
    picks = materialize(S.fallback_selection(materialize(S.balance_candidates(cat))))
    posted = picks.select(F.col("sku_selecionado").alias("sku")).unionByName(recent).distinct()
    return Pl.enrich_posted(posted, cat)


def q_latest_top_posts(spark, sf):
    posts = _posts(spark, sf).withColumn("run_date", F.to_date("created_time"))
    r = Pl.latest_run_top_posts(posts)
    return r.select("run_date", F.size("top_posts").alias("n_top"),
                    F.array_join(F.transform("top_posts", lambda x: x["user_id"].cast("string")), ",")
                    .alias("top_users"))


def q_page_social_image(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", Pl.social_image(F.col("html")).alias("imagem_url"))


PAYLOAD_QUERIES = {
    "caption_microblog": q_caption_microblog,
    "caption_threads": q_caption_threads,
    "caption_page": q_caption_page,
    "caption_messaging": q_caption_messaging,
    "digest_html": q_digest_html,
    "narration_text": q_narration_text,
    "offer_summary": q_offer_summary,
    "posted_enrichment": q_posted_enrichment,
    "latest_top_posts": q_latest_top_posts,
    "page_social_image": q_page_social_image,
}


# ------------------------------------------------------------------- feed XML (S3)
from shelfscope.sources import feeds as Fd  # noqa: E402


def _xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


FEED_BLOCK = 50


def derived_feeds(spark, sf) -> DataFrame:
    """RSS documents built from the news items: one feed document per source
    and block of 50 consecutive document ids, so no document holds more than
    50 items however prolific a source is."""
    items = T.feed_items(T.table(spark, sf, "documents"))
    pub = F.concat(F.date_format("publicado_em", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    xml_item = F.concat(F.lit("<item><title>"), _xml_escape(F.col("titulo")), F.lit("</title><link>"),
                        _xml_escape(F.col("url")), F.lit("</link><description>"), _xml_escape(F.col("titulo")),
                        F.lit("</description><pubDate>"), pub, F.lit("</pubDate></item>"))
    block = F.floor(F.col("doc_id") / FEED_BLOCK)
    g = (items.groupBy("fonte", block.alias("bloco"))
         .agg(F.array_sort(F.collect_list(F.struct("doc_id", xml_item.alias("x")))).alias("xs")))
    return g.select("fonte", F.col("bloco").alias("feed_ord"),
                    F.concat(F.lit('<?xml version="1.0"?><rss><channel><title>'), _xml_escape(F.col("fonte")),
                             F.lit("</title>"), F.array_join(F.transform("xs", lambda e: e["x"]), ""),
                             F.lit("</channel></rss>")).alias("xml"))


def q_feed_xml_items(spark, sf):
    feeds = materialize(derived_feeds(spark, sf))  # stands for the fetched feed table
    now = T.feed_items(T.table(spark, sf, "documents")).select(F.max("publicado_em")).scalar()
    return Fd.news_from_feeds(feeds, now).select("fonte", "titulo", "url", "resumo", "tema_normalizado",
                                                 "publicado_em")


FEED_QUERIES = {"feed_xml_items": q_feed_xml_items}


def build() -> dict[str, Query]:
    out = {
        "price_history_daily": q_price_history_daily,
        "price_radar": q_price_radar,
        "radar_counters": q_radar_counters,
        "radar_backfill": q_radar_backfill,
    }
    out.update(OFFERS_QUERIES)
    out.update(NEWS_QUERIES)
    out.update(METRICS_QUERIES)
    out.update(MAINT_QUERIES)
    out.update(INGEST_QUERIES)
    out.update(RESPONSE_QUERIES)
    out.update(PAYLOAD_QUERIES)
    out.update(FEED_QUERIES)
    from shelfscope.plans import jobs, records
    out.update(jobs.build())
    out.update(records.build())
    return out
