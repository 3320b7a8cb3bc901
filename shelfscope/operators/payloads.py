"""Channel payload columns and small projections: microblog, threads and page
captions (P33),
narration text (P34), offer summary (P41), posted-sku enrichment (J10),
latest run with top posts (W9), social image of a page (P26), history scan (S10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions.pricing import store_from_sku
from shelfscope.functions.text import col_, py_strip, truncate_ellipsis

# Fixed values of the microblog caption and the narration.
BADGE_B = "🟡 [MERCADO LIVRE]"
BADGE_A = "🔵 [MAGALU]"
MIN_PRICE_LINE = "📉 MENOR PREÇO REGISTRADO!"
CAPTION_FOOTER = ["📲 Link da oferta no nosso Telegram: @canal (link na bio!)",
                  "#Promocao #Oferta #Tech #Gamer"]
THREADS_FOOTER = "📢 Mais ofertas no Telegram: @canal"
THREADS_BUY = "🛒 Compre aqui: "
THREADS_MAX = 495
PAGE_DEFAULT_CTA = "Aproveite antes que o preço suba!"
PAGE_FOOTER = ["👇 Link direto da oferta no 1º comentário!",
               "📢 Mais promoções diárias no Telegram: @canal", "",
               "#Promocao #Oferta #Desconto #Tech #Gamer"]
MSG_BADGE_B = "🟡 <b>[MERCADO LIVRE - FULL]</b>"
MSG_BADGE_A = "🔵 <b>[MAGALU]</b>"
MSG_BUTTON_B = "🛒 VER NO MERCADO LIVRE"
MSG_BUTTON_A = "🛒 GARANTIR OFERTA NO MAGALU"
MSG_MIN_PRICE = "📉 <b>MENOR PREÇO REGISTRADO!</b>"
NARRATION_OPEN_MIN = "Menor preço registrado!"
NARRATION_OPEN = "Alerta de oferta!"
NARRATION_CLOSE = "Link no primeiro comentário!"


def _money(c) -> F.Column:
    return F.format_string("%.2f", c)


def _half_even_int(c) -> F.Column:
    """Python int(round(x)) / '%.0f': half-to-even on the exact binary value."""
    return F.bround(c, 0).cast("bigint")


def microblog_caption(df: DataFrame) -> F.Column:
    """P33 (microblog channel): store badge, minimum-price line, title cut to
    85 + '...' above 88 chars, old and current price lines, footer; no URL."""
    title, price, badge, min_line = _caption_head(df)
    old_line, now_line = _price_lines(price, "✅ Por: R$ ")
    # concat_ws skips nulls: optional lines simply disappear, blank lines stay
    return F.concat_ws("\n", badge, min_line, F.concat(F.lit("🔥 "), truncate_ellipsis(title, 88, 85)), F.lit(""),
                       old_line, now_line, F.lit(""), *[F.lit(x) for x in CAPTION_FOOTER])


def _caption_head(df: DataFrame):
    """Badge, minimum-price line and '🔥 title' shared by the captions."""
    title = py_strip(F.coalesce(F.when(py_strip(F.coalesce("copy_titulo", F.lit(""))) != "", F.col("copy_titulo")),
                                F.when(py_strip(F.coalesce("nome_produto", F.lit(""))) != "",
                                       F.col("nome_produto")), F.lit("Super Oferta!")))
    price = F.coalesce(F.col("preco_atual"), F.lit(0.0))
    url = F.lower(F.coalesce(F.col("url_afiliado"), F.lit("")))
    store = F.coalesce(F.when(F.coalesce(F.col("loja"), F.lit("")) != "", F.col("loja")),
                       F.when(url.contains("mercadolivre"), F.lit("Mercado Livre")).otherwise(F.lit("Magalu")))
    badge = F.when(F.lower(store).contains("mercado"), F.lit(BADGE_B)).otherwise(F.lit(BADGE_A))
    media = F.coalesce(F.col("preco_medio_historico"), F.lit(0.0))
    min_line = F.when(F.coalesce(F.col("menor_preco_historico"), F.lit(False)),
                      F.when(media > price, F.concat(F.lit(MIN_PRICE_LINE + " (Média anterior: R$ "), _money(media),
                                                     F.lit(")"))).otherwise(F.lit(MIN_PRICE_LINE)))
    return title, price, badge, min_line


def _price_lines(price, now_prefix: str):
    disc = F.coalesce(F.col("percentual_desconto"), F.lit(0.0))
    old = F.col("preco_antigo")
    old_line = F.when(old.isNotNull() & (old != 0) & (old > price), F.concat(F.lit("❌ De: R$ "), _money(old)))
    now_line = F.when(disc >= 5, F.concat(F.lit(now_prefix), _money(price), F.lit(" ("),
                                          _half_even_int(disc).cast("string"), F.lit("% OFF!)"))).otherwise(
        F.concat(F.lit(now_prefix), _money(price)))
    return old_line, now_line


def reais(c) -> F.Column:
    """``R$ 1.234,56``."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(c.cast("double"), 2), ",.", ".,"))


def card_texts(df: DataFrame) -> dict[str, F.Column]:
    """P33 (offer cards): price, struck-out old price and saving (if the old price is higher), discount badge from 5 %."""
    price, old = F.coalesce(F.col("preco_atual"), F.lit(0.0)), F.col("preco_antigo")
    disc = F.coalesce(F.col("percentual_desconto"), F.lit(0.0))
    return {"preco": reais(price), "preco_de": F.when(old > price, F.concat(F.lit("DE "), reais(old))),
            "economia": F.when(old > price, F.concat(F.lit("ECONOMIZE "), reais(old - price))),
            "selo": F.when(disc >= 5, F.concat(F.lit("-"), _half_even_int(disc).cast("string"), F.lit("% OFF")))}


def threads_caption(df: DataFrame) -> F.Column:
    """P33 (threads channel): title, body cut to 140, price lines, buy link when
    present, footer; whole text cut to 495 characters."""
    title, price, badge, min_line = _caption_head(df)
    body = py_strip(F.coalesce(F.col("copy_corpo"), F.lit("")))
    url = py_strip(F.coalesce(F.col("url_afiliado"), F.lit("")))
    old_line, now_line = _price_lines(price, "✅ Por: R$ ")
    has_body, has_url = body != "", url != ""
    text = F.concat_ws("\n", badge, min_line, F.concat(F.lit("🔥 "), title), F.lit(""),
                       F.when(has_body, F.substring(body, 1, 140)), F.when(has_body, F.lit("")),
                       old_line, now_line, F.when(has_url, F.lit("")),
                       F.when(has_url, F.concat(F.lit(THREADS_BUY), url)), F.lit(""), F.lit(THREADS_FOOTER))
    return F.substring(text, 1, THREADS_MAX)


def page_caption(df: DataFrame) -> F.Column:
    """P33 (page feed): no link in the post; body, price lines, call to action, footer."""
    title, price, badge, min_line = _caption_head(df)
    body = py_strip(F.coalesce(F.col("copy_corpo"), F.lit("")))
    cta = py_strip(F.coalesce(F.when(F.coalesce(F.col("copy_cta"), F.lit("")) != "", F.col("copy_cta")),
                              F.lit(PAGE_DEFAULT_CTA)))
    old_line, now_line = _price_lines(price, "✅ Por apenas: R$ ")
    has_body = body != ""
    return F.concat_ws("\n", badge, min_line, F.concat(F.lit("🔥 "), title), F.lit(""),
                       F.when(has_body, body), F.when(has_body, F.lit("")), old_line, now_line, F.lit(""),
                       F.concat(F.lit("⚡ "), cta), *[F.lit(x) for x in PAGE_FOOTER])


def messaging_caption(df: DataFrame) -> F.Column:
    """P33 (messaging channel): struct(legenda, botao, url) with the HTML-marked
    caption and the inline buy button (present when the pick has a URL)."""
    title = F.coalesce(F.when(F.coalesce(F.col("copy_titulo"), F.lit("")) != "", F.col("copy_titulo")),
                       F.col("nome_produto"), F.lit("Super Oferta!"))
    price = F.coalesce(F.col("preco_atual"), F.lit(0.0))
    disc = F.coalesce(F.col("percentual_desconto"), F.lit(0.0))
    url = F.coalesce(F.col("url_afiliado"), F.lit(""))
    store = F.coalesce(F.when(F.coalesce(F.col("loja"), F.lit("")) != "", F.col("loja")),
                       F.when(F.lower(url).contains("mercadolivre"), F.lit("Mercado Livre")).otherwise(F.lit("Magalu")))
    is_b = F.lower(store).contains("mercado")
    media = F.coalesce(F.col("preco_medio_historico"), F.lit(0.0))
    seal = F.when(F.coalesce(F.col("menor_preco_historico"), F.lit(False)), F.when(
        media > price, F.concat(F.lit(MSG_MIN_PRICE + " (Média anterior: R$ "), _money(media), F.lit(")\n")))
        .otherwise(F.lit(MSG_MIN_PRICE + "\n"))).otherwise(F.lit(""))
    body = F.coalesce(F.col("copy_corpo"), F.lit(""))
    old = F.col("preco_antigo")
    old_line = F.when(old.isNotNull() & (old != 0) & (old > price),
                      F.concat(F.lit("❌ De: <s>R$ "), _money(old), F.lit("</s>\n"))).otherwise(F.lit(""))
    text = F.concat(F.when(is_b, F.lit(MSG_BADGE_B)).otherwise(F.lit(MSG_BADGE_A)), F.lit("\n"), seal,
                    F.lit("🔥 <b>"), title, F.lit("</b>\n\n"),
                    F.when(body != "", F.concat(body, F.lit("\n\n"))).otherwise(F.lit("")), old_line,
                    F.lit("✅ <b>Por apenas: R$ "), _money(price), F.lit("</b>\n"),
                    F.lit("📉 <b>Desconto: "), _half_even_int(disc).cast("string"), F.lit("% OFF</b>\n\n"),
                    F.lit("⚡ <i>"), F.coalesce(F.col("copy_cta"), F.lit("Garanta o seu com desconto!")), F.lit("</i>"))
    button = F.when(url != "", F.when(is_b, F.lit(MSG_BUTTON_B)).otherwise(F.lit(MSG_BUTTON_A)))
    return F.struct(text.alias("legenda"), button.alias("botao"), F.when(url != "", url).alias("url"))


# Fixed value: the e-mail digest block of one pick ({name} placeholders).
DIGEST_TEMPLATE = (
    "\n"
    '            <div style="border: 1px solid #ddd; border-radius: 8px; margin-bottom: 20px; padding: 16px; '
    'background-color: #f9f9f9;">\n'
    '                <h3 style="color: #0086ff; margin-top: 0;">[{loja}] Oportunidade {n}: {nome}</h3>\n'
    "                <p>\n"
    "                    <strong>Preço:</strong> R$ {preco} | \n"
    '                    <strong>Desconto:</strong> <span style="color: #c00;">{desconto}% OFF</span> | \n'
    '                    <strong>Comissão Afiliado:</strong> <span style="color: #008000; font-weight: bold;">'
    "{comissao} (~{lucro}/venda)</span>\n"
    "                </p>\n"
    '                <div style="background-color: #fff; border: 1px dashed #ccc; padding: 12px; margin-top: 15px;">\n'
    "                    <p><strong>Título:</strong> {titulo}</p>\n"
    "                    <p><strong>Corpo:</strong> {corpo}</p>\n"
    "                    <p><strong>CTA:</strong> {cta}</p>\n"
    "                </div>\n"
    '                <a href="{url}" style="display: inline-block; background-color: #0086ff; color: #ffffff; '
    "padding: 10px 15px; text-decoration: none; border-radius: 5px; font-weight: bold; margin-top: 15px;\">"
    "Ver Oferta</a>\n"
    "            </div>\n"
    "            ")


def _fill(template: str, values: dict) -> F.Column:
    import re as _re
    parts, pos = [], 0
    for m in _re.finditer(r"\{(\w+)\}", template):
        parts.append(F.lit(template[pos:m.start()]))
        parts.append(values[m.group(1)])
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def digest_block(df: DataFrame) -> F.Column:
    """P33 (e-mail digest): one HTML block per pick; commission 'N/A' when
    unknown, profit derived from price x commission when missing."""
    price = F.coalesce(F.col("preco_atual"), F.lit(0.0))
    comm = F.col("comissao_percent")
    lucro = F.coalesce(F.col("lucro_estimado_reais"),
                       F.when(comm.isNotNull(), F.bround(price * (comm / 100.0), 2)))
    values = {
        "loja": F.coalesce(F.col("loja"), F.lit("Oferta")),
        "n": F.col("pos").cast("string"),
        "nome": F.coalesce(F.col("nome_produto"), F.lit("N/A")),
        "preco": _money(price),
        "desconto": F.coalesce(F.col("percentual_desconto"), F.lit(0.0)).cast("string"),
        "comissao": F.when(comm.isNotNull(), F.concat(comm.cast("string"), F.lit("%"))).otherwise(F.lit("N/A")),
        "lucro": F.when(lucro.isNotNull(), F.concat(F.lit("R$ "), _money(lucro))).otherwise(F.lit("N/A")),
        "titulo": F.coalesce(F.col("copy_titulo"), F.lit("N/A")),
        "corpo": F.coalesce(F.col("copy_corpo"), F.lit("N/A")),
        "cta": F.coalesce(F.col("copy_cta"), F.lit("N/A")),
        "url": F.coalesce(F.col("url_afiliado"), F.lit("#")),
    }
    return _fill(DIGEST_TEMPLATE, values)


def digest_html(picks: DataFrame) -> DataFrame:
    """The run's digest: blocks in pick order (a run has at most 20 picks)."""
    return picks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", digest_block(picks)
                                                                                   .alias("b")))),
                                              lambda x: x["b"]), "").alias("html"))


def spoken_price(c) -> F.Column:
    """'N reais' or 'N reais e M centavos' (cents rounded half-even)."""
    reais = F.floor(c).cast("bigint")
    cents = F.bround((c - reais) * 100.0, 0).cast("bigint")
    return F.when(cents == 0, F.concat(reais.cast("string"), F.lit(" reais"))).otherwise(
        F.concat(reais.cast("string"), F.lit(" reais e "), cents.cast("string"), F.lit(" centavos")))


def narration_text(df: DataFrame) -> F.Column:
    """Opening by minimum flag, cleaned name cut to 65 chars at a word,
    old/new price, percent when >= 10, closing line."""
    raw = py_strip(F.coalesce(F.when(py_strip(F.coalesce("nome_produto", F.lit(""))) != "", F.col("nome_produto")),
                              F.when(py_strip(F.coalesce("copy_titulo", F.lit(""))) != "", F.col("copy_titulo")),
                              F.lit("esse produto")))
    name = py_strip(F.regexp_replace(F.regexp_replace(raw, r"(?U)[^\w\sÀ-ÿ\-\+\.]", " "), r"\s+", " "))
    name = F.when(F.length(name) > 65, F.regexp_replace(F.substring(name, 1, 65), " [^ ]*$", "")).otherwise(name)
    price = F.coalesce(F.col("preco_atual"), F.lit(0.0))
    old = F.col("preco_antigo")
    opening = F.when(F.coalesce(F.col("menor_preco_historico"), F.lit(False)), F.lit(NARRATION_OPEN_MIN)).otherwise(
        F.lit(NARRATION_OPEN))
    price_part = F.when(old.isNotNull() & (old != 0) & (old > price), F.concat(
        F.lit("caiu de "), _half_even_int(old).cast("string"), F.lit(" reais por apenas "), spoken_price(price),
        F.lit("!"))).otherwise(F.concat(F.lit("por apenas "), spoken_price(price), F.lit("!")))
    disc = F.coalesce(F.col("percentual_desconto"), F.lit(0.0))
    pct = F.when(disc >= 10, F.concat(F.lit("São "), _half_even_int(disc).cast("string"),
                                      F.lit(" por cento de desconto!")))
    return F.concat_ws(" ", F.concat(opening, F.lit(" "), name), price_part, pct, F.lit(NARRATION_CLOSE))


def offer_summary(picks: DataFrame, limit: int = 10) -> DataFrame:
    """The first ``limit`` picks, title cut to 90 characters, 5 fields."""
    title = F.substring(F.coalesce(F.when(F.coalesce("nome_produto", F.lit("")) != "", F.col("nome_produto")),
                                   F.col("copy_titulo"), F.lit("")), 1, 90)
    return picks.filter(F.col("pos") <= limit).select(
        "pos", F.coalesce(F.col("sku_selecionado"), F.lit("")).alias("sku"), title.alias("titulo"),
        F.coalesce(F.col("categoria"), F.lit("Geral")).alias("categoria"),
        F.coalesce(F.col("loja"), F.lit("")).alias("loja"), F.coalesce(F.col("preco_atual"), F.lit(0.0)).alias(
            "preco_atual"))


def enrich_posted(posted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Store and price of each posted sku from the catalogue (last row per
    sku in catalogue order wins), else the store from the sku prefix."""
    look = (catalogue.groupBy(F.col("sku").cast("string").alias("_k"))
            .agg(F.max(F.struct("ord", F.struct("loja", "preco_atual").alias("v"))).getField("v").alias("_v")))
    j = posted.join(look, F.col("sku") == F.col("_k"), "left")
    return j.select("sku", F.coalesce(F.col("_v.loja"), store_from_sku(F.col("sku"))).alias("loja"),
                    F.col("_v.preco_atual").alias("preco_postado"))


def latest_run_top_posts(posts: DataFrame, run_col: str = "run_date", top: int = 3) -> DataFrame:
    """Top posts are kept on the newest run that has posts only; older runs
    get an empty list.  Per-run top-k is a literal row_number bound (partial
    WindowGroupLimit), the newest run a scalar aggregate."""
    w = Window.partitionBy(run_col).orderBy(F.col("score").desc(), F.col("created_time").desc(), F.col("user_id"))
    topk = posts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top)
    runs = (topk.groupBy(run_col)
            .agg(F.array_sort(F.collect_list(F.struct(F.col("_r").alias("r"), "user_id", "score"))).alias("top")))
    newest = runs.filter(F.size("top") > 0).select(F.max(run_col)).scalar()
    return runs.select(run_col, F.when(F.col(run_col) == newest, F.col("top")).otherwise(
        F.array().cast(runs.schema["top"].dataType)).alias("top_posts"))


# Social image patterns (fixed values: og:image with either attribute
# order, then twitter:image), searched over the whole page.
SOCIAL_IMAGE_PATTERNS = [
    r"""(?i)<meta[^>]+property=["']og:image(?::secure_url)?["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+property=["']og:image(?::secure_url)?["']""",
    r"""(?i)<meta[^>]+name=["']twitter:image(?::src)?["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+name=["']twitter:image(?::src)?["']""",
]


def social_image(html) -> F.Column:
    """First valid image URL of the og:image / twitter:image patterns."""
    from shelfscope.functions.text import unescape_html
    from shelfscope.sources.feeds import valid_image
    h = F.coalesce(col_(html), F.lit(""))
    cands = [valid_image(F.when(F.regexp_extract(h, p, 1) != "", unescape_html(F.regexp_extract(h, p, 1))))
             for p in SOCIAL_IMAGE_PATTERNS]
    return F.coalesce(*cands)


def scan_history(history: DataFrame, sku: str, store: str, start: str, end: str) -> DataFrame:
    """Key plus inclusive date-range scan (pushed to the parquet reader;
    the month partition column prunes folders when present)."""
    out = history.filter((F.col("sku") == sku) & (F.col("loja") == store)
                         & F.col("data_coleta").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    if "mes" in history.columns:
        out = out.filter(F.col("mes").between(start[:7], end[:7]))
    return out
