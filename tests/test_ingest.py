"""Ingest cases: page JSON offers (S1), listing cards (S2), URL and price helpers."""

import json


from shelfscope.functions.pricing import parse_price_text
from shelfscope.operators import ingest as I

PROMO_PAGE = """<html><body><ol>
<li class="promotion-item">
  <a class="promotion-item__link-container"
     href="https://produto.mercadolivre.com.br/MLB12345678-headset-gamer-hyperx-_JM#position=1&type=item">
    <img class="promotion-item__img" src="data:image/gif;base64,R0lGOD"
         data-src="https://http2.mlstatic.com/D_Q_NP_headset-V.webp">
    <p class="promotion-item__title">Headset   Gamer HyperX Cloud Stinger</p>
    <span class="promotion-item__oldprice">R$ 599,90</span>
    <span class="promotion-item__price"><span class="andes-money-amount__fraction">389</span>
      <span class="andes-money-amount__cents">90</span></span>
    <span class="promotion-item__discount">35% OFF</span>
  </a>
</li>
<li class="promotion-item"><p class="promotion-item__title">Cabo USB Gamer</p>
  <a href="https://produto.mercadolivre.com.br/MLB999">x</a>
  <span class="promotion-item__price"><span class="andes-money-amount__fraction">19</span></span></li>
</ol></body></html>"""

POLY_PAGE = """<html><body>
<div class="poly-card poly-card--grid"><div class="poly-card__content">
  <img class="poly-component__picture" src="data:image/gif;base64,AAA"
       data-src="https://http2.mlstatic.com/D_poly-controle.webp">
  <a class="poly-component__title" href="/controle-sem-fio-gamer/p/MLB22222222?matt_tool=">Controle Sem Fio Gamer</a>
  <s class="andes-money-amount andes-money-amount--previous"><span class="andes-money-amount__fraction">499</span></s>
  <div class="poly-price__current"><span class="andes-money-amount">
    <span class="andes-money-amount__fraction">379</span></span></div>
</div></div>
<li class="promotion-item"><p class="promotion-item__title">ignored layout</p></li>
</body></html>"""


def test_promotion_cards(spark):
    pages = spark.createDataFrame([(1, PROMO_PAGE)], "page_key long, body string")
    rows = I.html_card_offers(pages, category="Games", strict=True).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["sku"] == "ML_MLB12345678"
    assert (r["preco_atual"], r["preco_antigo"], r["percentual_desconto"]) == (389.90, 599.90, 35.0)
    assert r["imagem_url"] == "https://http2.mlstatic.com/D_Q_NP_headset-V.webp"
    assert r["nome_produto"] == "Headset Gamer HyperX Cloud Stinger"
    u = r["url_afiliado"]
    assert "#" not in u and "matt_tool=10000000" in u and "matt_word=" in u and "forceInApp=true" in u


def test_poly_card_has_priority(spark):
    pages = spark.createDataFrame([(2, POLY_PAGE)], "page_key long, body string")
    rows = I.html_card_offers(pages, category="Games").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["preco_atual"], r["preco_antigo"]) == (379.0, 499.0)
    assert r["imagem_url"] == "https://http2.mlstatic.com/D_poly-controle.webp"
    assert r["url_afiliado"].startswith("https://www.mercadolivre.com.br/controle-sem-fio-gamer/p/MLB22222222?")
    assert "matt_tool=10000000" in r["url_afiliado"]


def test_page_json_offers(spark):
    products = [
        {"id": "abc1", "title": "Mouse Gamer X", "url": "/p/abc1/?seller_id=lojax",
         "price": {"price": "300.00", "fullPrice": "240.00"}, "category": {"name": "Games"},
         "seller": {"id": "MagazineLuiza"}, "image": "//a-static.mlcdn.com.br/{w}x{h}/mouse.jpg"},
        {"id": "abc2", "title": "Cabo USB", "price": {"price": "50", "fullPrice": "40"}},
        {"id": "abc3", "title": "Teclado", "price": {"fullPrice": "100"}},
        {"id": "abc4", "title": "Monitor", "price": {"price": "1000", "fullPrice": "100"}, "seller": "Loja Y"},
        {"id": "abc5", "title": "SSD 1TB", "price": {"price": "500", "fullPrice": "450"}, "sellerId": "3P-Shop",
         "images": [{"url": "https://img.example/ssd.jpg"}]},
    ]
    doc = {"props": {"pageProps": {"data": {"search": {"products": products, "pagination": {"pages": 7}}}}}}
    html = f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps(doc)}</script></html>'
    pages = spark.createDataFrame([(1, html), (2, "<html>blocked</html>")], "seq long, body string")
    got = {r["sku"]: r for r in I.page_json_offers(pages).collect()}
    assert set(got) == {"MAGALU_abc1", "MAGALU_abc5"}
    a = got["MAGALU_abc1"]
    assert (a["seller_id"], a["comissao_percent"], a["percentual_desconto"], a["lucro_estimado_reais"]) == (
        "magazineluiza", 6.0, 20.0, 14.4)
    assert a["imagem_url"] == "https://a-static.mlcdn.com.br/800x600/mouse.jpg"
    assert a["total_paginas"] == 7
    b = got["MAGALU_abc5"]
    assert (b["seller_id"], b["comissao_percent"], b["imagem_url"]) == ("3p-shop", 2.5, "https://img.example/ssd.jpg")


def test_price_text_and_affiliate_url(spark):
    df = spark.createDataFrame([("R$ 1.234,56",), ("1,5",), ("1.299",), ("12.5",), ("abc",), ("0",)], "t string")
    assert [r[0] for r in df.select(parse_price_text("t")).collect()] == [1234.56, 1.5, 1299.0, 12.5, None, None]
    urls = spark.createDataFrame([("//produto.x.com/MLB1?a=1#f",), ("ftp://x",), ("/p/MLB2?matt_word=me",)], "u string")
    out = [r[0] for r in urls.select(I.affiliate_url("u")).collect()]
    assert out[0] == "https://produto.x.com/MLB1?a=1&matt_tool=10000000&matt_word=partner&forceInApp=true"
    assert out[1] is None
    assert out[2] == "https://www.mercadolivre.com.br/p/MLB2?matt_word=me&matt_tool=10000000&forceInApp=true"


def test_affiliate_parameters_keep_their_place(spark):
    p, end = "https://x.com/p?", "matt_word=partner&forceInApp=true"
    cases = {p + "matt_tool=&z=1": p + "matt_tool=10000000&z=1&" + end, p + "foo&a b=c d": p + "foo=&a+b=c+d&matt_tool=10000000&" + end,
             p + "a=1&b=2&a=3": p + "a=1&a=3&b=2&matt_tool=10000000&" + end, "https://x.com/p": p + "matt_tool=10000000&" + end,
             p + "matt_tool=7&matt_tool=&forceInApp=": p + "matt_tool=7&matt_tool=&forceInApp=&matt_word=partner",
             p + "matt_tool=&matt_tool=7": p + "matt_tool=10000000&" + end, p + "q=%C3%A9*~&=v": p + "q=%C3%A9%2A~&=v&matt_tool=10000000&" + end,
             "": None, "#x": None, " ": None}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r["u"]: r["a"] for r in df.select("u", I.affiliate_url("u").alias("a")).collect()} == cases


def test_url_steps_are_evaluated_once_a_row(spark):
    """Each step names its input several times; the plan holds the query's parsing once and not a copy per mention."""
    df = spark.createDataFrame([], "u string, n int")
    for column in (I.affiliate_url("u"), I.paged_url("u", "n")):
        plan = df.select(column.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert 0 < plan.count("url_decode") <= 4, plan.count("url_decode")


def test_paged_urls(spark):
    cases = {("https://x.com/l?ref=a&page=2&b=", 3): "https://x.com/l?ref=a&page=3&b=", ("https://x.com/l", 2): "https://x.com/l?page=2",
             ("https://x.com/l?a=1#f", 4): "https://x.com/l?a=1&page=4#f", ("https://x.com/l?a b", 1): "https://x.com/l?a b"}
    df = spark.createDataFrame(list(cases), "u string, n int")
    assert {(r["u"], r["n"]): r["p"] for r in df.select("u", "n", I.paged_url("u", "n").alias("p")).collect()} == cases


def test_block_diagnosis_and_breaker(spark):
    log = spark.createDataFrame([
        ("ML", 1, 200, "<title>Lista</title> ok"), ("ML", 2, 403, "<html>Verify you are HUMAN captcha</html>"),
        ("ML", 3, 200, "fine"), ("MG", 1, 200, "<title>  a\n b </title>")],
        "loja string, seq long, status_code int, body string")
    d = {(r["loja"], r["seq"]): r for r in I.block_diagnosis(log).collect()}
    assert d[("ML", 2)]["suspeita_waf"] and d[("ML", 2)]["indicio"] == "captcha"
    assert not d[("ML", 1)]["suspeita_waf"] and d[("MG", 1)]["title"] == "a b"
    b = I.breaker_prefix(I.block_diagnosis(log)).collect()
    ml = [r for r in b if r["loja"] == "ML"]
    assert [r["seq"] for r in ml] == [1] and ml[0]["chamadas"] == 2 and ml[0]["breaker_ativado"]


def test_page_prefix_stops_on_repeated_page(spark):
    items = spark.createDataFrame([("r", 1, "111"), ("r", 2, "222"), ("r", 3, "111"), ("r", 4, "333")],
                                  "route string, page int, sku string")
    kept = sorted(r["page"] for r in I.page_prefix(items).collect())
    assert kept == [1, 2]
