"""Feed XML, social JSON, file sources and sinks."""

import datetime as dt
import glob
import json
import tempfile

from pyspark.sql import functions as F

from shelfscope.sources import feeds as Fd
from shelfscope.sources import sinks as Sk
from shelfscope.sources import social as So

NOW = dt.datetime(2026, 11, 25, 15, 0)


def _rss(items):
    body = "".join(items)
    return ('<?xml version="1.0"?><rss xmlns:media="http://search.yahoo.com/mrss/">'
            f"<channel><title>F</title>{body}</channel></rss>")


def test_feed_window_image_and_isolation(spark):
    fresh = ("<item><title>Nova GPU anunciada</title><link>https://a.com/gpu#c</link>"
             "<description>&lt;p&gt;Resumo &lt;b&gt;forte&lt;/b&gt;&lt;/p&gt;</description>"
             "<pubDate>Wed, 25 Nov 2026 12:00:00 +0000</pubDate>"
             '<media:content url="//img.a.com/gpu.jpg" medium="image"/></item>')
    old = ("<item><title>Antiga</title><link>https://a.com/old</link>"
           "<pubDate>Sun, 22 Nov 2026 15:00:00 GMT</pubDate></item>")
    feeds = spark.createDataFrame([("A", _rss([fresh, old]), 0), ("B", "<rss><channel><item>", 1)],
                                  "fonte string, xml string, feed_ord int")
    rows = Fd.news_from_feeds(feeds, F.lit(NOW).cast("timestamp_ntz")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["titulo"], r["imagem_url"], r["resumo"]) == ("Nova GPU anunciada", "https://img.a.com/gpu.jpg",
                                                            "Resumo forte")
    assert r["publicado_em"] == dt.datetime(2026, 11, 25, 12, 0)


def test_atom_and_dates(spark):
    atom = ('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="https://b.com/x"/>'
            "<summary>S</summary><updated>2026-11-25T10:00:00Z</updated></entry></feed>")
    feeds = spark.createDataFrame([("B", atom, 0)], "fonte string, xml string, feed_ord int")
    r = Fd.news_from_feeds(feeds, F.lit(NOW).cast("timestamp_ntz")).collect()
    assert [(x["url"], x["publicado_em"]) for x in r] == [("https://b.com/x", dt.datetime(2026, 11, 25, 10, 0))]
    d = spark.createDataFrame([("Tue, 25 Nov 2026 13:00:00 -0300",), ("2026-11-25T12:00:00",), ("lixo",)], "d string")
    got = [x[0] for x in d.select(Fd.parse_feed_date("d")).collect()]
    assert got == [dt.datetime(2026, 11, 25, 16, 0), dt.datetime(2026, 11, 25, 12, 0), None]


def test_social_posts_and_insights(spark):
    doc = json.dumps({"data": [
        {"id": "1", "message": "Oferta\nboa", "created_time": "2026-11-25T13:00:00+0000",
         "likes": {"summary": {"total_count": 5}}, "comments": {"summary": {"total_count": 2}}, "shares": {"count": 1}},
        {"id": "2", "created_time": "2026-11-25T14:00:00+0000"}]})
    p = So.posts_from_json(spark.createDataFrame([(doc,)], "doc string")).collect()
    assert [(r["likes"], r["comments"], r["shares"]) for r in p] == [(5, 2, 1), (0, 0, 0)]
    ins = json.dumps({"data": [
        {"name": "page_impressions_unique", "values": [{"value": 10}, {"value": 42}]},
        {"name": "page_fans_city", "values": [{"value": {"SP": 9, "RJ": 30, "BH": 1, "POA": 5, "REC": 7, "CWB": 8}}]}]})
    m = {r["metrica"]: r for r in So.insights_from_json(spark.createDataFrame([(ins,)], "doc string")).collect()}
    assert m["page_impressions_unique"]["valor"] == 42
    assert [e["key"] for e in m["page_fans_city"]["top_entradas"]] == ["RJ", "SP", "CWB", "REC", "POA"]


def test_sinks(spark):
    out = tempfile.mkdtemp(prefix="shelfscope-test-csv-")
    df = spark.createDataFrame([("ML_1", 'Mouse "Pro"', 99.9)], "sku string, nome_produto string, preco_atual double")
    Sk.write_offers_csv(df, out + "/ofertas")
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(out + "/ofertas/*.csv")))
    assert text.splitlines()[0] == '"sku";"nome_produto";"preco_atual"'
    assert '"ML_1";"Mouse ""Pro""";"99.9"' in text
    rec = Sk.candidate_records(df.withColumn("score_qualidade", F.lit(1.0))).first()[0]
    assert json.loads(rec) == {"sku": "ML_1", "nome_produto": 'Mouse "Pro"', "preco_atual": 99.9}
    led = spark.createDataFrame([("1", "2026-11-01", "Magalu", 10, 1, 1.5, 'a "b"')], Sk.LEDGER_SCHEMA)
    assert Sk.ledger_csv_lines(led).first()[0] == '2026-11-01;Magalu;10;1;1.50;"a ""b"""'
    p = tempfile.mkdtemp(prefix="shelfscope-test-json-")
    open(p + "/bad.json", "w").write('{"not": "a list"')
    assert Sk.read_ledger(spark, p + "/bad.json").count() == 0


def test_social_image_scan_and_missing_tables(spark):
    from shelfscope.operators import maintenance as Mt
    from shelfscope.operators import payloads as Pl
    pages = spark.createDataFrame([
        ('<head><meta property="og:image" content="//cdn.x.com/a.jpg"></head>',),
        ('<meta content="https://cdn.x.com/b.png" property="og:image:secure_url">',),
        ('<meta name="twitter:image:src" content="https://cdn.x.com/c.webp?a=1&amp;b=2">',),
        ('<meta property="og:image" content="data:image/png;base64,AAA"><p>nada</p>',)], "html string")
    got = [r[0] for r in pages.select(Pl.social_image(F.col("html"))).collect()]
    assert got == ["https://cdn.x.com/a.jpg", "https://cdn.x.com/b.png", "https://cdn.x.com/c.webp?a=1&b=2", None]
    hist = spark.createDataFrame([("ML_1", "Mercado Livre", dt.date(2026, 5, d), 10.0 + d) for d in (1, 10, 20)],
                                 "sku string, loja string, data_coleta date, preco_min_dia double")
    days = [r["data_coleta"].day for r in Pl.scan_history(hist, "ML_1", "Mercado Livre", "2026-05-10",
                                                          "2026-05-20").collect()]
    assert sorted(days) == [10, 20]
    row = spark.range(1).select(Mt.missing_tables(["historico_precos", "pautas_rss"]).alias("m")).first()
    assert row["m"] == ["historico_postados", "metadados_sync"]
