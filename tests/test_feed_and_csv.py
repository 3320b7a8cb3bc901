"""Items anywhere in a feed, dates and images; CSV files with a byte-order mark."""

import csv
import datetime as dt
import io
import os
import tempfile

from pyspark.sql import Row
from pyspark.sql import functions as F

from shelfscope.sources import csv_export as Cx
from shelfscope.sources import feeds as Fd


def _entries(spark, *xml):
    feeds = spark.createDataFrame([("F", x, i) for i, x in enumerate(xml)], "fonte string, xml string, feed_ord int")
    out = {}
    for r in Fd.feed_entries(feeds).orderBy("feed_ord", "pos").collect():
        out.setdefault(r["feed_ord"], []).append(r)
    return out


def test_items_outside_the_channel_and_nested(spark):
    got = _entries(
        spark,
        "<rss><channel><title>c</title></channel><item><title>fora</title><link>u</link></item></rss>",
        "<a><b><item><title>um</title><item><title>dentro</title></item></item></b><item/></a>",
        '<feed xmlns="http://www.w3.org/2005/Atom"><x><entry><title>t</title><link href=" h "/><content>c</content></entry></x></feed>',
        "<feed><entry><title>sem</title><link href='h2'/><summary>s</summary><updated>2026-01-02</updated></entry></feed>",
        "<rss><item><title>certo</title></item><entry><title>nunca</title></entry></rss>",
        "<rss><channel><item><title>quebrado</title></item>", "", None, "nada")
    assert [r["title"] for r in got[0]] == ["fora"] and [r["title"] for r in got[1]] == ["um", "dentro", ""]
    assert [(r["title"], r["link"], r["summary"]) for r in got[2]] == [("t", "h", "c")]
    assert [(r["link"], r["summary"], r["published"]) for r in got[3]] == [("h2", "s", "2026-01-02")]
    assert [r["title"] for r in got[4]] == ["certo"] and set(got) == {0, 1, 2, 3, 4}


def test_images_of_items(spark):
    media = 'xmlns:media="http://search.yahoo.com/mrss/"'

    def rss(inner):
        return f"<rss {media}><item><title>t</title>{inner}</item></rss>"
    got = _entries(
        spark, rss('<media:content url="data:x"/><media:thumbnail url="//i.com/t.gif"/>'),
        rss('<enclosure url="https://i.com/A.JPEG?x=1"/>'), rss('<enclosure url="https://i.com/a.mp3" type="audio/mpeg"/>'),
        rss('<enclosure url="https://i.com/semfim" type="image/any"/>'),
        rss("<description>&lt;IMG class='x' data-src='https://i.com/d.png?a=1&amp;amp;b'&gt;</description>"),
        rss('<enclosure url="https://i.com/.jpg/pagina"/>'))
    assert [got[i][0]["image_url"] for i in range(6)] == [
        "https://i.com/t.gif", "https://i.com/A.JPEG?x=1", None, "https://i.com/semfim", "https://i.com/d.png?a=1&b", None]


def test_iso_dates(spark):
    cases = {"2026-11-25": dt.datetime(2026, 11, 25), "2026-11-25T10:00:00+0000": dt.datetime(2026, 11, 25, 10),
             "2026-11-25T10:00:00.250-03:00": dt.datetime(2026, 11, 25, 13, 0, 0, 250000),
             "2026-11-25 10:00:00-0300": dt.datetime(2026, 11, 25, 13), "2026-11-25T10:00": dt.datetime(2026, 11, 25, 10),
             "2026-11-25T10:00Z": dt.datetime(2026, 11, 25, 10), "Wed, 25 Nov 2026 10:00:00 GMT": dt.datetime(2026, 11, 25, 10),
             "2026-13-25": None, "ontem": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    assert {r["d"]: r["t"] for r in df.select("d", Fd.parse_feed_date("d").alias("t")).collect()} == cases


ROWS = [("ML_1", 'Mouse "Pro"; x', 99.9, None), ("ML_2", "ação\nduas linhas", 1.0, True), ("ML_3", "", None, False)]


def _files(path):
    return sorted(f for f in os.listdir(path) if not f.startswith((".", "_")))


def test_csv_bytes(spark):
    path = tempfile.mkdtemp(prefix="shelfscope-test-bom-") + "/ofertas"
    df = spark.createDataFrame(ROWS, "sku string, nome string, preco double, ok boolean")
    for _ in range(2):      # the second run takes the place of the first
        Cx.write_csv_with_mark(df.repartition(3, "sku"), path)
    read = []
    for name in _files(path):
        raw = open(f"{path}/{name}", "rb").read()
        assert raw.startswith(b"\xef\xbb\xbf" + b'"sku";"nome";"preco";"ok"\n') and raw.count(b"\xef\xbb\xbf") == 1
        read += list(csv.reader(io.StringIO(raw.decode("utf-8-sig")), delimiter=";"))[1:]
    assert sorted(read) == [["ML_1", 'Mouse "Pro"; x', "99.9", ""], ["ML_2", "ação\nduas linhas", "1.0", "True"],
                            ["ML_3", "", "", "False"]]
    assert not os.path.exists(f"{path}/_temporary") or not os.listdir(f"{path}/_temporary")
    Cx.write_csv_with_mark(df.limit(0), path)
    assert _files(path) == []


def test_a_task_that_runs_twice_leaves_one_file():
    path = tempfile.mkdtemp(prefix="shelfscope-test-retry-") + "/ofertas"
    writer = Cx.CsvExportWriter(path, ["a"], ";", overwrite=True)
    writer.write(iter([Row("lost")]))                   # the executor is lost after this
    second = writer.write(iter([Row("kept")]))
    writer.commit([second, writer.write(iter([]))])
    assert [open(f"{path}/{f}", encoding="utf-8-sig").read() for f in _files(path)] == ['"a"\n"kept"\n']
    broken = Cx.CsvExportWriter(path, ["a"], ";", overwrite=True)
    broken.write(iter([Row("never")]))
    broken.abort([None])
    assert len(_files(path)) == 1 and not os.path.exists(f"{path}/_temporary/{broken.job}")


def test_arrow_batches_of_long_feeds_are_bounded(spark, monkeypatch):
    """Documents of 300,000 characters reach Python in rows of bounded length, and their entries leave in small batches."""
    from pyspark.sql import functions as F

    item = F.concat(F.lit("<item><title>t"), F.col("i").cast("string"), F.lit("</title><link>https://x.com/"), F.col("id").cast("string"),
                    F.lit("/"), F.col("i").cast("string"), F.lit("</link><description>"), F.repeat(F.lit("\u00e9\U0001f600x "), 750),
                    F.lit("</description></item>"))
    docs = spark.range(20).select("id", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i")).select("id", "i", item.alias("x"))
    xml = F.concat(F.lit("<rss>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]), ""), F.when(
        F.col("id") % 5 == 4, F.lit("<")).otherwise(F.lit("</rss>")))
    feeds = docs.groupBy("id").agg(xml.alias("xml")).select(F.lit("f").alias("fonte"), F.col("id").alias("feed_ord"), "xml")
    seen = spark.sparkContext.accumulator(0)
    inner, piece = Fd._read_pieces, Fd.PIECE

    def watched(batches):
        def checked():
            for b in batches:
                assert max(len(t) for t in b.column("piece").to_pylist()) <= piece
                yield b
        for out in inner(checked()):
            assert out.nbytes < 8 << 20
            seen.add(out.num_rows)
            yield out
    monkeypatch.setattr(Fd, "_read_pieces", watched)
    rows = Fd.feed_entries(feeds).select("feed_ord", "pos", "title", F.length("summary").alias("n")).collect()
    assert sorted((r[0], r[1], r[2]) for r in rows) == sorted((d, i, f"t{i}") for d in range(20) if d % 5 != 4 for i in range(100))
    assert {r["n"] for r in rows} == {4 * 750 - 1} and seen.value == 1600
