"""Feed documents (RSS / Atom XML) -> news items.

Input is a table of fetched feeds (fonte, xml, feed_ord).  Items may stand anywhere in a
document, so no fixed schema reads it: an Arrow stage runs a pull parser over each document
and returns the raw fields of its entries; dates, images and texts are Column code.  A
malformed feed yields no items and never fails the others.  The session time zone is UTC
(see ``session.get_spark``): naive feed dates are read as UTC, as the original collector does.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from shelfscope.functions.text import clean_summary, col_, py_strip, topic_key, unescape_html, url_key
from shelfscope.operators.news import recent_window
from shelfscope.operators.selection import keep_first

# Names of the feed formats (fixed values).
MEDIA, DUBLIN_CORE, ATOM = ("{http://search.yahoo.com/mrss/}", "{http://purl.org/dc/elements/1.1/}",
                            "{http://www.w3.org/2005/Atom}")
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".webp")

_FIELDS = ("title", "link", "summary", "published", "media", "thumbnail", "enclosure", "enclosure_type")
ENTRIES = ArrayType(StructType([StructField("atom", BooleanType())] + [StructField(f, StringType()) for f in _FIELDS]))
_ENTRY = pa.struct([("atom", pa.bool_())] + [(f, pa.string()) for f in _FIELDS])

# Date patterns tried in order (fixed values: RFC-822 with numeric or named
# zone after the weekday is stripped, then ISO-8601 with or without zone).
RFC822_PATTERNS = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm z"]
ISO_PATTERNS = [f"yyyy-MM-dd{mark}HH:mm{second}{zone}" for mark in ("'T'", " ") for second in (":ss", ":ss.SSSSSS", ":ss.SSS", "")
                for zone in ("XXX", "XX", "")] + ["yyyy-MM-dd"]


def parse_feed_date(c) -> F.Column:
    """RFC-822 (weekday optional) or ISO-8601 ('Z' allowed); naive = UTC;
    result is a UTC wall-clock TIMESTAMP_NTZ, null when unparsable."""
    s = py_strip(F.coalesce(col_(c), F.lit("")))
    rfc = F.regexp_replace(s, r"^[A-Za-z]{3},\s*", "")
    cands = [F.try_to_timestamp(rfc, F.lit(p)) for p in RFC822_PATTERNS]
    cands += [F.try_to_timestamp(s, F.lit(p)) for p in ISO_PATTERNS]
    instant = F.when(s != "", F.coalesce(*cands))
    # instant -> UTC wall clock, whatever the session time zone
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def valid_image(c) -> F.Column:
    """P25 helper: stripped URL, not data:, '//' -> https:, must start with http."""
    u = py_strip(F.coalesce(col_(c), F.lit("")))
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
    return F.when((u != "") & ~u.startswith("data:") & u.startswith("http"), u)


def first_img_src(html) -> F.Column:
    """P25: source of an ``<img>`` (``data-src`` counts too)."""
    m = F.regexp_extract(F.coalesce(col_(html), F.lit("")), r"""(?i)<img[^>]+(?:data-)?src=["']([^"']+)["']""", 1)
    return valid_image(F.when(m != "", unescape_html(m)))


def _text(element, *names: str) -> str | None:
    """Text of the first of ``names`` that has one among the element's children."""
    return next((t for t in (element.findtext(n) for n in names) if t), None)


def _attribute(element, name: str, attribute: str) -> str | None:
    child = element.find(name)
    return None if child is None else child.get(attribute)


def _entry(element) -> dict | None:
    """Raw fields of an ``item`` or ``entry`` element; None for other elements."""
    if element.tag == "item":
        return {"atom": False, "title": _text(element, "title"), "link": _text(element, "link"),
                "summary": _text(element, "description"), "published": _text(element, "pubDate", DUBLIN_CORE + "date"),
                "media": _attribute(element, MEDIA + "content", "url"),
                "thumbnail": _attribute(element, MEDIA + "thumbnail", "url"),
                "enclosure": _attribute(element, "enclosure", "url"),
                "enclosure_type": _attribute(element, "enclosure", "type")}
    if element.tag in ("entry", ATOM + "entry"):
        link = ATOM + "link" if element.find(ATOM + "link") is not None else "link"
        return {"atom": True, "title": _text(element, ATOM + "title", "title"), "link": _attribute(element, link, "href"),
                "summary": _text(element, ATOM + "summary", ATOM + "content", "summary"),
                "published": _text(element, ATOM + "updated", ATOM + "published", "updated")}
    return None


class _Document:
    """A feed document that is read piece by piece.  An element is let go when no item or entry around it needs it any
    more."""

    def __init__(self):
        self.parser, self.around, self.out = ElementTree.XMLPullParser(["start", "end"]), [], []

    def _events(self) -> None:
        for event, element in self.parser.read_events():
            if event == "start":
                if element.tag in ("item", "entry", ATOM + "entry"):
                    self.around.append(len(self.out))
                    self.out.append(None)
            else:
                entry = _entry(element)
                if entry is not None:
                    self.out[self.around.pop()] = entry
                if not self.around:
                    element.clear()

    def feed(self, text: str) -> None:
        if self.out is not None:
            try:
                self.parser.feed(text)
                self._events()
            except ElementTree.ParseError:
                self.out = None

    def entries(self) -> list[dict]:
        """Entries in the order in which they begin, wherever they stand; none if the document is malformed."""
        if self.out is not None:
            try:
                self.parser.close()
            except ElementTree.ParseError:
                self.out = None
        return self.out or []


def document_entries(xml: str) -> list[dict]:
    """Entries of a whole feed document."""
    document = _Document()
    for at in range(0, len(xml), 1 << 16):
        document.feed(xml[at:at + (1 << 16)])
    return document.entries()


#: Characters of a piece (a row handed to Python), and of the entries that are handed back at once.
PIECE, BATCH = 2_048, 1 << 20


def _read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of documents whose pieces follow each other; RSS items, or Atom entries if a document has no RSS item."""
    document, rows, held, names = None, [], 0, ["fonte", "feed_ord", "pos", "e"]

    def packed(schema):
        types = [schema.field("fonte").type, schema.field("feed_ord").type, pa.int32(), _ENTRY]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    for batch in batches:
        fonte, feed_ord, at, left, text = (batch.column(c) for c in ("fonte", "feed_ord", "at", "left", "piece"))
        for i in range(batch.num_rows):
            if at[i].as_py() == 0:
                document = _Document()
            document.feed(text[i].as_py())
            if left[i].as_py() == 0:
                found = document.entries()
                found = [e for e in found if not e["atom"]] or found
                for pos, e in enumerate(found):
                    rows.append((fonte[i].as_py(), feed_ord[i].as_py(), pos, e))
                    held += sum(len(v) for v in e.values() if isinstance(v, str))
                    if held >= BATCH:
                        yield packed(batch.schema)
                        rows, held = [], 0
        if rows:
            yield packed(batch.schema)
            rows, held = [], 0


def feed_entries(feeds: DataFrame) -> DataFrame:
    """S3: one row per entry (fonte, feed_ord, pos, title, link, summary, published,
    image_url); RSS items, or Atom entries when a document has no RSS item.

    Documents go to Python in pieces that follow each other, so that an Arrow batch, which counts rows, holds a
    bounded number of characters however long the documents are."""
    pieces = F.regexp_extract_all(F.col("xml"), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    x = (feeds.select("fonte", "feed_ord", pieces.alias("pieces")).withColumn("n", F.size("pieces"))
         .select("fonte", "feed_ord", "n", F.posexplode("pieces").alias("at", "piece"))
         .select("fonte", "feed_ord", "at", (F.col("n") - 1 - F.col("at")).alias("left"), "piece"))
    out = StructType([feeds.schema["fonte"], feeds.schema["feed_ord"], StructField("pos", IntegerType()),
                      StructField("e", ENTRIES.elementType)])
    x = x.mapInArrow(_read_pieces, out)

    def text(name):
        return py_strip(F.coalesce(F.col(f"e.{name}"), F.lit("")))
    path = F.lower(F.split(F.coalesce("e.enclosure", F.lit("")), r"\?", 2).getItem(0))
    is_image = F.lower(F.coalesce("e.enclosure_type", F.lit(""))).contains("image")
    for ending in IMAGE_ENDINGS:
        is_image |= path.endswith(ending)
    x = x.select("fonte", "feed_ord", "pos", text("title").alias("title"), text("link").alias("link"),
                 text("summary").alias("summary"), text("published").alias("published"),
                 F.col("e.atom").alias("atom"), F.coalesce(
                     valid_image(F.col("e.media")), valid_image(F.col("e.thumbnail")),
                     F.when(is_image, valid_image(F.col("e.enclosure")))).alias("media"))
    image = F.coalesce("media", F.when((F.col("summary") != "") & ~F.col("atom"), first_img_src("summary")))
    return x.withColumn("image_url", image).drop("media", "atom")


def news_from_feeds(feeds: DataFrame, now) -> DataFrame:
    """S3 collector: entries with title and link, first per URL key across feeds
    in feed order (W11, before the time filter), cleaned summary, topic, parsed
    date, then the recency window (P28).  ``feeds``: fonte, xml, feed_ord."""
    e = feed_entries(feeds).filter((F.col("title") != "") & (F.col("link") != ""))
    e = e.withColumn("url_hash", url_key("link"))
    first = keep_first(e, "url_hash", ["feed_ord", "pos"])
    items = first.select(
        "fonte", F.col("title").alias("titulo"), clean_summary("summary").alias("resumo"),
        F.col("link").alias("url"), F.col("image_url").alias("imagem_url"),
        topic_key("title").alias("tema_normalizado"), parse_feed_date("published").alias("publicado_em"),
        "url_hash", "feed_ord", "pos")
    return recent_window(items, now)
