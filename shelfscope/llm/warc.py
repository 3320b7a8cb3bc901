"""WARC archives: writing with revisit records, and reading with boundary-chain verification.

Writing: one record per page; of pages with equal payloads the one with the
smallest id is a ``response``, the others are ``revisit`` records that refer
to it and carry no block.  Spark's text writer puts the record end after each
row, so a lost executor's file is written again by another task.

Reading: the archives are scanned as text that is separated by the magic
``WARC/1.``; every occurrence, wherever it stands, is a candidate record.  Its
header tells where the record after it must begin.  Offsets are running sums
over the pieces of a file.  Only candidates on the chain that begins at the
file's first byte are records: pointer jumping (every candidate points at its
successor's successor, twice as far each round) marks them in a logarithmic
number of joins, so magic inside payloads, whole archives as payloads included,
is rejected.  A payload with magic in it is put together from its pieces.

Uncompressed archives are split by Spark; gzip archives are read as a stream.
Defined results: a null payload is empty; pages with one id and one payload
have a record each, all of one type; a null id counts as largest; line breaks
and the magic in URLs are percent-encoded; candidates without a readable header
(or with the magic inside it) or length end their chain; an empty table writes no records; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import small, stored

MAGIC = "WARC/1."
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
_ID = "urn:page:"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 (no padding) of a hex SHA-1: four groups of 40 bits."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _field(name: str, value: Column) -> Column:
    """Header line, nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{_ID}"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip") -> None:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html")).withColumns({
        "sha1": F.sha1(F.col("html").cast("binary")), "more": F.xxhash64("html"), "size": F.octet_length("html")})
    same = ["sha1", "more", "size"]
    first = (rows.groupBy(*same).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
             .where((F.col("n") > 1) & (F.col("size") >= min_bytes)).select(*same, "first_id"))
    rows = rows.join(first, same, "left").withColumn(
        "revisit", F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    url = F.col("url")
    for raw, coded in (("\r", "%0D"), ("\n", "%0A"), ("WARC/", "WARC%2F")):
        url = F.replace(url, F.lit(raw), F.lit(coded))
    record = F.concat(
        F.lit(f"{MAGIC}0\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"), F.lit("\r\n"),
        _field("WARC-Record-ID", _urn(F.col("page_id"))), _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", url),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        _field("WARC-Profile", F.when(F.col("revisit"), F.lit(
            "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        _field("WARC-Refers-To", F.when(F.col("revisit"), _urn(F.col("first_id")))),
        _field("Content-Type", F.lit("text/html")),
        _field("Content-Length", F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"), F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    (rows.select(record.alias("value")).write.option("lineSep", _END).option("compression", compression).text(path))


def _header(name: str) -> Column:
    found = F.regexp_extract("header", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.rtrim(found))


def candidates(pieces: DataFrame) -> DataFrame:
    """Every magic with its offset, header fields, successor and, if no other magic cuts it, its payload's digest."""
    cut = pieces.select(
        "file", "block", "seq", F.octet_length("value").cast("long").alias("bytes"),
        F.when(F.contains("value", F.lit(_END)), F.substring_index("value", _END, 1)).alias("header"), "value")
    cut = cut.withColumn("head", F.octet_length("header").cast("long")).withColumn(
        "length", F.expr("try_cast(nullif(regexp_extract(header, '(?i)\\r\\ncontent-length:[ \\t]*([0-9]+)', 1), '') "
                         "as bigint)"))
    whole = F.col("head") + 4 + F.col("length") <= F.col("bytes")
    payload = F.substring(F.col("value").cast("binary"), (F.col("head") + 5).cast("int"), F.col("length").cast("int"))
    rows = cut.select(
        "file", "block", "seq", "bytes", "head", "length", F.when(whole, F.sha1(payload)).alias("sha1"),
        _header("WARC-Type").alias("type"), _header("WARC-Record-ID").alias("record_id"),
        _header("WARC-Refers-To").alias("refers_to"), _header("WARC-Target-URI").alias("target_uri"),
        _header("WARC-Payload-Digest").alias("stated_digest"))
    # the text of a file is its pieces with the magic between them
    place = F.sum(F.col("bytes") + len(MAGIC)).over(Window.partitionBy("file").orderBy("block", "seq"))
    rows = rows.withColumn("at", place - F.col("bytes") - 2 * len(MAGIC)).where(F.col("at") >= 0)
    return rows.withColumn("next", F.col("at") + len(MAGIC) + F.col("head") + 4 + F.col("length") + 4)


def on_chain(found: DataFrame) -> DataFrame:
    """``file, at`` of the candidates that the chain from the file's start reaches."""
    step = stored(found.select("file", "at", F.col("next").alias("jump"), (F.col("at") == 0).alias("reached")),
                  "warc-chain")
    while True:
        marks = step.where("reached and jump is not null").select("file", F.col("jump").alias("at"))
        far = step.select(F.col("file").alias("_f"), F.col("at").alias("_a"), F.col("jump").alias("_j"))
        marks = marks.groupBy("file", "at").agg(F.lit(True).alias("marked"))
        ahead = (step.join(far, F.expr("file = _f and jump = _a"), "left")
                 .select("file", "at", F.col("_j").alias("jump"), "reached"))
        step = stored(ahead.join(marks, ["file", "at"], "left")
                      .select("file", "at", "jump", (F.col("reached") | F.coalesce("marked", F.lit(False)))
                              .alias("reached")), "warc-chain")
        if step.where("reached and jump is not null").isEmpty():
            return step.where("reached").select("file", "at")


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """The text between magics, with file, start of the split and order of reading."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))


def payloads(pieces: DataFrame, found: DataFrame, records: DataFrame) -> DataFrame:
    """``file, at, payload`` (binary) of ``records`` (file, at), put together from their pieces."""
    chosen = records.select("file", "at", F.lit(True).alias("chosen"))
    up_to = Window.partitionBy("file").orderBy("at")
    owned = (found.join(chosen, ["file", "at"], "left").withColumn(
        "owner", F.max(F.when(F.col("chosen"), F.col("at"))).over(up_to))
        .withColumn("until", F.max(F.when(F.col("chosen"), F.col("next"))).over(up_to))
        .withColumn("skip", F.last(F.when(F.col("chosen"), F.col("head")), ignorenulls=True).over(up_to))
        .withColumn("size", F.last(F.when(F.col("chosen"), F.col("length")), ignorenulls=True).over(up_to))
        .where("at < until").select("file", "seq", "at", "owner", "skip", "size"))
    parts = pieces.select("file", "seq", "value").join(small(owned), ["file", "seq"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC)
    return parts.groupBy("file", "owner", "skip", "size").agg(text.alias("text")).select(
        "file", F.col("owner").alias("at"),
        F.substring(F.col("text").cast("binary"), (F.col("skip") + 5).cast("int"), F.col("size").cast("int"))
        .alias("payload"))


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Verified records: ``file, at, type, record_id, refers_to, target_uri, stated_digest, payload_bytes,
    payload_digest`` of the block as stored, and ``payload`` if asked for."""
    pieces = pieces_of(spark, path)
    found = stored(candidates(pieces), "warc-candidates")
    records = stored(found.join(on_chain(found), ["file", "at"], "left_semi").where("length is not null"),
                     "warc-records")
    cut = records.where("sha1 is null")
    if with_payload:
        texts = payloads(pieces, found, records)
        records = records.join(texts, ["file", "at"]).withColumn("sha1", F.sha1("payload"))
    elif not cut.isEmpty():
        mended = payloads(pieces, found, cut).select("file", "at", F.sha1("payload").alias("mended"))
        records = records.join(mended, ["file", "at"], "left").withColumn("sha1", F.coalesce("sha1", "mended"))
    return records.select("file", "at", "type", "record_id", "refers_to", "target_uri", "stated_digest",
                          F.col("length").alias("payload_bytes"), base32(F.col("sha1")).alias("payload_digest"),
                          *(["payload"] if with_payload else []))


def page_records(records: DataFrame) -> DataFrame:
    """Records as pages: ``page_id, payload_bytes, payload_digest`` (of the full payload, a revisit's taken
    from the response it refers to), ``record_type, refers_to``."""
    def page(urn: str) -> Column:
        return F.expr(f"try_cast(regexp_extract({urn}, '{_ID}([^>]*)', 1) as bigint)")
    rows = records.select(page("record_id").alias("page_id"), "type", "record_id", "payload_bytes",
                          "payload_digest", page("refers_to").alias("refers_to"), F.col("refers_to").alias("urn"),
                          F.regexp_replace("stated_digest", "^sha1:", "").alias("stated"))
    full = (rows.where("type = 'response'")
            .groupBy(F.col("record_id").alias("urn"), F.col("payload_digest").alias("stated"))
            .agg(F.max("payload_bytes").alias("full_bytes")))
    revisits = rows.where("type = 'revisit'").join(full, ["urn", "stated"], "left").select(
        "page_id", F.col("full_bytes").alias("payload_bytes"), F.col("stated").alias("payload_digest"),
        F.lit("revisit").alias("record_type"), "refers_to")
    return rows.where("type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)
