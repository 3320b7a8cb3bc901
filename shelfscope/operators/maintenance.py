"""Table maintenance: daily price upsert, insert-ignore logs, key-value
metadata, retention, row-loss guard, legacy JSON migration.

Tables live as parquet folders.  The price history is partitioned by month
of ``data_coleta`` so an upsert rewrites only the touched months (dynamic
partition overwrite) and a retention run drops whole months plus one
filtered month.  The upsert reads the months that it replaces: a dynamic overwrite
removes nothing before all is written.  Every other rewrite of a path that the same
plan reads is cut by a reliable checkpoint first (read phase strictly before write phase).
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from shelfscope.functions import rules
from shelfscope.functions.pricing import store_from_sku
from shelfscope.functions.text import py_strip, round_n, wall_micros
from shelfscope.operators.keylog import KeyLog
from shelfscope.operators.radar import admit_observations, daily_compaction
from shelfscope.session import materialize
from shelfscope.sources.batches import BatchManifest

HISTORY_SCHEMA = ("sku string, loja string, data_coleta date, preco_min_dia double, preco_ultimo double, "
                  "titulo string, categoria string, atualizado_em timestamp_ntz")
POSTED_SCHEMA = "sku string, loja string, postado_em timestamp_ntz, preco_postado double, canal_resumo string"
TOPICS_SCHEMA = ("url_hash string, url string, fonte string, titulo string, tema_normalizado string, "
                 "publicado_em timestamp_ntz, canais_postados string")

#: Most months an upsert names in its partition filter (a century).
MAX_MONTHS = 1200


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; empty only if the path does not exist (any other error rises)."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# ------------------------------------------------------------------------- M1
def history_as_observations(history: DataFrame) -> DataFrame:
    """Existing day rows re-expressed as observations that sort before any new one."""
    return history.select(
        "sku", "loja", "data_coleta", F.col("preco_ultimo").alias("preco"),
        F.col("preco_min_dia").alias("preco_min"), "titulo", "categoria",
        F.col("atualizado_em").alias("ts"), F.lit(-1).cast("bigint").alias("seq1"),
        F.lit(-1).cast("bigint").alias("seq2"), F.lit(0).alias("batch"))


def merge_price_days(history: DataFrame, new_obs: DataFrame) -> DataFrame:
    """M1 merge: min never rises within a day, the last price / last non-blank
    title win, re-running the same observations is a no-op."""
    adm = admit_observations(new_obs).withColumn("batch", F.lit(1))
    cols = ["sku", "loja", "data_coleta", "preco", "preco_min", "titulo", "categoria", "ts", "seq1", "seq2", "batch"]
    return daily_compaction(history_as_observations(history).select(*cols).unionByName(adm.select(*cols)))


def upsert_price_days(spark: SparkSession, path: str, new_obs: DataFrame) -> DataFrame:
    """M1 on a parquet table partitioned by month: only touched months are read
    (literal partition filter) and rewritten (dynamic overwrite); returns them.

    They are rewritten while they are read: a dynamic overwrite writes beside the table and
    replaces its folders once every task is done.  Rows are dealt out by month first, so a
    month has a few files of the advisory size rather than one of every task."""
    month = F.date_format("data_coleta", "yyyy-MM")
    new_obs = new_obs.withColumn("data_coleta", F.col("data_coleta").cast("date"))
    touched = materialize(new_obs.select(month.alias("mes")).filter("mes IS NOT NULL").distinct())
    schema = HISTORY_SCHEMA + ", mes string"
    old = in_months(read_or_empty(spark, path, schema), touched).drop("mes")
    merged = merge_price_days(old, new_obs).withColumn("mes", month).hint("rebalance", "mes")
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("mes").parquet(path))
    return in_months(read_or_empty(spark, path, schema), touched)


def in_months(history: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of the months in ``touched``.  Up to ``MAX_MONTHS`` of them become a literal
    list, which prunes partitions when the scan is planned; beyond that a join does it."""
    months = [r["mes"] for r in touched.limit(MAX_MONTHS + 1).collect()]
    if len(months) > MAX_MONTHS:
        return history.join(touched, "mes", "left_semi")
    return history.filter(F.col("mes").isin(months))


# ---------------------------------------------------------------- M2 / M3
def admit_posts(posts: DataFrame) -> DataFrame:
    """M2 admission: trimmed sku, store from prefix when blank, price rounded."""
    sku = py_strip(F.col("sku").cast("string"))
    loja = py_strip(F.coalesce(F.col("loja"), F.lit("")))
    return (posts.withColumn("sku", sku).filter((F.col("sku") != "") & F.col("postado_em").isNotNull())
            .withColumn("loja", F.when(loja == "", store_from_sku(sku)).otherwise(loja))
            .withColumn("preco_postado", round_n(F.col("preco_postado"), 2)))


def posted_log(spark: SparkSession, path: str) -> KeyLog:
    return KeyLog(spark, path, POSTED_SCHEMA, ["sku", "loja", "postado_em"])


def topic_log(spark: SparkSession, path: str) -> KeyLog:
    return KeyLog(spark, path, TOPICS_SCHEMA, ["url_hash"])


def append_posts(spark: SparkSession, path: str, posts: DataFrame, order: list[str] | None = None,
                 batch_id: int | None = None) -> int:
    """M2: key (sku, store, time), the row written first stays; returns how many are new.  ``order``: columns
    that rank rows of one key inside the batch."""
    return posted_log(spark, path).insert(admit_posts(posts), order or ["preco_postado", "canal_resumo"], batch_id)


def append_topics(spark: SparkSession, path: str, topics: DataFrame, order: list[str] | None = None,
                  batch_id: int | None = None) -> int:
    """M3: unique url key, first write wins; the date of a re-published URL is kept."""
    return topic_log(spark, path).insert(topics, order or ["publicado_em", "url"], batch_id)


# ------------------------------------------------------------------------- M4
def metadata_latest(kv: DataFrame) -> DataFrame:
    """M4: last write wins per key (chave, valor, atualizado_em)."""
    return kv.groupBy("chave").agg(F.max_by("valor", "atualizado_em").alias("valor"),
                                   F.max("atualizado_em").alias("atualizado_em"))


def metadata_get(kv: DataFrame, key: str, default=None) -> DataFrame:
    """One row (valor, atualizado_em); the default and null time when absent."""
    m = metadata_latest(kv).filter(F.col("chave") == key)
    return m.agg(F.coalesce(F.first("valor"), F.lit(default).cast("string")).alias("valor"),
                 F.first("atualizado_em").alias("atualizado_em"))


# ------------------------------------------------------------------ M5 / A16
def retention_split(df: DataFrame, ts_col: str, limit) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) around ``limit`` (rows strictly older are removed)."""
    old = F.col(ts_col) < limit
    return df.filter(~old | F.col(ts_col).isNull()), df.filter(old)


def retention_counts(tables: dict[str, tuple[DataFrame, str, object]]) -> DataFrame:
    """Rows removed / kept per table for a retention run, one scan each."""
    out = None
    for name, (df, col, limit) in tables.items():
        c = df.agg(F.count_if(F.col(col) < limit).alias("removidos"),
                   F.count_if(~(F.col(col) < limit) | F.col(col).isNull()).alias("restantes")
                   ).withColumn("tabela", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return out.select("tabela", "removidos", "restantes")


def purge_price_history(spark: SparkSession, path: str, ref_date: str, days: int = rules.RETENTION_PRICE_DAYS
                        ) -> int:
    """M5 on the month-partitioned history: rows before ref - days are removed.
    Months that end before that day are dropped by name; of the others only the
    month of the day itself is read, and rewritten if it holds such rows."""
    first = date.fromisoformat(ref_date) - timedelta(days=days)
    boundary = first.strftime("%Y-%m")
    hist = read_or_empty(spark, path, HISTORY_SCHEMA + ", mes string")
    older = hist.filter(F.col("mes") < boundary).groupBy("mes").count().collect()  # a row a month
    removed, gone = sum(r["count"] for r in older), [r["mes"] for r in older]
    month = hist.filter(F.col("mes") == boundary)
    n_old, n = month.agg(F.count_if(F.col("data_coleta") < F.lit(first)), F.count(F.lit(1))).first()
    if n_old == n > 0:
        gone.append(boundary)
    elif n_old:
        kept = materialize(month.filter(F.col("data_coleta") >= F.lit(first)))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mes").parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for mes in gone:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/mes={mes}")
        folder.getFileSystem(conf).delete(folder, True)
    return removed + n_old


METADATA_SCHEMA = "chave string, valor string, atualizado_em timestamp_ntz"
LAST_PURGE_REMOVED, LAST_PURGE_AT = "ultima_limpeza_removidos", "ultima_limpeza_em"


def put_metadata(spark: SparkSession, path: str, entries: dict[str, str], at: datetime, batch_id: int | None = None) -> None:
    """M4 upsert: a batch of (key, value) written at ``at``; the last write of a key counts."""
    log = BatchManifest(spark, path)
    log.publish(log.next_id() if batch_id is None else batch_id, {"kv": spark.createDataFrame(
        [(k, str(v), at) for k, v in entries.items()], METADATA_SCHEMA)})


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return BatchManifest(spark, path).read("kv", METADATA_SCHEMA).drop("batch")


def run_retention(spark: SparkSession, base: str, ref: datetime, refs: dict[str, datetime] | None = None) -> dict[str, int]:
    """M5: purge the three tables under ``base`` (``precos``, ``postados``, ``pautas``) as of ``ref`` and store the
    number of removed prices for the row-loss guard (M6).  ``refs`` may give a table its own date.

    The count of a run is stored before its tables change: a run that is broken off and started again (same
    ``ref``) finds less to remove, and keeps the larger count."""
    refs, meta = refs or {}, f"{base}/metadados"
    day = refs.get("precos", ref)
    limit = (day - timedelta(days=rules.RETENTION_PRICE_DAYS)).date()
    hist = read_or_empty(spark, f"{base}/precos", HISTORY_SCHEMA + ", mes string")
    found = hist.filter((F.col("mes") <= limit.strftime("%Y-%m")) & (F.col("data_coleta") < F.lit(limit))).count()
    known = {r["chave"]: r["valor"] for r in metadata_latest(read_metadata(spark, meta)).collect()}
    if known.get(LAST_PURGE_AT) == ref.isoformat():
        found = max(found, int(known[LAST_PURGE_REMOVED]))
    put_metadata(spark, meta, {LAST_PURGE_REMOVED: str(found), LAST_PURGE_AT: ref.isoformat()}, ref)
    purge_price_history(spark, f"{base}/precos", day.date().isoformat())

    def before(table: str, days: int):
        return F.lit((refs.get(table, ref) - timedelta(days=days)).isoformat()).cast("timestamp_ntz")
    posted, _ = posted_log(spark, f"{base}/postados").purge(F.col("postado_em") < before("postados", rules.RETENTION_POSTED_DAYS))
    topics, _ = topic_log(spark, f"{base}/pautas").purge(F.col("publicado_em") < before("pautas", rules.RETENTION_TOPIC_DAYS))
    return {"precos_removidos": found, "postados_removidos": posted, "rss_removidos": topics}


# ------------------------------------------------------------------------- M7
def migrate_legacy(spark: SparkSession, base: str, prices: DataFrame, posts: DataFrame, today: str) -> None:
    """M7: legacy price and post documents (column ``doc``) into the tables under ``base``; a second run changes nothing."""
    upsert_price_days(spark, f"{base}/precos", legacy_price_observations(prices, "doc", today))
    append_posts(spark, f"{base}/postados", legacy_posts(posts, "doc"))


# ------------------------------------------------------------------------- M6
def row_loss_guard(baseline, current, justified, max_loss: float = rules.MAX_ROW_LOSS) -> F.Column:
    """M6: struct(ok, motivo, queda_pct) for the row-loss rule."""
    base = F.coalesce(baseline, F.lit(0)).cast("bigint")
    just = F.greatest(F.lit(0), F.coalesce(justified, F.lit(0))).cast("bigint")
    expected = F.greatest(F.lit(0), base - just)
    drop = F.greatest(F.lit(0), expected - current)
    pct = F.when(base > 0, drop / base).otherwise(F.lit(0.0))
    fail_empty = (base > 0) & (current == 0)
    fail_drop = (base > 0) & (pct > max_loss)
    motivo = (F.when(fail_empty, F.lit("banco_vazio_com_baseline_positivo"))
              .when(fail_drop, F.format_string("queda_anomala_linhas (%d vs esperado %d)", current, expected))
              .otherwise(F.lit("ok")))
    return F.struct((~(fail_empty | fail_drop)).alias("ok"), motivo.alias("motivo"),
                    (F.floor(pct * 10000.0 + 0.5) / 100.0).alias("queda_injustificada_pct"))


def _hour_slot(df: DataFrame, c: str) -> F.Column:
    return F.floor(wall_micros(df, c) / 3_600_000_000).cast("long")


def justified_removals(checks: DataFrame, purges: DataFrame, hours: int = rules.PURGE_VALID_HOURS) -> DataFrame:
    """M6 lookup: rows removed by the last purge at most ``hours`` before each check (``justificados``; none: 0).

    An as-of lookup split by hour: purges of one moment are one row, and an hour's last purge is listed under the
    following hours it reaches into.  Inside an hour of a base, purges and checks stand in one order, and each check
    sees the newest purge up to its moment; only that one can count, as all are valid equally long.  No check meets
    more than one purge, however many an hour holds.  ``checks``: base, conferido_em, ...; ``purges``: base,
    limpo_em, removidos.  A ``justificados`` that a check brings along comes first."""
    valid, removed = F.make_dt_interval(F.lit(0), F.lit(hours)), dict(purges.dtypes)["removidos"]
    p = (purges.filter(F.col("base").isNotNull() & F.col("limpo_em").isNotNull())
         .groupBy("base", "limpo_em").agg(F.max("removidos").alias("removidos")))
    p = p.withColumn("_until", F.col("limpo_em") + valid)
    p = p.select("base", _hour_slot(p, "limpo_em").alias("_slot"), F.struct("limpo_em", "_until", "removidos").alias("_p"),
                 _hour_slot(p, "_until").alias("_last"))
    later = (p.groupBy("base", "_slot").agg(F.max("_p").alias("_p"), F.max("_last").alias("_last"))
             .select("base", F.explode(F.filter(F.sequence("_slot", "_last"), lambda x: x > F.col("_slot"))).alias("_slot"), "_p"))
    no_check = F.lit(None).cast(checks.schema)
    at = F.col("_p.limpo_em")
    rows = p.drop("_last").unionByName(later).select("base", "_slot", at.alias("_at"), "_p", no_check.alias("_c"))
    c = checks.select("base", _hour_slot(checks, "conferido_em").alias("_slot"), F.col("conferido_em").alias("_at"),
                      F.lit(None).cast(rows.schema["_p"].dataType).alias("_p"), F.struct(*checks.columns).alias("_c"))
    # the default frame reaches to the last row of the same moment
    newest = F.max("_p").over(Window.partitionBy("base", "_slot").orderBy("_at"))
    seen = rows.unionByName(c).withColumn("_p", newest).filter(F.col("_c").isNotNull())
    hit = F.when(F.col("_c.conferido_em") <= F.col("_p._until"), F.greatest(F.lit(0).cast(removed), F.col("_p.removidos")))
    given = F.col("_c.justificados") if "justificados" in checks.columns else F.lit(None).cast("long")
    return seen.select(*[F.col("_c")[x].alias(x) for x in checks.columns if x != "justificados"],
                       F.coalesce(given, hit, F.lit(0)).cast("long").alias("justificados"))


def guarded_checks(checks: DataFrame, purges: DataFrame, max_loss: float = rules.MAX_ROW_LOSS) -> DataFrame:
    """M6: checks (base, conferido_em, baseline, atuais) judged against the purges before them."""
    j = justified_removals(checks, purges)
    g = row_loss_guard(F.col("baseline"), F.col("atuais"), F.col("justificados"), max_loss)
    return j.withColumn("_g", g).select("*", "_g.*").drop("_g")


def missing_tables(present: list[str], required=None) -> F.Column:
    """U4: required table names absent from ``present``."""
    req = F.array(*[F.lit(t) for t in (required or rules.REQUIRED_TABLES)])
    return F.array_except(req, F.array(*[F.lit(t) for t in present]) if present else F.array().cast("array<string>"))


# ------------------------------------------------------------------ S4 / S5
LEGACY_PRICE_TYPE = "map<string, struct<min: double, avg: double, count: int, last: double, updated: string>>"


def legacy_price_observations(df: DataFrame, json_col: str, today: str) -> DataFrame:
    """{sku: {min, avg, count, last, updated}} -> price observations.

    last = first non-zero of (last, min, avg); min = min or last; date =
    updated[:10] or today; skus without any price are skipped; store from prefix."""
    m = df.select(F.explode(F.from_json(F.col(json_col), LEGACY_PRICE_TYPE)).alias("sku", "info"))

    def truthy(c):
        return F.when(c.isNotNull() & (c != 0), c)
    last = F.coalesce(truthy(F.col("info.last")), truthy(F.col("info.min")), truthy(F.col("info.avg")))
    mn = F.coalesce(truthy(F.col("info.min")), last)
    day = F.substring(F.coalesce(F.when(F.col("info.updated") != "", F.col("info.updated")), F.lit(today)), 1, 10)
    return (m.filter(last.isNotNull())
            .select(F.col("sku"), store_from_sku(F.col("sku")).alias("loja"),
                    F.to_date(day).alias("data_coleta"), last.alias("preco"), mn.alias("preco_min_inicial"),
                    F.lit("").alias("titulo"), F.lit("").alias("categoria"),
                    F.to_timestamp_ntz(F.concat(day, F.lit("T00:00:00"))).alias("ts"),
                    F.lit(0).cast("bigint").alias("seq1"), F.lit(0).cast("bigint").alias("seq2")))


def legacy_posts(df: DataFrame, json_col: str) -> DataFrame:
    """{sku: iso_ts} -> posted rows; invalid timestamps skipped; channel legado_json."""
    m = df.select(F.explode(F.from_json(F.col(json_col), "map<string,string>")).alias("sku", "ts"))
    ts = F.try_to_timestamp(F.col("ts")).cast("timestamp_ntz")
    return (m.filter((F.col("sku") != "") & F.col("ts").isNotNull() & (F.col("ts") != "") & ts.isNotNull())
            .select("sku", store_from_sku(F.col("sku")).alias("loja"), ts.alias("postado_em"),
                    F.lit(None).cast("double").alias("preco_postado"), F.lit("legado_json").alias("canal_resumo")))
