"""Structured Streaming variants of the batch jobs.

The original application runs three scheduled batches a day; these jobs keep
the same results continuously.  Common rules:

* event times arrive as TIMESTAMP_NTZ (UTC wall clock); they are cast to
  TIMESTAMP under the UTC session zone before any watermark;
* stream state and progress live under the shared ``spark.checkpoint.dir``
  (``stream_checkpoint``), so a restarted driver or lost executor resumes;
* sinks give the same rows when a batch is run again: the daily upsert publishes
  its rows by a manifest (``sources/batches.py``) and merges closed days (M1), the
  others publish a batch by a manifest or use Spark's file sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfscope.functions import rules
from shelfscope.operators import maintenance as Mt
from shelfscope.operators import radar
from shelfscope.session import checkpoint_dir, settings
from shelfscope.sources.batches import BatchManifest


#: Columns of an arriving observation.
OBSERVATION = ["sku", "loja", "data_coleta", "preco", "titulo", "categoria", "ts", "seq1", "seq2"]


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def event_time(c) -> F.Column:
    return F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp")


# ------------------------------------------------------------------------- T1
def daily_price_stream(obs: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Arriving observations under their day, and a row (``dia_fechado``) for each day that
    closes under the watermark (append mode).

    Spark's state holds a row per open day, however many products there are: it decides which
    days close and which rows come too late.  The rows of open days stand in a table
    (``upsert_daily_batches``), where their number does not weigh on any executor's memory."""
    o = obs.withColumn("_et", event_time("ts")).select("*", F.window("_et", "1 day").alias("w"))
    o = o.withColumn("data_coleta", F.to_date(F.col("w.start")))
    closed = (obs.select(event_time("ts").alias("_et")).withWatermark("_et", lateness)
              .groupBy(F.window("_et", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
              .select(F.to_date(F.col("w.start")).alias("dia_fechado")))
    return (o.select(*OBSERVATION, F.lit(None).cast("date").alias("dia_fechado"))
            .unionByName(closed, allowMissingColumns=True))


def day_observations(batch: DataFrame) -> DataFrame:
    """Closed days of T1 as observations of the M1 upsert."""
    return batch.select("sku", "loja", "data_coleta", F.col("preco_ultimo").alias("preco"),
                        F.col("preco_min_dia").alias("preco_min_inicial"), "titulo", "categoria",
                        F.col("atualizado_em").alias("ts"), F.lit(0).cast("bigint").alias("seq1"),
                        F.lit(0).cast("bigint").alias("seq2"))


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def upsert_daily_batches(spark: SparkSession, history_path: str):
    """foreachBatch sink for T1: per (sku, store, day) minimum and last price, last non-blank
    title and category of the days that closed, merged into the month-partitioned history (M1).

    Beside the history, each stream has its own tables: ``linhas``, the rows of open days, and
    ``dias``, the days that closed last.  A batch is run once and published in ``linhas``; its
    closed days are published together with the rows that remain, in place of all earlier ones.
    A batch that runs again goes on where it broke off, and merges the same days to the same rows."""
    def _sink(batch: DataFrame, batch_id: int) -> None:
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        tables = BatchManifest(spark, f"{history_path.rstrip('/')}.abertos/{stream}")
        arrived, closed = 2 * batch_id, 2 * batch_id + 1
        with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            if not tables.publish(arrived, {"linhas": batch}):
                batch.write.format("noop").mode("overwrite").save()     # Spark's state keeps only what has run
            rows = tables.read("linhas", _columns(batch)).drop("batch")
            signals = rows.select(F.col("dia_fechado").alias("data_coleta")).filter("data_coleta IS NOT NULL")
            rows = rows.filter("dia_fechado IS NULL")
            days = radar.daily_compaction(rows.select(*OBSERVATION).join(F.broadcast(signals), "data_coleta", "left_semi"))
            if not tables.is_published(closed):
                last = signals.agg(F.max("data_coleta")).first()[0]
                if last is None:
                    return
                tables.publish(closed, {"dias": days, "linhas": rows.filter(F.col("data_coleta") > F.lit(last))},
                               replaces=(*tables.folders("dias"), *tables.folders("linhas")))
            tables.vacuum()
            Mt.upsert_price_days(spark, history_path, day_observations(tables.read("dias", _columns(days))))
    return _sink


# ------------------------------------------------------------------- T2 / T3
def first_post_within(posts: DataFrame, hours: int = rules.REPEAT_LOCK_HOURS) -> DataFrame:
    """T2 without state of its own: the first post of each sku within the lock window
    (later posts of the same sku inside the watermark are dropped).  The lock that
    restarts at every post is ``lock.sliding_lock``."""
    p = posts.withColumn("_et", event_time("postado_em")).withWatermark("_et", f"{hours} hours")
    return p.dropDuplicatesWithinWatermark(["sku"]).drop("_et")


def first_url_within(items: DataFrame, days: int = rules.TOPIC_DEDUP_DAYS) -> DataFrame:
    """First item per URL key within the de-duplication window."""
    i = items.withColumn("_et", event_time("publicado_em")).withWatermark("_et", f"{days} days")
    return i.dropDuplicatesWithinWatermark(["url_hash"]).drop("_et")


# ------------------------------------------------------------------------- T4
def split_by_recency(items: DataFrame, hours: int = rules.NEWS_WINDOW_HOURS,
                     future_minutes: int = rules.NEWS_FUTURE_MINUTES, now=None) -> DataFrame:
    """T4: tag each arriving item: 'ok' inside [now-24h, now+15min], 'late' or
    'future' otherwise (the sink routes late/future rows to a side table).  ``now``
    defaults to the time of the batch."""
    t = event_time("publicado_em")
    now = F.current_timestamp() if now is None else now
    lo = now - F.make_dt_interval(F.lit(0), F.lit(hours))
    hi = now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(future_minutes))
    return items.withColumn("faixa", F.when(t.isNull() | (t < lo), F.lit("late"))
                            .when(t > hi, F.lit("future")).otherwise(F.lit("ok")))


def route_by_recency(manifest: BatchManifest):
    """foreachBatch sink for T4: items in time go to table ``ok``, the others to ``side``;
    both are published with the batch, once."""
    return manifest.sink(lambda batch: {"ok": batch.filter(F.col("faixa") == "ok"),
                                        "side": batch.filter(F.col("faixa") != "ok")})


# ------------------------------------------------------------------------- T5
def radar_on_arrivals(offers: DataFrame, stats_snapshot: DataFrame) -> DataFrame:
    """T5: stream-static join of arriving offers to the trailing-stats snapshot
    of the previous day (read-before-write kept by the snapshot date)."""
    s = stats_snapshot.select("sku", "loja", "min_180d", "mediana_180d", "media_180d", "dias_observados")
    return radar.radar_flags(offers.join(s, ["sku", "loja"], "left").fillna(0, ["dias_observados"]))


# ------------------------------------------------------------------------- T6
def engagement_per_hour(posts: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Posts and engagement per tumbling hour (append once the hour closes)."""
    p = posts.withColumn("_et", event_time("created_time")).withWatermark("_et", lateness)
    return (p.groupBy(F.window("_et", "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("posts"), F.sum("score").alias("eng"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("hora"), "posts", "eng"))


def start(df: DataFrame, spark: SparkSession, name: str, sink=None, path: str | None = None, mode: str = "append",
          available_now: bool = True, checkpoint: str | None = None, conf: dict[str, str] | None = None) -> StreamingQuery:
    """Start a job; its checkpoint defaults to <spark.checkpoint.dir>/streams/<name>
    so a restarted job resumes where it stopped.  Rows go to ``sink`` (a foreachBatch
    function), else as Parquet to ``path`` (Spark's file sink, which commits each batch once).
    ``conf``: settings of this job alone (a stream keeps those of its start)."""
    checkpoint = checkpoint or stream_checkpoint(spark, name)
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).queryName(name)
    if available_now:
        w = w.trigger(availableNow=True)
    w = w.foreachBatch(sink) if sink is not None else w.format("parquet").option("path", path or f"{checkpoint}/rows")
    with settings(spark, conf or {}):
        return w.start()
