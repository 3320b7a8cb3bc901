"""Sinks and file sources of the dashboard and digest."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from shelfscope.functions import rules

RUN_SCHEMA = ("timestamp string, raspados_ml long, raspados_magalu long, postados_telegram long, "
              "postados_threads long, postados_facebook long, postados_x long, membros_telegram long, "
              "seguidores_facebook long, alcance_fb_28d long, pagina_fb_nome string, "
              "top_posts_fb array<struct<date: string, title: string, likes: long, comments: long, shares: long, "
              "score: long>>, custo_x_usd double, categorias map<string, long>, status string")
LEDGER_SCHEMA = ("id string, date string, platform string, clicks long, sales long, commission double, "
                 "note string")


# ------------------------------------------------------------------ S8 / S9
def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON with a fixed schema from files of lines that each hold an object (what the writers below produce), files
    that hold one array, or both side by side; a malformed line or array file gives no rows, a missing path an empty
    table.  Array files are those with a line that begins with ``[``; they are read as streams of elements."""
    try:
        lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    arrays = [r["file"] for r in lines.where(F.col("value").startswith("[")).select("file").distinct().collect()]   # names only
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    alone = lines.where((F.col("value") != "") & ~F.col("file").isin(arrays))
    rows = alone.select(F.from_json("value", schema + ", _corrupt_record string", options).alias("r"))
    rows = rows.filter(F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()).select("r.*").drop("_corrupt_record")
    if arrays:
        whole = spark.read.schema(schema).json([unquote(a) for a in arrays], multiLine=True, mode="DROPMALFORMED")
        rows = rows.unionByName(whole)
    return rows


def read_run_metrics(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array(spark, path, RUN_SCHEMA)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array(spark, path, LEDGER_SCHEMA)


def append_run(path: str, run: DataFrame) -> None:
    """S8 append: one run row per execution (JSON lines, append-only)."""
    run.write.mode("append").json(path)


def export_ledger(ledger: DataFrame, path: str) -> None:
    """S9 backup export (JSON lines, written by all tasks)."""
    ledger.write.mode("overwrite").json(path)


def delete_entry(ledger: DataFrame, entry_id: str) -> DataFrame:
    return ledger.filter(F.col("id") != F.lit(entry_id))


# --------------------------------------------------------------- S11 / S12
def write_offers_csv(offers: DataFrame, path: str) -> None:
    """S11: ';' separated, every field quoted, quotes doubled, header, UTF-8.
    With the byte-order mark of the original file: ``csv_export.write_csv_with_mark``."""
    (offers.write.mode("overwrite").option("sep", ";").option("quoteAll", True).option("quote", '"')
     .option("escape", '"').option("header", True).option("encoding", "UTF-8").csv(path))


def candidate_records(cands: DataFrame, drop=("url_afiliado", "imagem_url", "score_qualidade")) -> DataFrame:
    """One JSON object per candidate without the heavy / internal fields."""
    keep = [c for c in cands.columns if c not in set(drop)]
    return cands.select(F.to_json(F.struct(*keep)).alias("json"))


# ------------------------------------------------------------------------ S13
def ledger_csv_lines(ledger: DataFrame) -> DataFrame:
    """Date;platform;clicks;sales;commission(2 dp);"note" (quotes doubled)."""
    note = F.concat(F.lit('"'), F.replace(F.coalesce(F.col("note"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return ledger.select(F.concat_ws(";", F.col("date"), F.col("platform"), F.col("clicks").cast("string"),
                                     F.col("sales").cast("string"),
                                     F.format_string("%.2f", F.col("commission")), note).alias("linha"))


# ------------------------------------------------------------------------ S14
def write_marts(marts: dict[str, DataFrame], base_path: str) -> None:
    """The tables behind both dashboard tabs, one parquet folder each."""
    for name, df in marts.items():
        df.write.mode("overwrite").parquet(f"{base_path}/{name}")


def usd_to_brl(c) -> F.Column:
    return c * rules.USD_BRL
