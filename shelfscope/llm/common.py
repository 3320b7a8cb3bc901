"""Shared helpers of the training-data operators.

White space and words follow one definition everywhere: white space is the six
code points U+0020 and U+0009..U+000D, a word is a longest run without them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.session import checkpoint_dir

WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"

#: Largest row count of a side that is broadcast; beyond it the plan joins by shuffle.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared ``spark.checkpoint.dir`` and
    read it back: later plans start from files that outlive any executor.

    The files stay until the folder of the run is removed by whoever owns it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``rows`` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words(text: Column) -> Column:
    """Array of the words of ``text`` (null or blank: empty array)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RUN))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def row_key(doc_id: Column, text: Column, *more: Column) -> Column:
    """64-bit key of a row's content: equal rows share it, also where ids repeat or are null."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("\0null")), F.coalesce(text, F.lit("")),
                      text.isNull(), *more)


def packed(docs: DataFrame) -> DataFrame:
    """The caller's columns in one struct ``row``, so that none of their names meets one of an operator's own."""
    return docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"))


def first_of(rows: DataFrame, *keys: str) -> DataFrame:
    """Of packed rows with equal ``keys`` the one with the smallest language, then source (nulls first)."""
    order = [F.col(f"row.{c}") for c in ("lang", "source")]
    return rows.groupBy(*keys).agg(F.min_by("row", F.struct(*[x for c in order for x in (c.isNotNull(), c)])).alias("row"))


def text_batches(batches, column: str, max_bytes: int):
    """Split Arrow batches so that the texts of one piece hold about ``max_bytes`` at most
    (a single longer text stays whole)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column) -> list:
    """Texts of an Arrow string column as bytes (null: None)."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()
