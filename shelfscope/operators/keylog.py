"""Insert-ignore logs (M2, M3): the first row written for a key stays.

Rows live in folders by key bucket.  Beside them stands a Bloom filter per bucket: bitmaps
of 32,768 bits, ``blocks`` of them a bucket, a key setting three bits of one.  An insert
looks its keys up in the filters; keys that are not there are new without reading a row,
and only the buckets of the others are read (a literal partition filter), to drop what is
there already.  Inside a batch the first row of a key is ``min(struct(order, row))``, a
map-side combined aggregate.  Rows and filter bits of a batch are published together
(``sources/batches.py``): a batch that runs again changes nothing.  Choose ``buckets`` times
``blocks`` times 32,768 at about ten bits a key; fuller filters only cost more reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.session import materialize
from shelfscope.sources.batches import BatchManifest

BITS = 32_768       # of one bitmap (what Spark's bitmap aggregates hold)
HASHES = 3
_FILTER = "bucket int, block int, bits binary"


class KeyLog:
    """A log under ``path`` with the columns ``schema`` and the key columns ``keys``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64, blocks: int = 4):
        self.spark, self.schema, self.keys, self.buckets, self.blocks = spark, schema, keys, buckets, blocks
        self.manifest = BatchManifest(spark, path)
        self.columns = [c.strip().split()[0] for c in schema.split(",")]

    def _stored(self) -> DataFrame:
        return self.manifest.read("rows", f"{self.schema}, bucket int")

    def read(self) -> DataFrame:
        return self._stored().select(*self.columns)

    def _placed(self, rows: DataFrame) -> DataFrame:
        key = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in self.keys]
        return rows.withColumns({
            "bucket": F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int"),
            "block": F.pmod(F.xxhash64(*key, F.lit("block")), F.lit(self.blocks)).cast("int"),
            "at": F.array(*[F.pmod(F.xxhash64(*key, F.lit(i)), F.lit(BITS)) for i in range(HASHES)])})

    def _filters(self) -> DataFrame:
        return (self.manifest.read("filter", _FILTER).groupBy(F.col("bucket").alias("_bucket"), F.col("block").alias("_block"))
                .agg(F.bitmap_or_agg("bits").alias("bits")))

    def candidates(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """First row of each key in ``order``, and whether the filters may hold the key (``seen``)."""
        payload = [c for c in self.columns if c not in self.keys]
        first = (rows.groupBy(*self.keys)
                 .agg(F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                                     F.struct(*payload).alias("row"))).alias("m"))
                 .select(*self.keys, *[F.col(f"m.row.{c}").alias(c) for c in payload]))
        placed = self._placed(first)
        j = placed.join(self._filters(), (F.col("bucket") == F.col("_bucket")) & (F.col("block") == F.col("_block")), "left")

        def is_set(at):
            byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
        seen = F.coalesce(F.forall("at", is_set), F.lit(False))
        return j.withColumn("seen", F.col("bits").isNotNull() & seen).drop("_bucket", "_block", "bits")

    def in_buckets(self, buckets: list[int]) -> DataFrame:
        """Stored rows of some buckets (partition pruning by a literal list)."""
        return self._stored().where(F.col("bucket").isin(buckets) if buckets else F.lit(False))

    def insert(self, rows: DataFrame, order: list[str], batch_id: int | None = None) -> int:
        """Add the rows whose key is new; returns how many.  ``order`` ranks rows of one key inside the batch."""
        batch_id = self.manifest.next_id() if batch_id is None else batch_id
        if self.manifest.is_published(batch_id):
            return 0
        batch = materialize(self.candidates(rows, order))
        touched = sorted(r["bucket"] for r in batch.where("seen").select("bucket").distinct().collect())
        old = self.in_buckets(touched).select("bucket", *self.keys).alias("old")
        same = F.col("new.bucket") == F.col("old.bucket")
        for k in self.keys:
            same &= F.col(f"new.{k}").eqNullSafe(F.col(f"old.{k}"))
        known = batch.where("seen").alias("new").join(old, same, "left_anti")
        fresh = materialize(batch.where("NOT seen").unionByName(known))
        bits = (fresh.select("bucket", "block", F.explode("at").alias("at")).groupBy("bucket", "block")
                .agg(F.bitmap_construct_agg("at").alias("bits")))
        self.manifest.publish(batch_id, {"rows": fresh.select(*self.columns, "bucket").repartition("bucket"), "filter": bits},
                              partition_by={"rows": ["bucket"]})
        return fresh.count()

    def purge(self, older: F.Column, batch_id: int | None = None) -> tuple[int, int]:
        """Remove the rows where ``older`` holds: (removed, left).  Only batches with such rows are rewritten, as
        one new batch that replaces them; filters keep their bits, which costs a needless read at most."""
        batch_id = self.manifest.next_id() if batch_id is None else batch_id
        if self.manifest.is_published(batch_id):
            return 0, self.read().count()
        is_old = F.coalesce(older, F.lit(False))
        per = self._stored().groupBy("batch").agg(F.count_if(is_old).alias("old"), F.count(F.lit(1)).alias("n")).collect()
        hit = [r["batch"] for r in per if r["old"]]
        removed, left = sum(r["old"] for r in per), sum(r["n"] - r["old"] for r in per)
        if hit:
            kept = self._stored().where(F.col("batch").isin(hit) & ~is_old).select(*self.columns, "bucket")
            self.manifest.publish(batch_id, {"rows": kept}, partition_by={"rows": ["bucket"]},
                                  replaces=tuple(f"data/rows/batch={b}" for b in hit))
        return removed, left
