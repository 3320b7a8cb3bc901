"""Exact de-duplication through an extendible-hash index on shared files.

Keys are 64-bit hashes of white-space-normalised texts.  The directory
addresses buckets by leading hash bits: it doubles while a bucket holds more
than ``capacity`` distinct hashes, and each slot records how many bits its
bucket really uses.  The index files hold one entry per distinct text, sorted
by key and dealt to owner tasks as ranges of keys.  Entries are built by a
map-side combined grouping on (hash, text), so texts are compared byte by
byte and a text that fills a third of the table sends one row per task.
Different texts with one hash form a chain; their rows look the text up, all
others the hash alone (a chain of one text has been compared already).

Only DataFrame functions run here.

Defined results: null counts as the empty text; equal texts keep the smallest
doc_id (nulls count as largest); where that id is repeated with the same text,
exactly one of these rows is kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import first_of, packed, small, stored

CAPACITY = 1 << 14  # distinct hashes a bucket holds before it splits

# a run that is not a single space: what replacing changes
_CHANGED = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _CHANGED, " ")


def text_hash(norm: Column, hash_bits: int = 64) -> Column:
    """Leading ``hash_bits`` bits of the text's 64-bit hash (fewer than 64 only to test collisions)."""
    h = F.xxhash64(norm)
    return h if hash_bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - hash_bits), 64 - hash_bits)


def directory(hashes: DataFrame, n_distinct: int, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """``hashes`` (distinct ``h``) -> (slot, bucket, local_depth) for every slot in use, and the global depth.

    The directory starts at the depth that the number of hashes suggests and doubles while a slot holds more than
    the capacity.  A bucket of depth d holds the hashes that share d leading bits; the least d that fits the
    capacity is taken, which is where splitting ends.
    """
    depth = max(1, math.ceil(math.log2(max(2, 8 * n_distinct / capacity))))
    while True:
        slots = stored(hashes.groupBy(slot_of(F.col("h"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n")), "dedup-slots")
        if depth == 63 or slots.where(F.col("n") > capacity).isEmpty():
            break
        depth += 1
    local = F.lit(depth)
    for d in reversed(range(depth)):
        shared = Window.partitionBy(F.shiftright(F.col("slot"), depth - d))
        local = F.when(F.sum("n").over(shared) <= capacity, F.lit(d)).otherwise(local)
    slots = slots.withColumn("local_depth", local)
    # all slots of a bucket point at its first slot
    bucket = F.expr(f"shiftleft(shiftright(slot, {depth} - local_depth), {depth} - local_depth)")
    return slots.select("slot", bucket.alias("bucket"), "local_depth"), depth


def slot_of(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth)


def dedup(docs: DataFrame, capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, h, bucket, copies``
    (``copies``: rows with this id and text)."""
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    texts = texts.select("doc_id", "norm", text_hash(F.col("norm"), hash_bits).alias("h"))
    # 1. entries: one per distinct text, compared by bytes; chained where hashes collide
    entries = (texts.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
               .select("h", "keep_id", "group_size", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")))
    chain = F.count(F.lit(1)).over(Window.partitionBy("h")).alias("chain")
    entries = stored(entries.select("*", chain), "dedup-entries")
    # 2. directory over the distinct hashes, 3. index files in owner ranges
    distinct = entries.select("h").distinct()
    slots, depth = directory(distinct, distinct.count(), capacity)
    slots = stored(slots, "dedup-directory")
    index = (entries.withColumn("slot", slot_of(F.col("h"), depth))
             .join(small(slots), "slot")
             .repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h"))
    index = stored(index.select("bucket", "h", "keep_id", "group_size", "text_sha256", "chain"), "dedup-index")
    # 4. rows look up their bucket; equal (id, hash) rows travel as one
    probes = (texts.select("doc_id", "h").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("copies"))
              .withColumn("slot", slot_of(F.col("h"), depth)).join(small(slots), "slot")
              .select("bucket", "h", "doc_id", "copies"))
    found = probes.join(index.where("chain = 1").drop("chain"), ["bucket", "h"])
    collided = index.where("chain > 1").select("bucket", "h").distinct()
    if not collided.isEmpty():
        rows = texts.join(small(collided), "h")
        groups = rows.groupBy("bucket", "h", "norm").agg(F.min("doc_id").alias("keep_id"),
                                                         F.count(F.lit(1)).alias("group_size"))
        exact = (rows.groupBy("bucket", "h", "norm", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
                 .join(groups, ["bucket", "h", "norm"])
                 .select("bucket", "h", "doc_id", "copies", "keep_id", "group_size",
                         F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")))
        found = found.unionByName(exact)
    first = F.expr("(doc_id <=> keep_id) and _copy = 1")
    return (found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", "keep_id", "group_size", first.alias("kept"), "text_sha256", "h", "bucket",
                    "copies"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns of ``docs`` (whatever their names); of rows that share id and
    text the one with the smallest language, then source."""
    kept = stored(dedup(docs, **options).where("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"), "copies"), "dedup-kept")
    keyed = packed(docs).select("row", F.col("row.doc_id").alias("id"),
                                F.sha2(normalised(F.col("row.text")).cast("binary"), 256).alias("sha"))
    out = keyed.join(kept, F.expr("id <=> kept_id and sha = kept_sha"), "left_semi")
    if not kept.where("copies > 1").isEmpty():
        out = first_of(out, "id", "sha")
    return out.select("row.*")
