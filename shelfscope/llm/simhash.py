"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are read as Gray codewords and sorted by their rank, so that
neighbours differ in few bits.  The 64 bits are rotated three times to bring
each of three blocks to the front: two fingerprints that differ in at most two
bits agree on a whole block, lie in one run of equal leading bits of that
order, and a run is one entry of the index's top level.  Neighbouring short runs
form segments; inside a segment, groups of 16 neighbours are factored into upper
nodes that hold the bits all members share (mask and pattern); a pair of nodes
whose shared bits already differ in more than the allowed number is pruned with
all its members.  Every link comes from walking such a tree.

A run above ``run_limit`` is split before any task holds it: the bits that
vary in it are dealt into three parts again, and its members go to one bucket
per part and value.  Every split takes a third of the varying bits, so a few
rounds end with runs below the limit, whatever the data; a run of at most two
varying bits (four members) is not split any further.  Only a spanning
forest of a run's links leaves its task: connected groups of any size cost one
row per member.

Defined results: null or blank texts have fingerprint zero and are linked like
any other; texts with fewer words than a shingle are one shingle; equal rows
get equal results; a null doc_id never names a component unless nothing else
is in it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import first_of, packed, row_key, stored, text_batches, utf8
from shelfscope.llm.components import components

FAN = 16
SEGMENT = 256     # members of short runs that share a tree
RUN_LIMIT = 2048
_PIECE = 8 << 20


# ------------------------------------------------------------------ fingerprints
def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """SimHash of a text: a bit is set if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_digest

    words = text.lower().split()  # bytes: A-Z only; white space is the six ASCII characters
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        digests = xxh64_digest(line, seed)
    else:
        begins = [0, *(ends[:-1] + 1).tolist()]
        digests = b"".join([xxh64_digest(line[a:b], seed) for a, b in zip(begins, ends[shingle - 1:].tolist())])
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 4096):
        ones += np.unpackbits(rows[at:at + 4096], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big", signed=True)


def _fingerprint_batches(shingle: int, seed: int):
    def run(batches):
        for batch in text_batches(batches, "text", _PIECE):
            prints = [fingerprint(b, shingle, seed) if b else 0 for b in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(prints, pa.int64())],
                                             names=["doc_id", "key", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, key, fp`` of every whole text."""
    keyed = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(_fingerprint_batches(shingle, seed), f"doc_id {id_type}, key long, fp long")


# ------------------------------------------------------------------ hierarchical index of one run
def build_index(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the members upward: (bits set in all, bits set in any) of each group of FAN neighbours."""
    prints = prints.view(np.uint64)  # bit counts of signed numbers are those of their absolute values
    levels = [(prints, prints)]
    while len(levels[-1][0]) > 1:
        both, any_ = levels[-1]
        starts = np.arange(0, len(both), FAN)
        levels.append((np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(any_, starts)))
    return levels


def links(levels, bits: int):
    """Pairs (i, j), i < j, of members that differ in at most ``bits`` bits."""
    a = b = np.zeros(1, np.int64)
    step = np.arange(FAN)
    for both, any_ in reversed(levels[:-1]):
        shared = ~(both ^ any_)
        kept = []
        for at in range(0, len(a), 2048):
            x = (a[at:at + 2048, None, None] * FAN + step[None, :, None]).repeat(FAN, 2).ravel()
            y = (b[at:at + 2048, None, None] * FAN + step[None, None, :]).repeat(FAN, 1).ravel()
            inside = (x <= y) & (y < len(both))
            x, y = x[inside], y[inside]
            apart = np.bitwise_count((both[x] ^ both[y]) & shared[x] & shared[y])
            kept.append((x[apart <= bits], y[apart <= bits]))
        a, b = (np.concatenate(z) for z in zip(*kept))
    return a[a < b], b[a < b]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` members reaches over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _run_links(bits: int):
    def edges(bucket, prints):
        """Spanning forest of each segment of whole runs; runs lie together, members in Gray order."""
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        starts = starts[np.r_[True, np.diff(starts // SEGMENT) > 0]]
        out = []
        for at, end in zip(starts, np.r_[starts[1:], len(bucket)]):
            own = prints[at:end]
            root = forest(len(own), *links(build_index(own), bits))
            away = np.flatnonzero(root != np.arange(len(own)))
            out.append((own[away], own[root[away]]))
        return out

    def run(batches):
        bucket, prints = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            bucket = np.r_[bucket, batch.column("bucket").to_numpy()]
            prints = np.r_[prints, batch.column("fp").to_numpy()]
            done = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if (bucket != bucket[-1]).any() else 0
            yield from send(edges(bucket[:done], prints[:done]))
            bucket, prints = bucket[done:], prints[done:]  # the last run may go on in the next batch
        yield from send(edges(bucket, prints))

    def send(found):
        for a, b in found:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    return run


# ------------------------------------------------------------------ runs over the whole table
def gray_rank(code):
    """Rank of a 64-bit Gray codeword (prefix exclusive-or)."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code


def _part(mask: str, j: int) -> str:
    """SQL: every third set bit of ``mask``, from the j-th on."""
    return (f"aggregate(sequence(0, 63), 0L, (m, b) -> m | if(shiftrightunsigned({mask}, b) & 1L = 1L and "
            f"bit_count({mask} & if(b = 0, 0L, shiftrightunsigned(-1L, 64 - b))) % 3 = {j}, shiftleft(1L, b), 0L))")


def near_links(prints: DataFrame, bits: int = 2, run_limit: int = RUN_LIMIT) -> DataFrame:
    """``prints`` (distinct ``fp``) -> ``a, b``: links that connect what lies within ``bits`` (0 to 2) bits."""
    if not 0 <= bits <= 2:
        raise ValueError("three blocks find links of at most two bits")
    rotated = []
    for turn, block in ((0, 21), (21, 21), (42, 22)):
        code = F.col("fp") if not turn else F.shiftleft("fp", turn).bitwiseOR(F.shiftrightunsigned("fp", 64 - turn))
        rotated.append(F.struct(F.xxhash64(F.lit(turn), F.shiftrightunsigned(code, 64 - block)).alias("bucket"),
                                gray_rank(code).alias("rank")))
    runs = prints.select("fp", F.explode(F.array(*rotated)).alias("r")).select("fp", "r.bucket", "r.rank")
    found = None
    while True:
        runs = stored(runs, "simhash-runs")
        sizes = (runs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_and("fp").alias("both"),
                                            F.bit_or("fp").alias("any")).where("n > 1"))
        sizes = stored(sizes, "simhash-sizes")
        fits = (F.col("n") <= run_limit) | (F.bit_count(F.col("both").bitwiseXOR(F.col("any"))) <= 2)
        fit = runs.join(sizes.where(fits).select("bucket"), "bucket", "left_semi")
        part = (fit.select("bucket", "rank", "fp").repartition("bucket").sortWithinPartitions("bucket", "rank")
                .mapInArrow(_run_links(bits), "a long, b long"))
        found = part if found is None else found.unionByName(part)
        large = sizes.where(~fits)
        if large.isEmpty():
            break
        mask = large.select("bucket", F.col("both").bitwiseXOR(F.col("any")).alias("mask"))
        parts = mask.select("bucket", F.posexplode(F.array(*[F.expr(_part("mask", j)) for j in range(3)]))
                            .alias("j", "part"))
        runs = (runs.join(parts, "bucket")
                .select("fp", F.xxhash64("bucket", "j", F.col("fp").bitwiseAND(F.col("part"))).alias("bucket"), "rank"))
    return found


def groups(docs: DataFrame, shingle: int = 3, bits: int = 2, seed: int = 42, run_limit: int = RUN_LIMIT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id, key, fp, root``."""
    prints = stored(fingerprints(docs, shingle, seed), "simhash-prints")
    named = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = stored(components(near_links(named.select("fp"), bits, run_limit)), "simhash-roots")
    rooted = named.join(roots, named.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(of_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "key", "fp", "root")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all columns of ``docs`` (whatever their names): that with
    the smallest doc_id (then content key, language, source)."""
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("m")
    stay = stored(groups(docs, **options).groupBy("root").agg(least).select(F.col("m.doc_id").alias("doc_id"), F.col("m.key").alias("key")),
                  "simhash-stay")
    keyed = packed(docs).select("row", F.col("row.doc_id").alias("id"), row_key(F.col("row.doc_id"), F.col("row.text")).alias("k"))
    out = keyed.join(stay, F.expr("id <=> doc_id and k = key"), "left_semi")
    if not keyed.groupBy("id", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        out = first_of(out, "id", "k")
    return out.select("row.*")
