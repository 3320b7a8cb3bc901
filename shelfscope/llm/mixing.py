"""Mixing sources to target weights by the cube method.

Every document gets a number of passes: ``floor(target / source size)`` whole
passes plus one more with the fractional inclusion probability that remains.
The fractions are rounded by balanced sampling: probabilities move through the
null space of the two constraints (words, documents), three documents at a
time, until each is 0 or 1 (flight phase).  Blocks of documents fly in
parallel; the at most two documents a block leaves open meet those of other
blocks at the next level, until each source has one block, whose open rest is
the landing problem.  All choices derive from hashes of rows, so reruns agree.

Defined results: null or blank texts have size 0 and are never taken; a null
source is a source of its own, last in the weight order; equal rows (same id,
source and text) are decided together and each keeps its own row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import n_words, packed, row_key, small, stored

BLOCK = 4096  # documents that fly together in one task
_EPS = 1e-9


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """``source, source_size`` -> the same with ``target``.

    Targets share ``share`` of all sizes by weight and stop at ``cap`` times the
    source's size; the excess is shared again.  The fixed point is
    ``min(cap * size, level * weight)`` with one common level, found from
    running sums over the sources ordered by ``cap * size / weight``.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    room = F.col("source_size") * F.lit(float(cap))
    ranked = sizes.withColumn("_w", w).withColumn("_cap", room)
    every = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(every) * F.lit(float(share))
              - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # capped while the common level, were this source the first uncapped one, still exceeds its room
    ranked = (ranked.withColumn("_level", level)
              .withColumn("_open", F.col("_level") * F.col("_w") <= F.col("_cap"))
              .withColumn("_common", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"),
                                                                           F.col("_level"))))
                          .over(every).getField("_level")))
    return ranked.select("source", "source_size",
                         F.when(F.col("_common").isNull(), F.col("_cap"))
                         .otherwise(F.least(F.col("_cap"), F.col("_common") * F.col("_w"))).alias("target"))


def _fly(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase over one block: returns probabilities of which at most two are fractional."""
    p = p.astype(float).copy()
    draws = rng.random(len(p) * 2 + 4).tolist()
    s, q = size.astype(float).tolist(), p.tolist()
    open_, draw = [], 0
    for k in range(len(q)):
        if not _EPS < q[k] < 1 - _EPS:
            q[k] = float(round(q[k]))
            continue
        open_.append(k)
        while len(open_) == 3:
            a, b, c = open_
            # null vector of the rows (1, 1, 1) and (sizes)
            u = [s[c] - s[b], s[a] - s[c], s[b] - s[a]]
            if u[0] == u[1] == u[2] == 0:
                u = [1.0, -1.0, 0.0]
            up = min((1 - q[i]) / v if v > 0 else q[i] / -v for i, v in zip(open_, u) if v)
            down = min(q[i] / v if v > 0 else (1 - q[i]) / -v for i, v in zip(open_, u) if v)
            step = up if draws[draw] * (up + down) < down else -down
            draw += 1
            for i, v in zip(open_, u):
                q[i] += step * v
            left = []
            for i in open_:
                if _EPS < q[i] < 1 - _EPS:
                    left.append(i)
                else:
                    q[i] = float(round(q[i]))
            open_ = left
    return np.array(q)


def _land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Landing: of all roundings of the at most two open documents, the one nearest in words, then documents."""
    p = p.copy()
    open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    best = None
    for bits in range(1 << len(open_)):
        x = np.array([(bits >> i) & 1 for i in range(len(open_))], float)
        miss = (abs(float(((x - p[open_]) * size[open_]).sum())), abs(float((x - p[open_]).sum())), bits)
        if best is None or miss < best[0]:
            best = (miss, x)
    p[open_] = best[1]
    return p


def _level(last: bool, level: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "unit"], kind="stable").reset_index(drop=True)
        name = f"{seed}/{level}/{pdf['group'].iloc[0]}/{pdf['source'].iloc[0]}"
        size, p = pdf["weight"].to_numpy(float), pdf["p"].to_numpy(float)
        p = _fly(size, p, np.random.default_rng(zlib.crc32(name.encode())))
        if last:
            p = _land(size, p)
        return pdf.assign(p=p)
    return run


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2, block: int = BLOCK,
        seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, taken, key``.

    ``taken`` is the words the mix takes, repeats counted: 0, 1 or ``cap`` passes.
    ``key`` identifies the row's content (``row_key``).
    """
    units = (docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                         row_key(F.col("doc_id"), F.col("text"), F.col("source")).alias("key"))
             .groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("copies")))
    units = stored(units, "mix-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"),
                                        F.count(F.lit(1)).alias("_n"))
    targets = stored(source_targets(sizes.drop("_n"), weights, share, cap), "mix-targets")
    per_source = targets.withColumnRenamed("source", "_s").join(
        sizes.select(F.col("source").alias("_s2"), "_n"), F.expr("_s <=> _s2")).drop("_s2")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    planned = (units.join(small(per_source), F.expr("source <=> _s")).drop("_s")
               .withColumn("base", F.least(F.floor(rate + _EPS), F.lit(cap)).cast("int"))
               .withColumn("p", F.greatest(F.lit(0.0), rate - F.col("base"))))
    flying = (planned.where((F.col("size") > 0) & (F.col("p") > _EPS))
              .select("source", F.col("doc_id").cast("string").alias("doc_id"), F.col("key").alias("unit"), F.xxhash64("key", F.lit(seed)).alias("order"),
                      (F.col("size") * F.col("copies")).cast("double").alias("weight"), "p",
                      F.pmod(F.xxhash64("key", F.lit(seed + 1)),
                             F.ceil(F.col("_n") / F.lit(block)).cast("long")).alias("group")))
    flying = flying.select("source", "doc_id", "unit", "order", "weight", "p", "group")
    groups = per_source.agg(F.max(F.ceil(F.col("_n") / F.lit(block)))).first()[0] or 1
    landed, level = [], 0
    while True:
        last = groups <= 1
        flown = stored(flying.groupBy("source", "group").applyInPandas(_level(last, level, seed), flying.schema),
                       f"mix-level{level}")
        landed.append(flown.where((F.col("p") <= _EPS) | (F.col("p") >= 1 - _EPS)))
        if last:
            break
        # two open documents a group: block/4 groups meet at the next level
        fan = max(2, block // 4)
        flying = (flown.where((F.col("p") > _EPS) & (F.col("p") < 1 - _EPS))
                  .withColumn("group", F.floor(F.col("group") / F.lit(fan)).cast("long")))
        groups, level = -(-groups // fan), level + 1
    chosen = landed[0]
    for part in landed[1:]:
        chosen = chosen.unionByName(part)
    # found again by id and source as well as by the text's hash
    chosen = chosen.where(F.col("p") > 0.5).select(F.col("source").alias("_s"), F.col("doc_id").alias("_id"), "unit", F.lit(1).alias("more"))
    return (planned.join(chosen, F.expr("cast(doc_id as string) <=> _id and source <=> _s and key = unit"), "left")
            .withColumn("taken", (F.col("size") * F.least(F.lit(cap), F.col("base") + F.coalesce("more", F.lit(0))))
                        .cast("long"))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", "source", "size", "source_size", "target", "taken", "key"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with all columns of ``docs`` (whatever
    their names)."""
    passes = (mix(docs, **options).where("taken > 0")
              .groupBy("doc_id", "source", "key").agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("passes")))
    keyed = packed(docs).select("row", F.col("row.doc_id").alias("id"), F.col("row.source").alias("s"), row_key(
        F.col("row.doc_id"), F.col("row.text"), F.col("row.source")).alias("k"))
    return (keyed.join(passes, F.expr("id <=> doc_id and s <=> source and k = key"))
            .withColumn("one", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("row.*"))
