"""Connected components of a graph given as an edge table.

Alternating large-star and small-star steps turn every component into a star
around its smallest node in a logarithmic number of rounds.  A step is a
map-side combined minimum per node and a join back, so a node with very many
links is neither collected nor handled by one task.  Each round starts from a
table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> ``node, root``: every linked node and the smallest node it reaches
    (roots point at themselves)."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
               "edges")
    mark = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))]
    seen = tuple(e.agg(*mark).first())
    while seen[0]:
        e = stored(_small_star(_large_star(e)), "edges")
        now = tuple(e.agg(*mark).first())
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
