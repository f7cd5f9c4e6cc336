"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every step is an aggregate
(combined before the shuffle) and an equi-join against one row per node, dealt out to parts where a
node has very many links; no neighbour list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import attached, removed, written


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return attached(both.where("v > u"), low, "u", total).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame, total: int) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = attached(edges, low, "u", total).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def component_labels(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(u, v) links over long node ids, to (node, label): label is the least node reachable.

    Only nodes with a link appear. Self links, nulls, repeats and either direction are allowed;
    without links the result is empty. Raises if max_rounds do not settle it (the number of rounds
    grows with the logarithm of the size, so 50 is far beyond need).
    """
    spark = edges.sparkSession
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, path = written(links, "links")
    seen = _digest(current)
    if seen[0] == 0:
        return current.select(F.col("u").alias("node"), F.col("v").alias("label"))
    for _ in range(max_rounds):
        following, next_path = written(_small(_large(current, seen[0]), seen[0]), "links")
        now = _digest(following)
        removed(spark, path)
        current, path = following, next_path
        if now == seen:
            roots = current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
