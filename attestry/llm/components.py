"""Connected components of an edge table, without a driver collect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.store import settle


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge: ``edges`` has columns ``u`` and ``v``, the id is the smallest node.

    Alternates large-star and small-star steps until the edge table no longer changes; each round is a grouped
    minimum (combined before the shuffle) and a join with one row per node, so a hub needs no task of its own.
    Null ends and self-loops are left out.  No edges give an empty table.
    """
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = settle(e), None
    for _ in range(max_rounds):
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        low = e.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).unionByName(e.select(F.col("v").alias("n"), F.col("v").alias("m")))
        low = low.groupBy("n").agg(F.min("m").alias("m"))
        large = e.join(low, e["v"] == low["n"]).select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("the components have not settled")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
