"""Connected components of an edge table, wholly in DataFrame operations.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014). Minima are partial aggregates and the joins that follow can be split by
adaptive execution, so a node with very many neighbours never has to fit into one task. Each step
is staged in the shared folder, which keeps the plan short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm import scratch


def _checksum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, left: str = "a", right: str = "b", max_steps: int = 60) -> DataFrame:
    """``edges`` -> (node, component): component is the smallest node reachable.

    Only nodes that occur in an edge between two different nodes are returned. Null ends, loops
    and repeated edges are ignored. An empty table gives an empty result.
    """
    e = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    e = scratch.stage(e.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") > F.col("v"))).distinct(), "cc")
    before = _checksum(e)
    for _ in range(max_steps):
        if before[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.stage(large.where("u > v").distinct(), "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        nxt = scratch.stage(small.distinct(), "cc")
        after = _checksum(nxt)
        scratch.drop(e)
        scratch.drop(large)
        e, same, before = nxt, after == before, after
        if same:
            break
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
