"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawfinder.llm.common import checkpointed


def connected_components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: long): component is its smallest reachable node.

    Each step is a pre-aggregated minimum for each node and a join back, whose large keys adaptive execution
    splits; the edges are checkpointed in the shared folder after each round, and nothing but a row count
    and a checksum reaches the driver. Loops (a = b) and nulls are ignored, repeated edges count once.
    """
    step = checkpointed(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    )
    was = signature(step)
    for _ in range(most):
        if not was[0]:
            break
        both = step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the joins read plain shuffles, of which adaptive execution can split a node with most of the edges
        lows = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lows = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        kept = large.join(lows, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = checkpointed(kept.unionByName(lows.select("u", F.col("m").alias("v"))).distinct())
        now = signature(step)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"the components did not settle in {most} rounds")
    top = step.select(F.col("v").alias("u"), "v").distinct()
    return step.unionByName(top).select(F.col("u").alias("node"), F.col("v").alias("component"))


def signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)"), F.expr("coalesce(sum(cast(xxhash64(v, u) AS decimal(38))), 0)")).first())
