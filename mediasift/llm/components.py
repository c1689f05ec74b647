"""Connected components of a graph given as edges, in Spark joins only.

Alternating large-star and small-star steps: each keeps the components and makes edges point to
smaller nodes, until every node points straight to the smallest node of its component. No node's
neighbours are ever collected; joins on hot nodes are left to adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.llm.shared import Tables


def components(tables: Tables, edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of an edge (columns ``a`` and ``b``); root is the smallest node."""
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = tables.save(pairs, f"{name}-0")
    before = _state(now)
    for i in range(1, most_rounds):
        if not before[0]:
            break
        # the minima are written before they are joined: the join's sides are then plain shuffles, and
        # the rows of a hub can be split; after this step a node has few smaller neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = tables.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least-{i}")
        large = tables.save(both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large-{i}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = tables.save(small, f"{name}-{i}")
        after = _state(now)
        tables.drop(*[f"{name}-{k}" for k in (i - 1, f"least-{i}", f"large-{i}")])
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())

