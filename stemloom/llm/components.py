"""Connected components by alternating large-star and small-star steps.

Edges stay in tables; each round is two grouped minima and two joins, cut from
its lineage in the shared folder. The number of rounds grows with the logarithm
of the size of the components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.llm.store import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) of longs to (u, v): each vertex but the least of its component, with that least one.

    Self-edges, repeated edges and edges in both directions are harmless; no edges give no rows.
    """
    state, last = cut(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct()), None
    for _ in range(max_rounds):
        state = cut(_small_star(_large_star(state)))
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == last:
            return state
        last = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
