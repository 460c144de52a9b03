"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import TASK_ROWS, forget, saved, small


def _round(e: DataFrame, n: int) -> DataFrame:
    """A large-star and a small-star step on n edges (u above v)."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = saved(both.groupBy("u").agg(F.min("v").alias("m")), "least", n)
    large = both.join(small(least, 16), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    lower = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least", n)
    out = large.join(small(lower, 16), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
    out = saved(out.where("u != v").distinct(), "edges", n)
    forget(least, lower)
    return out


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component) of every vertex of edges (u bigint, v bigint); component is the smallest id reachable.

    Loops and null ends are ignored; repeated edges count once. Each round is written to the shared folder. A hub's
    edges are aggregated on the map side; its least neighbour comes back by a broadcast where the measured table is small, else
    by a join that adaptive execution can split.
    """
    e = saved(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        n = e.count()
        # done when each vertex is the child of one root or a root
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("child")).union(e.select(F.col("v").alias("id"), F.lit(0).alias("child")))
        ends = ends.groupBy("id").agg(F.sum("child").alias("children"), F.min("child").alias("least")).coalesce(1 + n // TASK_ROWS)
        if ends.where("children > 1 or (children = 1 and least = 0)").isEmpty():
            break
        before, e = e, _round(e, n)
        forget(before)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
