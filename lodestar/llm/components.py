"""Connected components of an edge table, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import staged, unstaged


#: Edges of one task.
EDGES = 500_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b), both long: the smallest node that can be reached.

    Large and small stars alternate until nothing changes: every node hands its smallest neighbour to the larger ones, then
    to the smaller ones. Minima are taken before the shuffle, and written to the shared folder like the edges of each round: so a join reads
    both its sides right from a shuffle, and AQE can split the run of a node with many neighbours. A round has as many tasks as its edges
    need, and what it no longer needs is deleted. Nulls and loops are left out; no edges, no rows.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct()
    e = staged(e, "edges")
    last = None
    for _ in range(most_rounds):
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last, tasks = state, max(8, state[0] // EDGES)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks), "least")
        large = staged(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks), "large-stars")
        small = staged(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "least")
        joined = large.join(small, "u")
        stars = small.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        old, e = e, staged(stars.distinct().coalesce(tasks), "edges")
        unstaged(old, least, large, small)
    raise RuntimeError(f"no components after {most_rounds} rounds")
