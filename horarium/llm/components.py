"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash


def _with_least(edges: DataFrame) -> DataFrame:
    """Each (u, v) with `least`, the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("least"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest node.

    Alternates the large-star and small-star operations of Kiveris et al.
    (2014) on long keys until the edges no longer change.  The edges are
    rewritten to the shared folder each round; only counts reach the driver.
    Hubs are fine: each step is a pre-aggregated minimum and a join that the
    optimiser may split.
    """
    now = stash(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    size = now.count()
    for _ in range(rounds):
        if not size:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct()
        small = _with_least(large)
        small = small.select(F.explode(F.array(F.struct("v", "least"), F.struct(F.col("u").alias("v"), "least"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.least").alias("v")).filter("u <> v").distinct()
        before, now = now, stash(small, "edges")
        last, size = size, now.count()
        settled = size == last and now.join(before, ["u", "v"], "left_anti").isEmpty()
        drop_stash(before)
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
