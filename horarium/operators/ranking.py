"""Ordered choices: first or last of a group, ranks, runs and segments.

Data frames have no order, so every function names the columns that give it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return best.select("r.*")


def rank_candidates(candidate: DataFrame, group: str) -> DataFrame:
    """The best candidate of a group by lane, kind of page, rows, structure, confidence and place."""
    lane = F.when(F.col("lane") == "auto_accept", 2).when(F.col("lane") == "review", 1).otherwise(0)
    order = [lane.desc(), F.desc("specific"), F.desc("rows"), F.desc("structured"), F.desc("confidence"), F.asc("place")]
    return candidate.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def carry_forward(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """The last value given at or before each row."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def segments(df: DataFrame, group: str, order: list[str], boundary: Column, name: str) -> DataFrame:
    """Number of the segment of each row; a boundary opens one, rows before the first have 0."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(boundary.cast("int")).over(w))


def densest_window(df: DataFrame, group: str, place: str, before: int, budget: int) -> DataFrame:
    """The start of the stretch of `budget` that holds most positions, from `before` ahead of one of them; the first on ties."""
    start = F.greatest(F.col(place) - before, F.lit(0))
    w = Window.partitionBy(group).orderBy(place).rangeBetween(-before, budget - before)
    counted = df.select(group, start.alias("start"), F.count("*").over(w).alias("hits"))
    return counted.groupBy(group).agg(F.max_by("start", F.struct("hits", -F.col("start"))).alias("start"), F.max("hits").alias("hits"))


def ordered_union(parts: list[DataFrame], key: str) -> DataFrame:
    """Distinct keys of the parts in the order they first stand in; each part has key and ordinal."""
    all_parts = parts[0].withColumn("part", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        all_parts = all_parts.unionByName(p.withColumn("part", F.lit(k)))
    return all_parts.groupBy(key).agg(F.min(F.struct("part", "ordinal")).alias("first")).select(key, "first.part", "first.ordinal")


def profile(cell: DataFrame, group: list[str], order: str, value: Column, sample: int = 12) -> DataFrame:
    """Share of a column's first cells that satisfy a predicate."""
    k = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return cell.withColumn("k", k).filter(F.col("k") <= sample).groupBy(*group).agg(F.avg(value.cast("double")).alias("share"))
