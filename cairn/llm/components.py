"""Connected components of an edge table, by alternating star contraction.

Each round relinks every vertex to the least vertex it sees; rounds are written to the shared folder,
so a lost executor costs one round at most, and nothing but counters reaches the driver.  A vertex of very
many neighbours is a hot key of a join of narrow rows, which adaptive execution splits.

Cases: edges with a null end are left out, as are those from a vertex to itself; repeated edges count once;
a vertex without edges is in no component; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: larger neighbours of a vertex move to its least one; else smaller ones and itself do."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        moved = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(node, component) for every vertex of the edges (u, v); component is the least vertex."""
    now, seen = written(edges.where("u <> v").select("u", "v").distinct(), label), None
    while True:
        now = written(_star(_star(now, True), False), label)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
