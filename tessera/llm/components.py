"""Connected components by random-mate contraction, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import settled


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    Each round, a node points at the neighbour (or itself) that is first in the round's order; two pointer jumps follow,
    and the edges are rewritten to what their ends point at. Even rounds go by the ids themselves, which ends stars around
    a smallest id at once; odd ones by a hash of their own, which makes the node count fall by a constant factor on long
    paths too. A node that is in no edge has no row; a null end drops the edge; loops are ignored. Hubs only meet joins
    that AQE can split and aggregates with a map-side part.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u <> v")
    e = settled(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    maps: list[DataFrame] = []
    while not e.isEmpty():
        k = len(maps)
        order = lambda c: F.struct((F.xxhash64(c, F.lit(k)) if k % 2 else F.col(c)).alias("h"), F.col(c).alias("x"))  # noqa: E731, B023
        point = e.groupBy("u").agg(F.min(order("v")).alias("best"))
        point = settled(point.select("u", F.least("best", order("u")).getField("x").alias("p")))
        for _ in range(2):
            jump = point.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            point = settled(point.join(jump, "p").select("u", F.col("pp").alias("p")))
        maps.append(point)
        left = e.join(point, "u").select(F.col("p").alias("a"), F.col("v").alias("u"))
        e = settled(left.join(point, "u").select(F.col("a").alias("u"), F.col("p").alias("v")).where("u <> v").distinct())
    if not maps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = maps[0].select(F.col("u").alias("node"), F.col("p").alias("u"))
    for point in maps[1:]:
        roots = roots.join(point, "u", "left").select("node", F.coalesce("p", "u").alias("u"))
    roots = settled(roots)
    least = roots.groupBy("u").agg(F.min("node").alias("component"))
    return roots.join(least, "u").select("node", "component")
