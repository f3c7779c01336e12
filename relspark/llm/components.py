"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import forget, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (``a``, ``b``, any one type) to ``(node, component)``: every node that has an edge to
    another, with the smallest node it is connected to.

    Each pass links every node's larger neighbours to its smallest one, then every node's smaller
    neighbours; edges never grow in number beyond one for each node and neighbour, the smallest
    neighbour is a map-side minimum, and a hub's edges are split by the skew join.  The passes
    stop when nothing changes.  Self links and nulls are ignored."""
    spark = edges.sparkSession
    now = stored(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the join is between two exchanges and a hub's edges can be split
        nearest = stored(spark, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "edges")
        large = both.join(nearest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(spark, large, "edges")
        forget(now, nearest)
        least = stored(spark, large.groupBy("u").agg(F.min("v").alias("m")), "edges")
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        now = stored(spark, small, "edges")
        forget(large, least)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if seen == mark:
            break
        mark = seen
    ends = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(ends)


def merged_components(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (``node``, ``component``, stored) after further ``links`` (``a``, ``b``): only the components that they
    join are worked on.  ``comp`` itself where they join none; else it is deleted."""
    spark = comp.sparkSession
    of = lambda side: comp.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    joins = stored(spark, named.where("a <> b").distinct(), "joins")
    if joins.isEmpty():
        forget(joins)
        return comp
    sub = stored(spark, connected_components(joins).select("node", F.col("component").alias("into")), "joins")
    moved = comp.join(sub.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    new = sub.join(comp.select("node"), "node", "left_anti").select("node", F.col("into").alias("component"))
    out = stored(spark, moved.unionByName(new), "components")
    forget(comp, joins, sub)
    return out
