"""Connected components of an edge table by alternating stars.

Each round points every node of a neighbourhood at its smallest node, by joins and
minima alone: no group is collected, and a node of any degree is fine. Rounds are
written to scratch and the one before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import Scratch


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """edges (u, v): point at the smallest of u's closed neighbourhood its larger, or its smaller, members."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = edges.join(least, "u").where((F.col("v") > F.col("u")) if larger else (F.col("v") <= F.col("u"))).select("v", "m")
    own = least.select(F.col("u").alias("v"), "m")
    return moved.unionByName(own).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reached."""
    at = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}-0")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).alias("mark")
    before, k = at.agg(mark).first(), 0
    while True:
        k += 1
        large = _star(_both(at), True)
        # a large star's edges point down, so the small star needs each edge at its larger end only
        new = scratch.save(_star(large, False), f"{name}-{k}")
        after = new.agg(mark).first()
        scratch.drop(f"{name}-{k - 1}")
        if after == before:
            break
        at, before = new, after
    roots = new.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
