"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import materialise, scratch_dir


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v, low): each edge with the smallest of u and its neighbours."""
    low = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
    return edges.join(low, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another; component is its smallest node.

    Each round halves distances to the smallest node; edges never grow in number. Rounds
    go on until one changes nothing. Loops are ignored and an empty table gives an empty table.
    """
    where = scratch_dir(edges.sparkSession)
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, before = materialise(now, "edges", where), None
    for step in count():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        small = _stars(large)
        moved = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(small.select("u", F.col("low").alias("v")))
        now = materialise(moved.where("u <> v").distinct(), f"round{step}", where)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before:
            break
        before = mark
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
