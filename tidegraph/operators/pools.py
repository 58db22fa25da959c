"""Pools of nodes: weighted random draws with replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.scalars import attr_at, transform_weight, uniform
from tidegraph.scratch import materialise

#: Nodes and draws that meet in one range of running weight, about.
MEET = 512


def pool_weight(kind: str | Column = "uniform", index: int = 0, transform: str = "default", exponent: float = 1.0) -> Column:
    """The weight of a node row: uniform, size, degree, int_attr or float_attr, or an own column; transformed."""
    if isinstance(kind, Column):
        return transform_weight(kind, transform, exponent)
    raw = {
        "uniform": lambda: F.lit(1.0),
        "size": lambda: F.col("edge_num"),
        "degree": lambda: F.col("degree"),
        "int_attr": lambda: attr_at(F.col("int_attrs"), index),
        "float_attr": lambda: attr_at(F.col("float_attrs"), index),
    }
    if kind not in raw:
        raise ValueError(f"unknown pool weight {kind!r}")
    return transform_weight(raw[kind](), transform, exponent)


def pool_filter(degree: tuple[int, int] | None = None, size: tuple[int, int] | None = None, now: int | None = None, tolerate: int = 0) -> Column:
    """Nodes in the closed ranges of degree and size whose remaining life exceeds `tolerate` seconds."""
    keep = F.lit(True)
    if degree:
        keep &= F.col("degree").between(*degree)
    if size:
        keep &= F.col("edge_num").between(*size)
    if now is not None:
        keep &= (F.col("expire_ts") == 0) | (F.col("expire_ts") - now > tolerate)
    return keep


def _running(pool: DataFrame) -> DataFrame:
    """Nodes (id, weight > 0) with the pool's weight before and up to each, in the order of ids.

    Ranges of ids are written and summed first, so each task sums its own range only, and they
    are the same wherever they are used.
    """
    dealt = pool.where("weight > 0").select("id", "weight").repartitionByRange("id").withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt)
    sums = dealt.groupBy("part").agg(F.sum("weight").alias("own"))
    ahead = sums.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("ahead"), F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    order = Window.partitionBy("part").orderBy("id")
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.join(F.broadcast(ahead), "part")  # one row a partition
    return placed.select("id", (F.col("ahead") + before).alias("before"), (F.col("ahead") + upto).alias("upto"), "total")


def draw_nodes(pool: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n draws (draw, id) in proportion to weight; the pool is (id, weight). An empty pool gives no draw."""
    numbered = _running(pool)
    total, n_nodes = numbered.agg(F.max("total"), F.count("*")).first()
    spark = pool.sparkSession
    draws = spark.range(n).select(F.col("id").alias("draw"))
    if not total:
        return draws.limit(0).select("draw", F.col("draw").alias("id"))
    width = float(total) / max(1, (n + n_nodes) // MEET)
    draws = draws.withColumn("mark", uniform(F.col("draw"), F.lit(seed)) * F.lit(float(total)))
    draws = draws.withColumn("bucket", F.floor(F.col("mark") / width))
    spans = numbered.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("before") / width), F.floor(F.col("upto") / width))))
    inside = (F.col("mark") > F.col("before")) & (F.col("mark") <= F.col("upto"))
    met = draws.join(spans, "bucket").where(inside)
    return met.select("draw", "id")


def random_nodes(nodes: DataFrame, n: int, kind: str | Column = "uniform", keep: Column | None = None, seed: int = 1, **weight) -> DataFrame:
    """Draws from a relation's nodes by a pool's weight and filter."""
    kept = nodes if keep is None else nodes.where(keep)
    return draw_nodes(kept.select("id", pool_weight(kind, **weight).alias("weight")), n, seed)
