"""Statistics of relations and of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def node_counts(edges: DataFrame) -> DataFrame:
    """Per source: edge_num and total weight."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("edge_num"), F.sum("weight").alias("total_weight"))


def relation_stats(edges: DataFrame) -> DataFrame:
    """One row: keys, edges, weights and times of a relation."""
    return edges.agg(
        F.countDistinct("src").alias("node_count"), F.count("*").alias("edge_count"), F.sum("weight").alias("total_weight"),
        F.min("ts").alias("oldest"), F.max("ts").alias("newest"),
    )


def running_weight(edges: DataFrame) -> DataFrame:
    """Each edge with the weight of its list up to it, newest first."""
    order = Window.partitionBy("src").orderBy(F.desc("ts"), F.desc("seq"), "dst")
    return edges.withColumn("cum_weight", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def count_in_range(edges: DataFrame, start: int, end: int) -> DataFrame:
    """Per source the edges with start <= ts <= end."""
    return edges.groupBy("src").agg(F.count_if(F.col("ts").between(start, end)).alias("n"))


def average_length(counts: DataFrame) -> DataFrame:
    return counts.agg(F.avg("edge_num").alias("avg_len"))


def length_quantiles(counts: DataFrame, points: tuple[int, ...] = tuple(range(10, 101, 10))) -> DataFrame:
    """For each point q the smallest length up to which at least q percent (whole number) of the keys lie."""
    hist = counts.groupBy("edge_num").agg(F.count("*").alias("n"))  # one row a length
    upto = F.sum("n").over(Window.orderBy("edge_num"))
    total = F.sum("n").over(Window.orderBy("edge_num").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = hist.withColumn("share", F.floor(upto * 100 / total)).select("edge_num", "share")
    wanted = share.select("edge_num", "share", F.explode(F.array(*map(F.lit, points))).alias("q")).where(F.col("share") >= F.col("q"))
    return wanted.groupBy("q").agg(F.min("edge_num").alias("length"))


def sample_counts(samples: DataFrame) -> DataFrame:
    """Per seed the slots that were not padded, as edge_num (for length_quantiles)."""
    return samples.groupBy("seed_pos").agg(F.count_if(~F.col("padded")).alias("edge_num"))


def usage(nodes: DataFrame, edges: DataFrame, key_limit: int, byte_limit: int, attr_values: int = 0, edge_bytes: int = 26) -> DataFrame:
    """One row: keys and bytes in use, and their shares of the limits in parts of 10,000."""
    keys = nodes.agg(F.count("*").alias("keys"))
    held = edges.agg(F.count("*").alias("n"))
    size = F.col("keys") * (8 + 8 * attr_values) + F.col("n") * edge_bytes
    out = keys.join(held)  # one row each
    return out.select("keys", size.alias("bytes"), F.floor(F.col("keys") * 10000 / key_limit).alias("key_usage"), F.floor(size * 10000 / byte_limit).alias("byte_usage"))


def broken_edges(edges: DataFrame, cap: int) -> DataFrame:
    """Sources whose lists break an invariant: a pair twice, an invalid id or weight, or too many edges."""
    out = edges.groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("d"), F.count_if((F.col("dst") == 0) | (F.col("weight") <= 0)).alias("bad"))
    return out.where((F.col("n") != F.col("d")) | (F.col("bad") > 0) | (F.col("n") > cap))
