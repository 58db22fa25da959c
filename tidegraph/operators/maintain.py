"""Upkeep of a relation: expiry, decay, eviction under pressure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.scalars import expired, hash48

#: Ranges in which nth_smallest counts values at once.
RANGES = 4096


def expire_edges(edges: DataFrame, interval: int, now: int) -> DataFrame:
    """Edges without a time, or whose time plus the interval is not past; interval 0 keeps all."""
    if not interval:
        return edges
    return edges.where((F.col("ts") == 0) | (F.col("ts") + interval >= now))


def expire_nodes(nodes: DataFrame, now: int) -> DataFrame:
    return nodes.where(~expired(F.col("expire_ts"), now))


def empty_nodes_expire(nodes: DataFrame, edges: DataFrame, now: int) -> DataFrame:
    """Nodes whose last edge is gone expire now; edge_num is counted anew."""
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("left"))
    out = nodes.join(counts, "id", "left").withColumn("left", F.coalesce("left", F.lit(0)))
    gone = (F.col("left") == 0) & (F.col("edge_num") > 0)
    return out.withColumn("expire_ts", F.when(gone, F.lit(now)).otherwise(F.col("expire_ts"))).withColumn("edge_num", F.col("left")).drop("left")


def decay_edges(edges: DataFrame, ratio: float, threshold: float, ticks: int = 1, multigraph: bool = False) -> DataFrame:
    """Each tick multiplies weights and deletes edges below the threshold; a multigraph list never deletes."""
    for _ in range(ticks if ratio != 1 else 0):
        edges = edges.withColumn("weight", F.col("weight") * ratio)
        if not multigraph:
            edges = edges.where(F.col("weight") >= threshold)
    return edges


def decay_degrees(nodes: DataFrame, ratio: float, ticks: int = 1) -> DataFrame:
    """Each tick takes the floor, so ticks don't combine."""
    for _ in range(ticks if ratio != 1 else 0):
        nodes = nodes.withColumn("degree", F.floor(F.col("degree") * ratio).cast("long"))
    return nodes


def ticks_between(before: int, now: int, interval: int) -> int:
    """Multiples of the interval in (before, now]: upkeep runs at whole multiples since the epoch."""
    return now // interval - before // interval


def nth_smallest(table: DataFrame, value: Column, n: int) -> tuple[int, int] | None:
    """(the n-th smallest whole number from 1, values below it); None where there are fewer.

    Values are counted in RANGES ranges, and the range that holds the n-th again, until it holds
    one number: a few passes that send RANGES sums each, whatever the table's size.
    """
    own = table.select(value.cast("long").alias("v")).where("v is not null")
    low, high, count = own.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not 0 < n <= count:
        return None
    below = 0
    while low < high:
        width = -(-(high - low + 1) // RANGES)
        inside = own.where(F.col("v").between(low, high))
        part = F.floor((F.col("v").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width)).cast("int")
        for at, k in sorted((r[0], r[1]) for r in inside.groupBy(part.alias("part")).agg(F.count("*")).collect()):
            if below + k >= n:
                low, high = low + at * width, min(high, low + (at + 1) * width - 1)
                break
            below += k
    return low, below


def without_first(table: DataFrame, score: Column, n: int, key: str = "id") -> DataFrame:
    """table without its n rows of the lowest score; of rows that tie at the cut those go whose key's hash is lowest."""
    found = nth_smallest(table, score, n)
    if found is None:
        return table if n <= 0 else table.limit(0)
    cut, below = found
    ties = table.where(score == cut)
    last, _ = nth_smallest(ties, hash48(F.col(key)), n - below)
    return table.where(score.isNull() | (score > cut) | ((score == cut) & (hash48(F.col(key)) > last)))


def evict_under_pressure(nodes: DataFrame, occupancy: float, max_occupancy: float = 0.9, reduce: float = 0.05, by: str = "degree") -> DataFrame:
    """Above max_occupancy, nodes without the reduce / occupancy of them that have the lowest scores (degree or expiry).

    Never more than that share goes: ties at the cut are settled by a hash of the id.
    """
    if occupancy <= max_occupancy:
        return nodes
    score = F.col("degree") if by == "degree" else F.col("expire_ts")
    return without_first(nodes, score, int(nodes.count() * min(1.0, reduce / occupancy)))


def recycle(nodes: DataFrame, now: int, capacity: int, rate: float = 0.95, inserted: str = "seq") -> DataFrame:
    """Nodes without expired ones; where `rate` of the capacity is still exceeded, without those inserted first."""
    live = expire_nodes(nodes, now)
    return without_first(live, F.col(inserted), live.count() - int(rate * capacity))
