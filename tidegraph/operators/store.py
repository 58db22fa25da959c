"""Whole-row operations on keyed tables: put, erase, copy, list; and snapshots of node pools."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.scalars import expired
from tidegraph.operators.pools import draw_nodes
from tidegraph.unions import union


def put(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """table with whole rows replaced or added by key; of rows of one key the one with the largest seq stays."""
    last = rows
    if "seq" in rows.columns:
        own = [c for c in rows.columns if c != key]
        last = rows.groupBy(key).agg(F.max_by(F.struct(*own), "seq").alias("r")).select(key, *[f"r.{c}" for c in own])
    last = last.select(*[c for c in table.columns if c in last.columns])
    return union(table.join(last.select(key), key, "left_anti"), last, missing=True)


def merge(table: DataFrame, rows: DataFrame, update: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], key: str = "id") -> DataFrame:
    """table with the stored rows of each key in `rows` replaced by what update(stored, payload) returns.

    update gets the key's stored rows (none for a new key) and its payload rows, and returns rows
    with the columns of table; no row erases the key. Keys without payload don't pass through it.
    """
    touched = rows.select(key).distinct()
    stored = table.join(touched, key, "left_semi")
    fresh = stored.groupBy(key).cogroup(rows.groupBy(key)).applyInPandas(update, table.schema)
    return union(table.join(touched, key, "left_anti").select(*table.columns), fresh)


def erase_keys(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def erase_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true; null counts as not true."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def copy_live(nodes: DataFrame, now: int) -> DataFrame:
    """Nodes to copy to another store: unexpired ones, with the seconds they have left (null: no end)."""
    left = F.when(F.col("expire_ts") != 0, F.col("expire_ts") - now)
    return nodes.where(~expired(F.col("expire_ts"), now)).withColumn("left", left)


def key_sizes(edges: DataFrame, attr_values: int = 0, edge_bytes: int = 26) -> DataFrame:
    """Per source the bytes its list would take: 8 a key and attribute value, edge_bytes an edge."""
    n = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return n.select("id", (F.lit(8 + 8 * attr_values) + F.col("n") * edge_bytes).alias("size"))


class PoolSnapshot:
    """A pool drawn from a stored state of its nodes until refresh() takes a new one.

    `source` gives the pool (id, weight); `path` holds numbered versions of it.
    """

    def __init__(self, source: Callable[[], DataFrame], path: str):
        self.source, self.path, self.version = source, path, 0

    def refresh(self) -> PoolSnapshot:
        self.source().write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1}")
        self.version += 1
        return self

    def draw(self, spark, n: int, seed: int = 1) -> DataFrame:
        if not self.version:
            raise RuntimeError("the pool is not ready: refresh it first")
        return draw_nodes(spark.read.parquet(f"{self.path}/v{self.version}"), n, seed)
