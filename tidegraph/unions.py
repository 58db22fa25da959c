"""Unions whose rows of one key may lie in any partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union(first: DataFrame, *more: DataFrame, missing: bool = False) -> DataFrame:
    """Rows of all tables, columns by name; with `missing`, columns that a table lacks are null.

    Spark 4.1 takes a union of tables dealt by one key as dealt by that key, but adaptive execution may
    have merged the partitions of each table in its own way. A later exchange by the key is then left
    out and rows of a key stay apart, so that belief is switched off for the session.
    """
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), more, first)
