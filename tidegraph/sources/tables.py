"""Relations built from the star-schema tables; ids are shifted by one because 0 is no node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codes of event types.
EVENT_CODES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(t: Column) -> Column:
    """Seconds of a time without a zone, whatever the session's zone is."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t.cast("timestamp_ntz")).cast("long")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to part, one row an order line, in arrival order seq."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_custkey") + 1).alias("src"),
        (F.col("l_partkey") + 1).alias("dst"),
        F.col("l_quantity").alias("weight"),
        epoch(F.col("l_shipdate")).alias("ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def latest(log: DataFrame) -> DataFrame:
    """One edge a pair: the one with the latest (ts, seq)."""
    last = log.groupBy("src", "dst").agg(F.max(F.struct("ts", "seq", "weight")).alias("e"))
    return last.select("src", "dst", "e.weight", "e.ts", "e.seq")


def customer_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2P: upserted purchases."""
    return latest(purchases(spark, sf_dir))


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2S: part to supplier, upserted."""
    lines = table(spark, sf_dir, "lineitem")
    return latest(
        lines.select(
            (F.col("l_partkey") + 1).alias("src"), (F.col("l_suppkey") + 1).alias("dst"), F.col("l_quantity").alias("weight"),
            epoch(F.col("l_shipdate")).alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        )
    )


def user_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2T: user to event type, a multigraph."""
    code = F.lit(0)
    for name, value in EVENT_CODES.items():
        code = F.when(F.col("event_type") == name, value).otherwise(code)
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") + 1).alias("src"), code.cast("long").alias("dst"), F.col("value").alias("weight"),
        epoch(F.col("ts")).alias("ts"), F.col("event_id").alias("seq"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of C2P with the nation and the balance as attributes."""
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1).alias("id"),
        F.array(F.col("c_nationkey").cast("long")).alias("int_attrs"),
        F.array(F.col("c_acctbal").cast("float")).alias("float_attrs"),
    )


def customer_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a seed; many have no purchase."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seed_pos"), (F.col("c_custkey") + 1).alias("id"))
