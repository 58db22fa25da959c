"""Versioned checkpoints of relations in Parquet: root/checkpoints/version=V/relation=R/{edges,nodes}.

A version counts once its marker `_DONE` lies beside it; the newest one is loaded.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.functions.scalars import expired, fit_attrs
from tidegraph.operators import upsert
from tidegraph.schema import RelationConfig
from tidegraph.scratch import materialise


def hadoop_fs(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def save(root: str, version: int, relations: dict[str, tuple[DataFrame, DataFrame]], now: int) -> None:
    """Write each relation's (edges, nodes) without expired nodes and their edges, then the marker."""
    base = f"{root}/checkpoints/version={version}"
    spark = None
    for name, (edges, nodes) in relations.items():
        spark = edges.sparkSession
        live = nodes.where(~expired(F.col("expire_ts"), now))
        gone = nodes.where(expired(F.col("expire_ts"), now)).select(F.col("id").alias("src"))
        edges.join(gone, "src", "left_anti").write.mode("overwrite").parquet(f"{base}/relation={name}/edges")
        live.write.mode("overwrite").parquet(f"{base}/relation={name}/nodes")
    if spark is not None:
        fs, path = hadoop_fs(spark, f"{base}/_DONE")
        fs.create(path, True).close()


def versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions in rising order."""
    fs, path = hadoop_fs(spark, f"{root}/checkpoints")
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_DONE")
        if name.startswith("version=") and fs.exists(done):
            found.append(int(name.partition("=")[2]))
    return sorted(found)


def load(spark: SparkSession, root: str, relation: str, version: int | None = None, shard: int = 0, shards: int = 1) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a relation in a version, the newest finished one by default; of several shards, one's sources."""
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(f"no finished checkpoint below {root}")
    base = f"{root}/checkpoints/version={known[-1] if version is None else version}/relation={relation}"
    edges, nodes = spark.read.parquet(f"{base}/edges"), spark.read.parquet(f"{base}/nodes")
    return (edges, nodes) if shards == 1 else (shard_rows(edges, "src", shard, shards), shard_rows(nodes, "id", shard, shards))


def should_read(file_shard: int, old_shards: int, shard: int, new_shards: int) -> bool:
    """Whether a shard of a new layout needs a file of an old one."""
    common = math.gcd(old_shards, new_shards)
    return file_shard % common == shard % common


def shard_rows(df: DataFrame, key: str, shard: int, shards: int) -> DataFrame:
    """Rows of one shard: key modulo the number of shards, keys taken as unsigned."""
    unsigned = F.when(F.col(key) >= 0, F.col(key).cast("decimal(20,0)")).otherwise(F.col(key).cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)"))
    return df.where(unsigned % shards == shard)


def migrate(edges: DataFrame, nodes: DataFrame, cfg: RelationConfig, expire_delta: int = 0) -> tuple[DataFrame, DataFrame]:
    """A relation under a new layout: attributes cut or filled with zeros, expiry moved (not below 0), edges
    inserted anew by ADD in the order of their times under the new capacity and eviction."""
    own = edges.withColumn("seq", F.row_number().over(Window.partitionBy("src").orderBy("ts", "seq", "dst")).cast("long"))
    blocks = {"int_attrs": (cfg.edge_int_attr_len, "long"), "float_attrs": (cfg.edge_float_attr_len, "float")}
    own = own.withColumns({c: fit_attrs(F.col(c), n, k) if c in own.columns else fit_attrs(F.lit(None), n, k) for c, (n, k) in blocks.items()})
    folded = materialise(upsert.fold(None, None, own, cfg, "add", now=0))
    kept = upsert.split_folded(folded)[0]
    counts = kept.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("edge_num"))
    moved = nodes.drop("edge_num").join(counts, "id", "left").select(
        "id", "degree", F.coalesce("edge_num", F.lit(0)).alias("edge_num"), F.greatest(F.lit(0), F.col("expire_ts") + expire_delta).alias("expire_ts"),
        fit_attrs(F.col("int_attrs"), cfg.int_attr_len).alias("int_attrs"), fit_attrs(F.col("float_attrs"), cfg.float_attr_len, "float").alias("float_attrs"),
    )
    return kept, moved
