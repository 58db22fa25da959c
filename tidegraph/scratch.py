"""Tables written to the folder that all executors share, which cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.

    Where the setting is unset, a session on one machine gets a folder of that machine; on a
    cluster, whose executors would not share it, this is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidegraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidegraph-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table", where: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and return it as read back."""
    path = f"{where or scratch_dir(df.sparkSession)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
