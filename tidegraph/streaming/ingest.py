"""Continuous ingest with Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegraph.operators import upsert
from tidegraph.plans.graph import Relation
from tidegraph.schema import EDGE_SCHEMA
from tidegraph.sources.checkpoint import hadoop_fs
from tidegraph.unions import union


class TableSink:
    """foreachBatch sink: folds each micro-batch into a relation kept as Parquet in buckets of sources.

    A batch reads and writes the buckets of its own sources only; the others stay where they are.
    `manifest-N.json` lists each bucket's folder and the last batch of each run; writing it makes
    version N count. A run is one streaming checkpoint: a batch of a run that the newest version
    holds already changes nothing, and a new run goes on from the newest version. Folders that
    neither of the two newest versions lists are removed.
    """

    def __init__(self, relation: Relation, path: str, clock: Callable[[int], int], action: str = "replace", buckets: int = 256, run: str = "run"):
        self.relation, self.path, self.clock, self.action, self.buckets, self.run = relation, path.rstrip("/"), clock, action, buckets, run
        self.spark = relation.spark

    def versions(self) -> list[int]:
        fs, path = hadoop_fs(self.spark, self.path)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, runs and folders; of the newest version by default, an empty one where there is none."""
        known = self.versions()
        if not known:
            return {"version": -1, "runs": {}, "folders": {}, "buckets": self.buckets}
        text = self.spark.read.text(f"{self.path}/manifest-{known[-1] if version is None else version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _bucket(self, column: str, n: int):
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    def _state(self, manifest: dict, only: set[int] | None = None) -> DataFrame | None:
        """Folded rows of some buckets (all by default); None where there are none."""
        wanted = [f for b, f in manifest["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(upsert.FOLDED).parquet(*wanted) if wanted else None

    def _first_state(self) -> None:
        """Version 0: the relation that the sink begins with."""
        folded = upsert.join_folded(self.relation.edges, self.relation.nodes)
        self._write(folded, self.manifest(), {})

    def _write(self, folded: DataFrame, old: dict, runs: dict[str, int]) -> None:
        version, n = old["version"] + 1, old["buckets"]
        where = f"{self.path}/data/v{version}"
        folded.withColumn("bucket", self._bucket("src", n)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(where)
        fs, path = hadoop_fs(self.spark, where)
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        fresh = {name.partition("=")[2]: f"{where}/{name}" for name in names if name.startswith("bucket=")}
        new = {"version": version, "runs": {**old["runs"], **runs}, "folders": {**old["folders"], **fresh}, "buckets": n}
        part = hadoop_fs(self.spark, f"{self.path}/manifest-{version}.part")[1]
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if not fs.rename(part, hadoop_fs(self.spark, f"{self.path}/manifest-{version}.json")[1]):
            raise RuntimeError(f"version {version} is already there: another sink writes to {self.path}")
        self._forget(old, new)

    def _forget(self, *kept: dict) -> None:
        """Remove manifests before the kept ones, and folders that only they list."""
        fs, _ = hadoop_fs(self.spark, self.path)
        used = {f for m in kept for f in m["folders"].values()}
        for version in self.versions():
            if version < min(m["version"] for m in kept):
                for folder in set(self.manifest(version)["folders"].values()) - used:
                    fs.delete(hadoop_fs(self.spark, folder)[1], True)
                fs.delete(hadoop_fs(self.spark, f"{self.path}/manifest-{version}.json")[1], False)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if not self.versions():
            self._first_state()
        old = self.manifest()
        if old["runs"].get(self.run, -1) >= batch_id:
            return
        batch = batch.persist()
        try:
            n = old["buckets"]
            touched = {r[0] for r in batch.select(self._bucket("src", n)).distinct().collect()}  # n at most
            state = self._state(old, touched)
            edges, nodes = upsert.split_folded(state) if state is not None else (None, None)
            folded = upsert.fold(edges, nodes, batch, self.relation.cfg, self.action, self.clock(batch_id))
            if state is not None:
                folded = union(folded, state.join(batch.select("src").distinct(), "src", "left_anti").select(*folded.columns))
            self._write(folded, old, {self.run: batch_id})
        finally:
            batch.unpersist()

    def current(self, version: int | None = None) -> Relation:
        """The relation as of a version, the newest by default."""
        if not self.versions():
            return self.relation
        state = self._state(self.manifest(version))
        if state is None:
            return Relation(self.spark, self.relation.cfg, self.spark.createDataFrame([], EDGE_SCHEMA))
        return Relation(self.spark, self.relation.cfg, *upsert.split_folded(state))


def ingest(stream: DataFrame, sink: TableSink, checkpoint: str) -> StreamingQuery:
    """Fold a stream of edges into the sink's relation; the checkpoint is the sink's run."""
    sink.run = checkpoint
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def latest_edges(stream: DataFrame) -> DataFrame:
    """Each pair's latest edge by (ts, seq) as keyed state, emitted whenever it changes (output mode update).

    An edge that comes later than its stored time changes nothing; no watermark drops it.
    """
    last = stream.where(F.col("dst") != 0).groupBy("src", "dst").agg(F.max(F.struct("ts", "seq", "weight")).alias("e"))
    return last.select("src", "dst", "e.weight", "e.ts", "e.seq")


def event_counts(stream: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Edges and weight a source in windows of event time aligned to the epoch, with a watermark."""
    at = stream.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return at.groupBy(F.window("at", window), "src").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
