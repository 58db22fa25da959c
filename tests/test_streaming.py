"""Continuous ingest agrees with batch upserts."""

from pyspark.sql import functions as F

from tidegraph.plans.graph import Relation
from tidegraph.schema import RelationConfig
from tidegraph.streaming import ingest

SCHEMA = "src long, dst long, weight double, ts long, seq long"


def _write(spark, path, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{name}")


def test_foreach_batch_folds_once(spark, tmp_path):
    rows = [(i % 3 + 1, i % 5 + 1, float(i + 1), i, i) for i in range(30)]
    _write(spark, tmp_path / "in", rows[:12], "a")
    cfg = RelationConfig("r", edge_max_num=4)
    sink = ingest.TableSink(Relation(spark, cfg), f"file://{tmp_path}/out", lambda _: 1000, "add", buckets=8)
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for batch in range(2):
        if batch:
            _write(spark, tmp_path / "in", rows[12:], "b")
        query = ingest.ingest(stream, sink, f"file://{tmp_path}/cp")
        query.processAllAvailable()
        query.stop()
    want = Relation(spark, cfg).upsert(spark.createDataFrame(rows, SCHEMA), 1000, "add")
    read = lambda r: sorted((x["src"], x["dst"], x["weight"], x["ts"]) for x in r.edges.collect())
    got = sink.current()
    assert read(got) == read(want)
    assert sorted(r["degree"] for r in got.nodes.collect()) == sorted(r["degree"] for r in want.nodes.collect())
    before = read(got)
    sink(spark.createDataFrame(rows[12:], SCHEMA), 1)  # the same batch again
    assert read(sink.current()) == before and len(sink.versions()) == 2
    # another checkpoint goes on from what is there and writes its own sources' buckets only
    folders = sink.manifest()["folders"]
    again = ingest.TableSink(Relation(spark, cfg), f"file://{tmp_path}/out", lambda _: 1000, "add", run="other")
    again(spark.createDataFrame([(1, 9, 5.0, 99, 99)], SCHEMA), 0)
    assert (1, 9, 5.0, 99) in read(again.current()) and len(read(again.current())) == len(before)
    assert sum(folders[b] != f for b, f in again.manifest()["folders"].items()) == 1
    assert len(again.versions()) == 2
    used = {f.rpartition("/data/")[2] for v in again.versions() for f in again.manifest(v)["folders"].values()}
    have = {f"{v.name}/{b.name}" for v in (tmp_path / "out" / "data").iterdir() for b in v.iterdir() if b.is_dir()}
    assert used == have


def test_keyed_state_and_windows(spark, tmp_path):
    rows = [(1, 5, 1.0, 10, 0), (1, 6, 1.0, 20, 1), (1, 5, 9.0, 5, 2), (1, 7, 1.0, 30, 3), (2, 8, 1.0, 1, 4)]
    _write(spark, tmp_path / "in", rows, "a")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = ingest.latest_edges(stream).writeStream.outputMode("update").format("memory").queryName("newest").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted((r["src"], r["dst"], r["weight"]) for r in spark.table("newest").collect()) == [(1, 5, 1.0), (1, 6, 1.0), (1, 7, 1.0), (2, 8, 1.0)]
    query = ingest.event_counts(stream).writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 5
