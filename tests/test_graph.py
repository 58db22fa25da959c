"""Golden cases of edge lists, sampling, pools and the fluent API."""

import math

import pytest
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.functions import scalars
from tidegraph.operators import lookup, maintain, pools, stats, store, upsert
from tidegraph.operators.sampling import sample_neighbors
from tidegraph.plans.graph import Graph, Relation, seconds
from tidegraph.schema import RelationConfig, resolve_config
from tidegraph.sources import checkpoint, text
from tidegraph.streaming import schedule

NOW = 1_700_000_000


def log(spark, rows, src=1):
    """rows: (dst, weight, ts)"""
    return spark.createDataFrame([(src, d, float(w) if w is not None else None, t, i) for i, (d, w, t) in enumerate(rows)], "src long, dst long, weight double, ts long, seq long")


def folded(spark, rows, action="replace", **cfg):
    out = upsert.fold(None, None, log(spark, rows), RelationConfig("r", **{"edge_max_num": 100, **cfg}), action, NOW)
    edges, nodes = upsert.split_folded(out)
    return edges, nodes.collect()[0]


def order(spark, edges, strategy, n, padding="zero", **options):
    seeds = spark.createDataFrame([(0, 1)], "seed_pos long, id long")
    return [r["dst"] for r in sample_neighbors(seeds, edges, strategy, n, padding, **options).orderBy("draw").collect()]


TS = dict(zip(range(1, 11), (1, 2, 4, 10, 8, 7, 3, 6, 9, 5), strict=True))


def test_most_recent_ties_and_padding(spark):
    edges, _ = folded(spark, [(i, 1, None) for i in range(1, 11)])
    assert order(spark, edges, "most_recent", 15) == [10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0, 0, 0, 0, 0]
    assert order(spark, edges, "least_recent", 3) == [1, 2, 3]


def test_most_recent_by_time(spark):
    edges, _ = folded(spark, [(i, 1, TS[i]) for i in TS])
    assert order(spark, edges, "most_recent", 10) == [4, 9, 5, 6, 8, 10, 3, 7, 2, 1]
    assert order(spark, edges, "most_recent", 10, max_ts=6, drop_padding=True) == [8, 10, 3, 7, 2, 1]


def test_top_by_weight_after_add(spark):
    weights = (2, 7, 58, 4, 7, 9, 34, 8, 9, 3, 1)
    edges, _ = folded(spark, list(zip((*range(1, 11), 4), weights, [None] * 11, strict=True)), "add")
    assert set(order(spark, edges, "topn_weight", 5)) == {3, 7, 9, 6, 8}
    assert edges.where("dst = 4").collect()[0]["weight"] == 5


def test_replace(spark):
    edges, node = folded(spark, list(zip((3, 4, 5, 2, 1, 4, 3, 1), (3, 4, 5, 2, 1, 3, 4, 10), [None] * 8, strict=True)))
    assert {r["dst"]: r["weight"] for r in edges.collect()} == {3: 4, 4: 3, 5: 5, 2: 2, 1: 10}
    assert (node["degree"], node["edge_num"]) == (8, 5)


def test_max_and_avg(spark):
    rows = [(1, 4, 1), (1, 2, 2), (1, 9, 3)]
    assert folded(spark, rows, "max")[0].collect()[0]["weight"] == 9
    assert folded(spark, rows, "avg", elst="cpt_precise_weight_indexed")[0].collect()[0]["weight"] == 6
    assert folded(spark, rows, "avg")[0].collect()[0]["weight"] == 9


def test_evict_oldest(spark):
    ids = (4, 4, 5, 2, 1, 9, 6, 10, 8, 7, 12, 11)
    edges, _ = folded(spark, [(i, 1, None) for i in ids], edge_max_num=5)
    assert order(spark, edges, "least_recent", 5) == [10, 8, 7, 12, 11]


def test_evict_happens_before_the_lookup(spark):
    rows = [(i, i, None) for i in range(1, 11)] + [(11, 20, None), (7, 7, None)]
    edges, node = folded(spark, rows, "add", edge_max_num=10, eviction="weight")
    assert node["edge_num"] == 9 and node["degree"] == 12
    assert {r["dst"] for r in edges.collect()} == {3, 4, 5, 6, 7, 8, 9, 10, 11}


def test_cancel_random_and_late(spark):
    edges, node = folded(spark, [(i, 1, None) for i in range(1, 6)], edge_max_num=3, eviction="cancel")
    assert {r["dst"] for r in edges.collect()} == {1, 2, 3} and node["degree"] == 3
    edges, node = folded(spark, [(i, 1, None) for i in range(1, 30)], edge_max_num=3, eviction="random")
    assert node["edge_num"] == 3 and node["degree"] == 29
    edges, node = folded(spark, [(1, 5, 10), (1, 7, 4), (0, 1, 1), (2, 5000, 1)])
    assert [(r["dst"], r["weight"]) for r in edges.collect()] == [(1, 5)] and node["degree"] == 2


def test_multigraph_keeps_newest(spark):
    edges, node = folded(spark, [(i, 1, i) for i in range(1, 14)], elst="cdf", edge_max_num=10)
    assert order(spark, edges, "most_recent", 10, elst="cdf") == list(range(13, 3, -1))
    assert node["degree"] == 13
    rows = [(i, 1, 0) for i in range(1, 11)] + [(i, 1, 10) for i in (101, 102, 103)]
    edges, _ = folded(spark, rows, elst="cdf", edge_max_num=20)
    assert order(spark, edges, "most_recent", 13, min_ts=1, elst="cdf", drop_padding=True) == [103, 102, 101]
    with pytest.raises(ValueError):
        order(spark, edges, "topn_weight", 3, elst="cdf")


def test_window_agrees_with_fold(spark):
    """Distinct times and pairs: the newest rows by time are what the fold keeps."""
    rows = [(i, 1, (i * 37) % 101 + 1) for i in range(1, 60)]
    for cap in (1, 7, 59):
        edges, _ = folded(spark, rows, edge_max_num=cap)
        want = upsert.keep_newest(log(spark, rows), cap)
        assert {r["dst"] for r in edges.collect()} == {r["dst"] for r in want.collect()}


def test_upsert_in_two_batches_equals_one(spark):
    rows = [(i % 7 + 1, i + 1, i) for i in range(40)]
    cfg = RelationConfig("r", edge_max_num=5)
    whole = Relation(spark, cfg).upsert(log(spark, rows), NOW, "add")
    first = Relation(spark, cfg).upsert(log(spark, rows).where("seq < 17"), NOW, "add")
    both = first.upsert(log(spark, rows).where("seq >= 17"), NOW, "add")
    read = lambda r: sorted((x["dst"], x["weight"], x["ts"]) for x in r.edges.collect())
    assert read(whole) == read(both)
    assert whole.nodes.collect()[0]["degree"] == both.nodes.collect()[0]["degree"]


def test_batches_meet_their_sources(spark):
    """Tables that are all dealt by source, of different sizes: a batch finds the edges and nodes it changes."""
    many = spark.range(40000).select((F.col("id") % 500 + 1).alias("src"), (F.col("id") % 37 + 1).alias("dst"), F.lit(1.0).alias("weight"), F.col("id").alias("ts"), F.col("id").alias("seq"))
    packed = many.groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct("seq", "dst"))), 1, 30).alias("own"))
    relation = Relation(spark, RelationConfig("r"))
    for low, high in ((1, 20), (21, 5), (26, 5)):
        batch = packed.select("src", F.explode(F.slice("own", low, high)).alias("e")).select("src", "e.dst", F.lit(1.0).alias("weight"), F.col("e.seq").alias("ts"), "e.seq")
        relation = relation.upsert(batch, NOW, "add")
    nodes = relation.nodes.collect()
    assert len(nodes) == 500 and {r["degree"] for r in nodes} == {30}
    assert relation.edges.agg(F.sum("weight")).first()[0] == 15000 and stats.broken_edges(relation.edges, 1000).count() == 0


def test_time_to_live(spark):
    cfg = RelationConfig("r", expire_interval=100)
    relation = Relation(spark, cfg).upsert(log(spark, [(1, 1, NOW - 50)]), NOW, use_item_ts=True)
    assert relation.nodes.collect()[0]["expire_ts"] == NOW + 100
    later = relation.upsert(log(spark, [(2, 1, NOW + 80)]), NOW + 10, use_item_ts=True)
    assert later.nodes.collect()[0]["expire_ts"] == NOW + 180
    assert later.expire(NOW + 180).nodes.count() == 0
    assert later.node(1, NOW + 180).count() == 0 and later.node(1).count() == 1


def test_decay(spark):
    edges = log(spark, list(zip(range(1, 11), (2, 3, 4, 5, 6, 7, 8, 12, 16, 32), [0] * 10, strict=True)))
    once = maintain.decay_edges(edges, 0.5, 1.01)
    assert edges.count() - once.count() == 1
    assert once.count() - maintain.decay_edges(edges, 0.5, 1.01, 2).count() == 2
    nodes = spark.createDataFrame([(1, 7)], "id long, degree long")
    assert maintain.decay_degrees(nodes, 0.5, 2).collect()[0]["degree"] == 1
    assert maintain.ticks_between(99, 301, 100) == 3


def test_delete_and_expire_edges(spark):
    relation = Relation(spark, RelationConfig("r", edge_expire_interval_s=100)).upsert(log(spark, [(1, 1, NOW), (2, 1, NOW - 500)]), NOW)
    pairs = spark.createDataFrame([(1, 1), (1, 0), (9, 9)], "src long, dst long")
    assert relation.delete(pairs, NOW).edges.count() == 2  # a group with an id 0 deletes nothing
    runs = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (9, 9, 2), (0, 2, 3)], "src long, dst long, run long")
    gone = relation.delete(runs, NOW)
    assert [r["dst"] for r in gone.edges.collect()] == [2] and gone.nodes.collect()[0]["degree"] == 2
    assert [r["dst"] for r in relation.expire(NOW).edges.collect()] == [1]
    both = gone.delete(spark.createDataFrame([(1, 2)], "src long, dst long"), NOW)
    assert both.nodes.collect()[0]["expire_ts"] == NOW


def test_weighted_and_uniform_frequencies(spark):
    edges = log(spark, [(i, i, 0) for i in range(1, 5)], src=10000)
    seeds = spark.range(20000).select(F.col("id").alias("seed_pos"), F.lit(10000).cast("long").alias("id"))
    for strategy, want in (("weight", lambda i: i / 10), ("random", lambda i: 0.25)):
        got = sample_neighbors(seeds, edges, strategy, 5).groupBy("dst").count().collect()
        for r in got:
            assert abs(r["count"] / 100000 - want(r["dst"])) < 0.01
    first = sample_neighbors(seeds, edges, "weight", 1, without_replacement=True).groupBy("dst").count().collect()
    for r in first:
        assert abs(r["count"] / 20000 - r["dst"] / 10) < 0.015


def test_without_replacement_is_distinct(spark):
    edges = log(spark, [(i, 1, 0) for i in range(1, 9)])
    got = order(spark, edges, "random", 12, without_replacement=True, drop_padding=True)
    assert sorted(got) == list(range(1, 9))


def test_paddings(spark):
    edges = log(spark, [(5, 2, 9), (6, 3, 8)])
    assert order(spark, edges, "most_recent", 5, "neigh_loop") == [5, 6, 5, 6, 5]
    assert order(spark, edges, "most_recent", 4, "self") == [5, 6, 1, 1]
    assert order(spark, edges.limit(0), "most_recent", 2, "neigh_loop") == [1, 1]
    assert order(spark, edges.limit(0), "random", 2, "no_padding") == [0, 0]
    with pytest.raises(ValueError):
        order(spark, edges, "most_recent", 2, "other")
    with pytest.raises(ValueError):
        order(spark, edges, "newest", 2)


def test_seeds_repeat_and_null(spark):
    edges = log(spark, [(5, 2, 9), (6, 3, 8)])
    seeds = spark.createDataFrame([(0, 1), (1, 1), (2, None), (3, 77)], "seed_pos long, id long")
    got = sample_neighbors(seeds, edges, "topn_weight", 1, "zero").orderBy("seed_pos").collect()
    assert [r["dst"] for r in got] == [6, 6, 0, 0]


def test_pools(spark):
    nodes = spark.createDataFrame([(1, 1, 1, 0, [1], [0.0]), (2, 2, 2, 0, [2], [0.0]), (3, 2, 2, 0, [2], [0.0]), (4, 0, 0, NOW - 5, [9], [0.0])], "id long, degree long, edge_num long, expire_ts long, int_attrs array<long>, float_attrs array<float>")
    got = {r["id"]: r["count"] / 50000 for r in pools.random_nodes(nodes, 50000, "degree").groupBy("id").count().collect()}
    assert abs(got[1] - 0.2) < 0.01 and abs(got[2] - 0.4) < 0.01 and 4 not in got
    got = {r["id"]: r["count"] / 30000 for r in pools.random_nodes(nodes, 30000, keep=pools.pool_filter(now=NOW)).groupBy("id").count().collect()}
    assert set(got) == {1, 2, 3} and all(abs(v - 1 / 3) < 0.01 for v in got.values())
    assert pools.random_nodes(nodes.limit(0), 5).count() == 0
    w = nodes.select("id", pools.pool_weight("int_attr", 0, "power", 2.0).alias("w")).collect()
    assert {r["id"]: r["w"] for r in w} == {1: 1, 2: 4, 3: 4, 4: 81}


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).collect()[0]["x"]
    assert value(scalars.path_time(F.lit("/x/dt=20210526/part"))) == 1621958400
    assert value(scalars.path_time(F.lit("/x/dt=202108131804"))) == 1628849040
    assert value(scalars.path_time(F.lit("/x/dt=20211345"))) == 0
    bounds = [0, 20, 30, 50, 100]
    assert [value(scalars.range_label(F.lit(v), bounds)) for v in (35, 20, -10, 120)] == ["30-50", "20-30", "floor-0", "100-upper"]
    assert value(scalars.to_seconds(F.lit(1_600_000_000_123).cast("long"))) == 1_600_000_000 == seconds(1_600_000_000_123)
    assert value(scalars.fit_attrs(F.array(F.lit(1), F.lit(2), F.lit(3)), 2)) == [1, 2]
    assert value(scalars.fit_attrs(F.lit(None).cast("array<long>"), 2)) == [0, 0]
    block = F.array(*[F.lit(i + 1) for i in range(8)], *[F.lit(0)] * 8)
    assert value(scalars.used_ratio(block)) == 0.5
    assert value(scalars.set_attr(F.array(F.lit(1), F.lit(2)), 1, F.lit(9))) == [1, 9]
    assert abs(value(scalars.transform_weight(F.lit(5.0), "log1p")) - math.log(6)) < 1e-12
    assert value(scalars.query_parameters(F.lit("a=1&b=2"))) == {"a": "1", "b": "2"}


def test_text_round_trip(spark, tmp_path):
    (tmp_path / "dt=20210526").mkdir()
    lines = ["1|1,2|0.5|5\u00031.5\u00037\u00048\u00030.25,6\u00032\u0003\\N\u0003\\N", "2|\\N|\\N", "x|1|2|3", "", "3|1|1|9\u00034"]
    (tmp_path / "dt=20210526" / "a.txt").write_text("\n".join(lines) + "\n")
    edges, bad = text.load_text(spark, str(tmp_path), NOW, ts_from_path=True)
    rows = {(r["src"], r["dst"]): r for r in edges.collect()}
    assert set(rows) == {(1, 5), (1, 6), (2, 0), (3, 9)}
    assert rows[1, 5]["int_attrs"] == [7, 8] and rows[1, 5]["ts"] == 1621958400 and rows[1, 5]["node_ints"] == [1, 2]
    assert sorted(r["value"] for r in bad.collect()) == ["", "x|1|2|3"]


def test_checkpoints(spark, tmp_path):
    root = f"file://{tmp_path}"
    relation = Relation(spark, RelationConfig("r", expire_interval=10)).upsert(log(spark, [(1, 2, 3)]), NOW)
    with pytest.raises(FileNotFoundError):
        checkpoint.load(spark, root, "r")
    checkpoint.save(root, 1, {"r": (relation.edges, relation.nodes)}, NOW)
    checkpoint.save(root, 2, {"r": (relation.edges, relation.nodes)}, NOW + 10)
    (tmp_path / "checkpoints" / "version=3").mkdir()
    assert checkpoint.versions(spark, root) == [1, 2]
    assert checkpoint.load(spark, root, "r")[0].count() == 0
    edges, nodes = checkpoint.load(spark, root, "r", 1)
    assert edges.count() == nodes.count() == 1
    cfg = RelationConfig("r", edge_max_num=10, int_attr_len=2, float_attr_len=1)
    moved = checkpoint.migrate(edges, nodes.withColumn("int_attrs", F.array(F.lit(4).cast("long"))), cfg, -(NOW + 50))[1].collect()[0]
    assert moved["int_attrs"] == [4, 0] and moved["float_attrs"] == [0.0] and moved["expire_ts"] == 0
    assert [f for f in range(6) if checkpoint.should_read(f, 6, 1, 4)] == [1, 3, 5]
    ids = spark.createDataFrame([(-1,), (5,), (6,)], "id long")
    assert [r["id"] for r in checkpoint.shard_rows(ids, "id", 3, 4).collect()] == [-1]  # 2**64 - 1 is 3 modulo 4
    assert [checkpoint.load(spark, root, "r", 1, shard, 2)[0].count() for shard in range(2)] == [0, 1]


def test_migration_inserts_anew(spark):
    """Edges go in by their times under the new capacity and eviction; their attributes are cut or filled."""
    edges = log(spark, [(1, 5, 30), (2, 1, 10), (3, 3, 20), (4, 2, 40)]).withColumn("int_attrs", F.array(F.lit(7).cast("long"), F.lit(8).cast("long")))
    nodes = Relation(spark, RelationConfig("r"), edges).nodes.withColumn("expire_ts", F.lit(90).cast("long"))
    cfg = RelationConfig("r", edge_max_num=3, eviction="weight", edge_int_attr_len=1, edge_float_attr_len=2)
    kept, moved = checkpoint.migrate(edges, nodes, cfg, -100)
    # arriving as 2, 3, 1 and 4: the lightest of the first three makes room for the last
    assert sorted((r["dst"], r["weight"], r["int_attrs"], r["float_attrs"]) for r in kept.collect()) == [(1, 5, [7], [0, 0]), (3, 3, [7], [0, 0]), (4, 2, [7], [0, 0])]
    assert [(r["edge_num"], r["degree"], r["expire_ts"]) for r in moved.collect()] == [(3, 4, 0)]


def test_fluent_chain(spark):
    graph = Graph(spark)
    click = {1: [100, 102, 106, 108, 110], 2: [101, 106, 108], 3: [102, 103, 105, 107, 109], 4: [100, 102, 104, 106], 5: [103, 108]}
    rows = [(s, d) for s, ds in click.items() for d in ds]
    for name, pairs in (("U2I", rows), ("I2U", [(d, s) for s, d in rows])):
        graph.add_relation(Relation(spark, RelationConfig(name, int_attr_len=2, float_attr_len=1)))
        insert = graph.insert_edges(name, 2, 1)
        insert.more_edges([p[0] for p in pairs], [p[1] for p in pairs], [1.0] * len(pairs), [NOW] * len(pairs), [x for p in pairs for x in (p[0], 7)], [0.5] * len(pairs))
        insert.emit(NOW)
    assert graph.relations["U2I"].nodes.count() == 5 and graph.relations["I2U"].nodes.count() == 11
    out = (
        graph.set_nodes("U2I", [1, 5, 1, 99], "x").sample_neighbor("U2I", "y").sample(3).by("random", "self").with_attr("I2U", 2, 1)
        .sample_neighbor("I2U", "z").sample(2).by("most_recent", "neigh_loop").max_timestamp(NOW * 1000).emit()
    )
    assert set(out) == {"x", "y", "z"}
    y = out["y"].collect()
    assert len(y) == 12 and all(r["dst"] in click[r["src"]] for r in y if r["src"] != 99)
    assert all(r["dst"] == 99 and not r["attr_exist"] for r in y if r["src"] == 99)
    assert all(r["int_attrs"] == [r["dst"], 7] for r in y if r["src"] != 99)
    assert out["z"].count() == 24
    with pytest.raises(KeyError):
        graph.set_nodes("nope", [1], "x")
    with pytest.raises(ValueError):
        graph.set_nodes("U2I", [1], "x").sample(3)
    with pytest.raises(ValueError):
        graph.insert_edges("U2I").more_edges([1], [2], [1.0]).more_edges([1], [2])
    pages = [graph.iter("I2U", "p").emit()["p"].count() for _ in range(2)]
    assert pages == [11, 0]
    graph.delete_edges("U2I").more_edges([1], [100]).emit(NOW)
    assert graph.relations["U2I"].edges.where("src = 1").count() == 4


def test_parts_cover_all(spark):
    ids = spark.range(1, 500)
    parts = [{r["id"] for r in lookup.traverse_part(ids, 5, p).collect()} for p in range(5)]
    assert sum(map(len, parts)) == 499 and set().union(*parts) == set(range(1, 500))
    with pytest.raises(ValueError):
        lookup.traverse_part(ids, 5, 5)
    page = lookup.exact_page(ids, 100, 4).collect()
    assert sorted(r["id"] for r in page) == list(range(401, 500))


def test_checks_and_quantiles(spark):
    edges = log(spark, [(1, 1, 1), (1, 2, 2)])
    assert stats.broken_edges(edges, 10).count() == 1
    counts = spark.createDataFrame([(i, i) for i in range(1, 11)], "id long, edge_num long")
    assert {r["q"]: r["length"] for r in stats.length_quantiles(counts).collect()} == {10 * i: i for i in range(1, 11)}


def test_combine_is_the_fold(spark):
    """Late rows, ties of times, invalid rows and missing times, against the fold, for every action."""
    rows = [(1 + (i * 7) % 4 if i % 9 else 0, 3000.0 if i % 8 == 5 else float(i % 11 + 1), None if i % 10 == 4 else (i * 37) % 23) for i in range(120)]
    for action in ("add", "replace", "max", "avg"):
        for precise in (True, False):
            cfg = RelationConfig("r", elst="cpt_precise_weight_indexed" if precise else "cpt")
            want = upsert.split_folded(upsert.fold(None, None, log(spark, rows), cfg, action, NOW))[0].collect()
            got = upsert.combine(log(spark, rows), action, precise=precise).collect()
            assert {(r["dst"], round(r["weight"], 9), r["ts"]) for r in got} == {(r["dst"], round(r["weight"], 9), r["ts"]) for r in want}, action
    assert [(r["dst"], r["weight"]) for r in upsert.combine(log(spark, [(5, 2, 100), (5, 3, 50), (0, 1, 1), (7, 5000, 1)]), "add").collect()] == [(5, 2)]


def test_rejected_rows_make_no_node(spark):
    empty = spark.createDataFrame([(1, 0, 1.0, 5, 0)], "src long, dst long, weight double, ts long, seq long")
    assert upsert.fold(None, None, empty, RelationConfig("r"), "add", NOW).count() == 0
    attrs = empty.withColumn("node_ints", F.array(F.lit(4).cast("long")))
    assert upsert.fold(None, None, attrs, RelationConfig("r", int_attr_len=1), "add", NOW).collect()[0]["int_attrs"] == [4]
    had = Relation(spark, RelationConfig("r", expire_interval=100)).upsert(log(spark, [(1, 1, 5)]), NOW)
    assert had.upsert(empty, NOW + 50).nodes.collect()[0]["expire_ts"] == NOW + 100


@pytest.mark.parametrize("eviction", ["lru", "weight", "random", "cancel"])
def test_fold_of_one_long_list(spark, eviction):
    """Lists of thousands of edges, against a plain fold that looks at every edge to make room."""
    cfg = RelationConfig("r", edge_max_num=400, eviction=eviction)
    rows = [((i * 7919) % 1500 + 1, float((i * 31) % 97 + 1), (i * 53) % 977 + 1) for i in range(4000)]
    state, kept = upsert._List(cfg, 1), {}
    for touch, (dst, weight, ts) in enumerate(rows, 1):
        if len(kept) == 400:
            if eviction == "cancel":
                continue
            first = min(kept, key={"lru": lambda k: (kept[k][1], kept[k][2]), "weight": lambda k: (kept[k][0], k), "random": lambda k: k}[eviction])
            if eviction == "lru" and ts <= kept[first][1]:
                continue
            if eviction == "random":
                first = sorted(kept)[int(state._random("evict", touch) * (400 - 1e-9))]
            del kept[first]
        if dst not in kept:
            kept[dst] = (weight, ts, touch)
        elif ts >= kept[dst][1]:
            kept[dst] = (weight + kept[dst][0], ts, touch)
    edges = upsert.split_folded(upsert.fold(None, None, log(spark, rows), cfg, "add", NOW))[0]
    assert {(r["dst"], r["weight"], r["ts"]) for r in edges.collect()} == {(k, w, t) for k, (w, t, _) in kept.items()}


def test_inserts_do_not_grow_plans(spark):
    graph = Graph(spark).add_relation(Relation(spark, RelationConfig("r")))
    for i in range(4):
        graph.insert_edges("r").more_edges([1], [10 + i], [1.0], [NOW + i]).emit(NOW)
    plan = graph.relations["r"].edges._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and graph.relations["r"].edges.count() == 4


def test_labels_do_not_depend_on_reuse(spark):
    """Ranges of ids are drawn once, also where Spark evaluates an exchange for each of its uses."""
    ids = spark.range(0, 60000).select((F.col("id") * 3 + 1).alias("id"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = lookup.reindex(ids).agg(F.max("label"), F.count("*"), F.countDistinct("label")).first()
        pool = ids.limit(3000).select("id", F.lit(1.0).alias("weight"))
        drawn = pools.draw_nodes(pool, 2000).count()
        page = lookup.exact_page(ids, 100, 7).agg(F.min("id"), F.max("id"), F.count("*")).first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert tuple(got) == (59999, 60000, 60000) and drawn == 2000 and tuple(page) == (2101, 2398, 100)


def test_liveness_and_getters(spark):
    cfg = RelationConfig("r", expire_interval=100)
    relation = Relation(spark, cfg).upsert(log(spark, [(5, 1, 1), (6, 1, 2)]), NOW)
    clock = [NOW + 99]
    graph = Graph(spark, lambda: clock[0]).add_relation(relation)
    sampled = lambda: [r["dst"] for r in graph.set_nodes("r", [1], "x").sample_neighbor("r", "y").sample(2).by("most_recent", "zero").emit()["y"].orderBy("draw").collect()]
    assert sampled() == [6, 5]
    clock[0] += 1  # an expiry second is past on the second itself
    assert sampled() == [0, 0]
    pairs = spark.createDataFrame([(0, 1, 5), (1, 2, 5)], "pos long, src long, dst long")
    for now, found in ((NOW + 99, [True, False]), (NOW + 100, [False, False])):
        assert [r["found"] for r in lookup.edge_lookup(pairs, relation.edges, relation.nodes, now).orderBy("pos").collect()] == found
    assert lookup.edges_of(relation.edges, relation.nodes, relation.nodes, NOW + 100).count() == 0
    ids = spark.createDataFrame([(0, 1), (1, 9)], "pos long, id long")
    assert [tuple(r)[2:] for r in lookup.node_getters(ids, relation.nodes, NOW).orderBy("pos").collect()] == [(NOW + 100, 2, 2), (0, 0, 0)]
    assert [r["expire_ts"] for r in lookup.node_getters(ids, relation.nodes, NOW + 100).collect()] == [0, 0]
    with pytest.raises(TypeError):
        graph.set_nodes("r", [1], "x").sample_neighbor("r", "y").sample("2")
    with pytest.raises(TypeError):
        graph.set_nodes("r", [1], "x").sample_neighbor("r", "y").max_timestamp(1.5)


def test_graph_from_a_configuration(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1|\\N|\\N|5\u00031.5,6\u00032\n2|\\N|\\N|7\n")
    document = {
        "host_service_config": {"default": "a"}, "service_config": {"a": {"dbs": ["x", {"relation_name": "y", "edge_max_num": 7, "oversize_replace_strategy": 2, "attr_op_config": {"int_max_size": 3}}], "default_init": []}},
        "db_list": [{"relation_name": "x", "init": ["lines"]}], "init_list": [{"name": "lines", "path": str(tmp_path / "a.txt")}],
    }
    graph = Graph.from_config(spark, document, "any", lambda: NOW)
    assert graph.relations["x"].edges.count() == 3 and graph.relations["y"].cfg.eviction == "weight" and graph.relations["y"].cfg.int_attr_len == 3
    checkpoint_root = f"file://{tmp_path}/cp"
    scheduler = schedule.Scheduler().every(10, "save", schedule.checkpoint_job(graph, checkpoint_root)).every(25, "fail", lambda now: 1 / 0)
    assert scheduler.tick(NOW) == [] and scheduler.tick(NOW + 9) == [] and scheduler.tick(NOW + 25) == ["save"]
    document["db_list"][0].pop("init")
    again = Graph.from_config(spark, document, "any", lambda: NOW, checkpoint_root)
    assert again.relations["x"].edges.count() == 3
    seen = {(r["relation"], r["monitor"], r["name"]): r["value"] for r in schedule.Monitors(graph, light=lambda r: r.edges.agg(F.min("weight").alias("least"))).run().collect()}
    assert seen["x", "relation", "edge_count"] == 3 and seen["x", "length", "avg_len"] == 1.5 and seen["y", "nodes", "count"] == 0 and ("x", "light", "least") in seen
    schedule.upkeep_job(graph, "x", 86400)(NOW + 1)
    assert graph.relations["x"].edges.count() == 3


def test_eviction_of_ties(spark):
    nodes = spark.range(1, 1001).select("id", F.lit(1).cast("long").alias("degree"), (F.col("id") * 0 + 7).alias("expire_ts"))
    kept = maintain.evict_under_pressure(nodes, 0.95)
    assert kept.count() == 1000 - int(1000 * 0.05 / 0.95) and kept.count() == maintain.evict_under_pressure(nodes, 0.95, by="age").count()
    assert maintain.nth_smallest(nodes, F.col("id") * 1_000_000_007 - 5_000_000_000, 17) == (17 * 1_000_000_007 - 5_000_000_000, 16)
    assert maintain.nth_smallest(nodes, F.col("id"), 1001) is None and maintain.without_first(nodes, F.col("id"), 0).count() == 1000
    seq = nodes.select("id", "expire_ts", (-F.col("id")).alias("seq"))
    assert sorted(r["id"] for r in maintain.recycle(seq.limit(100), 5, 10).collect()) == list(range(1, 10))


def test_user_weights_and_formats(spark):
    nodes = spark.createDataFrame([(1, 3), (2, 5)], "id long, degree long")
    drawn = pools.random_nodes(nodes, 200, (F.col("degree") == 5).cast("double"))
    assert {r["id"] for r in drawn.collect()} == {2}
    one = spark.range(1).select(scalars.is_equal(F.lit(1.0), F.lit(1.000001)).alias("a"), scalars.is_less(F.lit(1.0), F.lit(1.000001)).alias("b"), scalars.is_less(F.lit(1.0), F.lit(1.1)).alias("c"), scalars.time_text(F.lit(0)).alias("d")).first()
    assert tuple(one) == (True, False, True, "[1970-01-01 00:00:00]")


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    with_setting = scratch.scratch_dir(spark)
    assert with_setting.startswith(spark.conf.get("spark.checkpoint.dir"))

    class Far:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError):
        scratch.scratch_dir(Far())


def test_eviction_guard(spark):
    nodes = spark.createDataFrame([(i, i, 0) for i in range(1, 101)], "id long, degree long, expire_ts long")
    assert maintain.evict_under_pressure(nodes, 0.5).count() == 100
    assert 90 <= maintain.evict_under_pressure(nodes, 1.0).count() <= 96


def test_config(spark):
    with pytest.raises(ValueError):
        RelationConfig("r", weight_decay_ratio=0)
    with pytest.raises(ValueError):
        RelationConfig("r", edge_max_num=70000)
    document = {"host_service_config": {"default": "a"}, "service_config": {"a": {"dbs": ["x"], "default_init": "l"}}, "db_list": [{"relation_name": "x"}], "init_list": [{"name": "l", "path": "/p"}]}
    assert resolve_config(document, "host")["dbs"][0]["init"][0]["path"] == "/p"


def test_store(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    rows = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, seq long")
    assert sorted(tuple(r) for r in store.put(base, rows).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert [r["id"] for r in store.erase_where(base, F.col("v") == "a").collect()] == [2]
    assert [r["id"] for r in store.erase_keys(base, rows).collect()] == [1]
    pool = store.PoolSnapshot(lambda: base.select("id", F.lit(1.0).alias("weight")), f"file://{tmp_path}/pool")
    with pytest.raises(RuntimeError):
        pool.draw(spark, 3)
    assert pool.refresh().draw(spark, 50).count() == 50
