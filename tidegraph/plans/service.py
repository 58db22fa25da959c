"""Registered queries of the service side: requests, storage, schedules and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.functions import scalars
from tidegraph.operators import lookup, stats, store, upsert
from tidegraph.plans.catalog import _NODES, _PURCHASES, T_HIGH, _customer_nodes, _draws, _first_pairs, query
from tidegraph.plans.graph import Graph, Relation
from tidegraph.schema import RelationConfig
from tidegraph.scratch import materialise, scratch_dir
from tidegraph.sources import checkpoint, tables, text
from tidegraph.streaming import ingest, schedule
from tidegraph.unions import union

_FIRST = f"{_PURCHASES}, f AS (SELECT src, dst, weight, seq * 10000000 + dst AS ts FROM raw QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY raw.seq, weight) = 1)"
_EXPIRING = f"{_PURCHASES}, n AS (SELECT src AS id, max(ts) + 86400000 AS expire_ts FROM e GROUP BY src)"


def _relation(spark, d, **cfg) -> Relation:
    """Purchases with the customers as nodes, whose life ends 1,000 days after their last purchase."""
    edges = tables.customer_part(spark, d)
    last = edges.groupBy(F.col("src").alias("id")).agg((F.max("ts") + 86400000).alias("last"))
    nodes = _customer_nodes(spark, d).join(last, "id", "left").withColumn("expire_ts", F.coalesce("last", F.lit(0)).cast("long")).drop("last")
    return Relation(spark, RelationConfig("C2P", int_attr_len=1, float_attr_len=1, **cfg), edges, nodes)


@query(f"WITH {_NODES}, own AS (SELECT ts, seq, dst, weight FROM e WHERE src = 8) SELECT 8::BIGINT AS id, (SELECT degree FROM nodes WHERE id = 8) AS degree, row_number() OVER (ORDER BY ts, seq, dst) - 1 AS place, dst, weight, ts FROM own")
def inspect_node(spark, d):
    """One node with its edges in the order of time."""
    node = _relation(spark, d).node(8)
    return node.select("id", "degree", F.posexplode("edges").alias("place", "e")).select("id", "degree", F.col("place").cast("long"), "e.dst", "e.weight", "e.ts")


@query(f"WITH {_FIRST} SELECT src, dst, weight, ts FROM f QUALIFY row_number() OVER (PARTITION BY src ORDER BY ts DESC) <= 7")
def migrate_layout(spark, d):
    """Edges inserted anew under a capacity of 7."""
    relation = Relation(spark, RelationConfig("C2P"), _first_pairs(spark, d))
    return checkpoint.migrate(relation.edges, relation.nodes, RelationConfig("C2P", edge_max_num=7))[0].select("src", "dst", "weight", "ts")


def _saved(spark, d) -> str:
    root, relation = scratch_dir(spark), _relation(spark, d)
    checkpoint.save(root, 1, {"C2P": (relation.edges, relation.nodes)}, T_HIGH + 90000000)
    return root


@query(f"WITH {_EXPIRING} SELECT e.src, e.dst, e.weight, e.ts FROM e JOIN n ON n.id = e.src WHERE expire_ts > {T_HIGH} + 90000000")
def checkpoint_load(spark, d):
    """What a checkpoint keeps: edges of live nodes."""
    return checkpoint.load(spark, _saved(spark, d), "C2P")[0].select("src", "dst", "weight", "ts")


@query(f"WITH {_EXPIRING} SELECT e.src, e.dst, e.weight, e.ts FROM e JOIN n ON n.id = e.src WHERE expire_ts > {T_HIGH} + 90000000 AND e.src % 3 = 1")
def checkpoint_shard(spark, d):
    """The sources of one of three shards."""
    return checkpoint.load(spark, _saved(spark, d), "C2P", shard=1, shards=3)[0].select("src", "dst", "weight", "ts")


@query("SELECT o AS old_shards, n AS new_shards, f AS file, s AS shard, f % gcd(o, n) = s % gcd(o, n) AS wanted FROM range(1, 13) a(o), range(1, 13) b(n), range(12) c(f), range(12) d(s) WHERE f < o AND s < n")
def shard_files(spark, d):
    """Files of an old layout that a shard of a new one reads."""
    rows = [(o, n, f, s, checkpoint.should_read(f, o, s, n)) for o in range(1, 13) for n in range(1, 13) for f in range(o) for s in range(n)]
    return spark.createDataFrame(rows, "old_shards long, new_shards long, file long, shard long, wanted boolean")


@query(f"WITH {_NODES} SELECT src, dst, weight FROM e UNION ALL SELECT id, 0, NULL FROM nodes WHERE degree = 0")
def text_load(spark, d):
    """A relation written as lines to a folder and loaded from it; nodes without edges are lines too."""
    edges = tables.customer_part(spark, d).withColumns({"int_attrs": F.array(F.lit(1).cast("long")), "float_attrs": F.array(F.lit(0.5).cast("float"))})
    path = f"{scratch_dir(spark)}/dt=20210526"
    text.format_lines(edges, _customer_nodes(spark, d)).write.text(path)
    return text.load_text(spark, path, 0, ts_from_path=True)[0].where("ts = 1621958400").select("src", "dst", "weight")


@query(f"WITH {_FIRST}, g AS (SELECT src, count(*) AS n FROM f GROUP BY src) SELECT src AS id, 20::BIGINT AS degree, 5::BIGINT AS edge_num FROM g WHERE n >= 20")
def fluent_insert(spark, d):
    """Customers of at least 20 parts, of whom 20 are inserted by the fluent interface in two batches; lists hold 5."""
    some = _first_pairs(spark, d).groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct("ts", "dst", "weight"))), 1, 20).alias("own")).where(F.size("own") == 20)
    graph = Graph(spark).add_relation(Relation(spark, RelationConfig("C2P", edge_max_num=5)))
    relation = graph.relations["C2P"]
    for low, high in ((0, 12), (12, 20)):
        batch = some.select("src", F.explode(F.slice("own", low + 1, high - low)).alias("e")).select("src", "e.dst", "e.weight", "e.ts", F.col("e.ts").alias("seq"))
        relation = relation.upsert(batch, T_HIGH)
    return relation.nodes.select("id", "degree", "edge_num")


@query(f"WITH {_PURCHASES} SELECT src AS id, greatest(max(ts), {T_HIGH}) + 86400 AS expire_ts FROM (SELECT src, arg_min(ts, seq) AS ts FROM (SELECT src, seq, max(ts) AS ts FROM raw GROUP BY src, seq) GROUP BY src UNION ALL SELECT DISTINCT src, 0 FROM raw) GROUP BY src")
def item_time_to_live(spark, d):
    """Nodes that live on from the time of the first row of a second batch, where that is later."""
    log = tables.purchases(spark, d).groupBy("src", "seq").agg(F.max("ts").alias("ts"), F.max("dst").alias("dst")).withColumn("weight", F.lit(1.0))
    first = Relation(spark, RelationConfig("C2P", edge_max_num=60000, expire_interval=86400)).upsert(log, T_HIGH)
    return first.upsert(log, T_HIGH - 1, use_item_ts=True).nodes.select("id", "expire_ts")


@query(f"WITH {_PURCHASES}, l AS (SELECT src, dst, arg_max(seq * 10000000 + dst, seq) AS mark FROM raw GROUP BY src, dst) SELECT src, dst, mark % 1000 AS i0 FROM l")
def edge_attr_update(spark, d):
    """Each edge's attributes are those of the last row that has some."""
    log = tables.purchases(spark, d).withColumn("mark", F.col("seq") * 10_000_000 + F.col("dst")).groupBy("src", "dst", "seq").agg(F.max("mark").alias("mark"))
    log = log.select("src", "dst", F.lit(1.0).alias("weight"), F.lit(0).cast("long").alias("ts"), "seq", F.array(F.col("mark") % 1000).alias("int_attrs"))
    edges = upsert.split_folded(upsert.fold(None, None, log, RelationConfig("C2P", edge_max_num=60000, edge_int_attr_len=1), "replace", T_HIGH))[0]
    return edges.select("src", "dst", F.col("int_attrs")[0].alias("i0"))


@query("SELECT o_custkey + 1 AS id, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 100 END, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey END) AS i0 FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 3 <> 0) > 0")
def node_attr_update(spark, d):
    """Each node's attributes are those of the last row that has some; rows with neither edge nor attributes make no node."""
    orders = tables.table(spark, d, "orders")
    block = F.when(F.col("o_orderkey") % 3 != 0, F.array(F.col("o_orderkey") % 100))
    log = orders.select((F.col("o_custkey") + 1).alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(1.0).alias("weight"), F.lit(0).cast("long").alias("ts"), F.col("o_orderkey").alias("seq"), block.alias("node_ints"))
    nodes = upsert.split_folded(upsert.fold(None, None, log, RelationConfig("C2P", int_attr_len=1), "replace", T_HIGH))[1]
    return nodes.select("id", F.col("int_attrs")[0].alias("i0"))


@query(_draws("degree::DOUBLE", 500))
def pool_snapshot(spark, d):
    """Draws from a stored state of a pool."""
    pool = store.PoolSnapshot(lambda: _customer_nodes(spark, d).select("id", F.col("degree").cast("double").alias("weight")), scratch_dir(spark))
    return pool.refresh().draw(spark, 500)


@query(f"WITH {_PURCHASES} SELECT src, count(*) AS n, count(DISTINCT dst) AS d, count(*) FILTER (weight <= 0) AS bad FROM raw GROUP BY src HAVING count(*) <> count(DISTINCT dst) OR count(*) > 20")
def broken_lists(spark, d):
    """Sources of the raw log whose rows are no valid list: a pair twice, or more than 20 edges."""
    return stats.broken_edges(tables.purchases(spark, d), 20)


@query(f"WITH {_PURCHASES} SELECT 'C2P' AS relation, 'relation' AS monitor, 'edge_count' AS name, count(*)::DOUBLE AS value FROM e UNION ALL SELECT 'C2P', 'length', 'avg_len', count(*) / count(DISTINCT src)::DOUBLE FROM e UNION ALL SELECT 'C2P', 'heavy', 'n', count(*) FILTER (weight > 40)::DOUBLE FROM e")
def monitors(spark, d):
    """Standard monitors and one of the user's own."""
    graph = Graph(spark).add_relation(Relation(spark, RelationConfig("C2P"), materialise(tables.customer_part(spark, d))))
    seen = schedule.Monitors(graph, heavy=lambda r: r.edges.where("weight > 40").agg(F.count("*").alias("n"))).run()
    return seen.where("name in ('edge_count', 'avg_len') or monitor = 'heavy'")


@query(f"WITH {_EXPIRING} SELECT e.src, e.dst, e.weight * 0.5 AS weight FROM e JOIN n ON n.id = e.src WHERE expire_ts > {T_HIGH} + 90000000 AND e.weight * 0.5 >= 4")
def scheduled_upkeep(spark, d):
    """A day's job: expired nodes go, weights are halved, light edges go."""
    graph = Graph(spark).add_relation(_relation(spark, d, weight_decay_ratio=0.5, delete_threshold_weight=4.0))
    now = T_HIGH + 90000000
    jobs = schedule.Scheduler().every(86400, "upkeep", schedule.upkeep_job(graph, "C2P", 86400))
    jobs.tick(now - now % 86400 - 1)
    if jobs.tick(now) != ["upkeep"]:
        raise RuntimeError("the job did not run")
    return graph.relations["C2P"].edges.select("src", "dst", "weight")


@query(
    "SELECT user_id + 1 AS src, event_id % 40 + 1 AS dst, 7::BIGINT AS ts, count(*)::DOUBLE AS weight FROM events GROUP BY ALL"
)
def stream_ingest(spark, d):
    """Events of one time folded into a relation as a stream, batch by batch; files may come in any order."""
    events = tables.table(spark, d, "events")
    log = events.select((F.col("user_id") + 1).alias("src"), (F.col("event_id") % 40 + 1).alias("dst"), F.lit(1.0).alias("weight"), F.lit(7).cast("long").alias("ts"), F.col("event_id").alias("seq"))
    where = scratch_dir(spark)
    parts = materialise(log.repartitionByRange(2, "seq"), "log", where)
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/log")
    sink = ingest.TableSink(Relation(spark, RelationConfig("U2T", edge_max_num=1000)), f"{where}/table", lambda _: T_HIGH, "add", buckets=8)
    running = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{where}/stream").trigger(availableNow=True).start()
    running.awaitTermination()
    return sink.current().edges.select("src", "dst", F.col("ts"), "weight")


@query("SELECT c_custkey + 1 AS id, ((c_nationkey <> 0)::INT + (abs(c_acctbal) > 0.00001)::INT) / 4.0::DOUBLE AS used, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 0 END AS at, abs(c_acctbal - round(c_acctbal)) < 0.00001 AS whole, c_acctbal - 100 < -0.00001 AS below, strftime(to_timestamp(c_custkey * 100000)::TIMESTAMP, '[%Y-%m-%d %H:%M:%S]') AS t FROM customer")
def scalar_kit(spark, d):
    """Shares of attributes in use, elements, comparisons within a tolerance, and times as text."""
    c = tables.table(spark, d, "customer")
    block = F.array(F.col("c_nationkey").cast("double"), F.lit(0.0), F.col("c_acctbal"), F.lit(0.0))
    at = scalars.attr_at(scalars.set_attr(F.array(F.lit(0), F.lit(0)), 1, F.col("c_nationkey")), 1)
    return c.select(
        (F.col("c_custkey") + 1).alias("id"), scalars.used_ratio(block).alias("used"), F.when(F.col("c_custkey") % 2 == 0, at).otherwise(scalars.attr_at(F.array(F.lit(1)), 7)).alias("at"),
        scalars.is_equal(F.col("c_acctbal"), F.round("c_acctbal")).alias("whole"), scalars.is_less(F.col("c_acctbal"), F.lit(100.0)).alias("below"),
        F.date_format(F.timestamp_seconds(F.col("c_custkey") * 100000), "'['yyyy-MM-dd HH:mm:ss']'").alias("t"),
    )


@query("SELECT event_id, 'u' || user_id AS u, event_type AS e FROM events")
def url_parameters(spark, d):
    """Parameters of query strings."""
    events = tables.table(spark, d, "events")
    found = scalars.query_parameters(F.concat(F.lit("u=u"), F.col("user_id").cast("string"), F.lit("&e="), F.col("event_type")))
    return events.select("event_id", found["u"].alias("u"), found["e"].alias("e"))


@query(f"WITH {_PURCHASES} SELECT src AS id, page FROM (SELECT src, row_number() OVER () AS page FROM (SELECT DISTINCT src FROM e)) WHERE FALSE UNION ALL SELECT DISTINCT src, {1}::BIGINT FROM e")
def node_cursor(spark, d):
    """Every node that a cursor over parts gives, and how often."""
    pages = lookup.NodePages(tables.customer_part(spark, d).select(F.col("src").alias("id")), part_size=64)
    out = None
    for _ in range(pages.parts):
        page = pages.next()
        out = page if out is None else union(out, page)
    return out.groupBy("id").agg(F.count("*").alias("page"))


@query("SELECT c_custkey + 1 AS id, 'kept' AS what FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT 0, 'cleared: 0'")
def clear_relation(spark, d):
    """A relation without the rows of some keys, and the number of rows of a cleared one."""
    relation = _relation(spark, d)
    even = tables.table(spark, d, "customer").where("c_custkey % 2 = 0").select((F.col("c_custkey") + 1).alias("id"))
    kept = store.erase_keys(relation.nodes, even).select("id", F.lit("kept").alias("what"))
    return union(kept, relation.clear().edges.agg(F.lit(0).cast("long").alias("id"), F.concat(F.lit("cleared: "), F.count("*").cast("string")).alias("what")))


@query(f"WITH {_EXPIRING} SELECT e.src, e.dst, e.weight FROM e JOIN n ON n.id = e.src WHERE e.ts + 20000000 >= {T_HIGH} AND n.expire_ts > {T_HIGH}")
def relation_expire(spark, d):
    """Edges past their own life go, then nodes past theirs and those without edges, with what they have."""
    return _relation(spark, d, edge_expire_interval_s=20000000).expire(T_HIGH).edges.select("src", "dst", "weight")


@query(f"WITH {_NODES} SELECT id, degree FROM nodes QUALIFY row_number() OVER (ORDER BY degree DESC, ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 12))::BIGINT DESC) <= count(*) OVER () - floor(count(*) OVER () * (0.05 / (count(*) OVER () / floor(count(*) OVER () * 1.05::DOUBLE))))")
def relation_evict(spark, d):
    """Nodes at more than 0.9 of a capacity."""
    relation = _relation(spark, d)
    return relation.evict(int(relation.nodes.count() * 1.05)).nodes.select("id", "degree")
