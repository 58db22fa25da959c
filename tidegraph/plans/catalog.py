"""Registered graph queries and their SQL oracles.

Relations are those of tidegraph.sources.tables. Every query works on whole tables; limits
stand only where they are the feature (fanouts, capacities, batch sizes).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions import scalars
from tidegraph.operators import lookup, maintain, pools, stats, store, upsert
from tidegraph.operators.sampling import as_of, next_seeds, sample_neighbors
from tidegraph.plans.graph import Graph, Relation
from tidegraph.schema import RelationConfig
from tidegraph.sources import tables, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Times used by the queries: early 1996, and a range inside 1994 to 1997, in seconds.
T_MAX, T_LOW, T_HIGH = 820454400, 760000000, 860000000

_PURCHASES = """
raw AS (SELECT o_custkey + 1 AS src, l_partkey + 1 AS dst, l_quantity AS weight,
               CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts, l_orderkey * 10 + l_linenumber AS seq
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY ts DESC, seq DESC, weight DESC) = 1),
seeds AS (SELECT c_custkey AS seed_pos, c_custkey + 1 AS id FROM customer)"""

_EVENTS = """
u AS (SELECT user_id + 1 AS src, CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 0 END AS BIGINT) AS dst,
             value AS weight, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq FROM events)"""


def _h(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 12) AS BIGINT)"


def _u(*parts: str) -> str:
    return f"(({_h(*parts)} + 1) / 281474976710657.0::DOUBLE)"


def _padded(ranked: str, fanout: int, padding: str, seeds: str = "seeds", extra: str = "") -> str:
    """SQL of `fanout` slots a seed from ranked rows (seed_pos, rank from 1, dst, ts, weight)."""
    loop = padding == "neigh_loop"
    match = "((s.draw % greatest(coalesce(c.n, 0), 1)) + 1)" if loop else "(s.draw + 1)"
    empty = "s.id" if padding in ("self", "neigh_loop") else "0"
    return f"""
WITH {extra}{ranked},
cnt AS (SELECT seed_pos, count(*) AS n FROM k GROUP BY seed_pos),
s AS (SELECT seed_pos, id, unnest(range({fanout})) AS draw FROM {seeds})
SELECT s.seed_pos, s.id AS src, CAST(s.draw AS INTEGER) AS draw, coalesce(k.dst, {empty}) AS dst, coalesce(k.ts, 0) AS ts,
       coalesce(k.weight, 0.0) AS weight, (s.draw >= coalesce(c.n, 0)) AS padded
FROM s LEFT JOIN cnt c USING (seed_pos) LEFT JOIN k ON k.seed_pos = s.seed_pos AND k.rank = {match}"""


def _rank(order: str, n: int, where: str = "TRUE", edges: str = "e", seeds: str = "seeds", name: str = "k") -> str:
    return f"{name} AS (SELECT seed_pos, dst, ts, weight, row_number() OVER (PARTITION BY seed_pos ORDER BY {order}) AS rank FROM {seeds} JOIN {edges} ON {seeds}.id = {edges}.src WHERE {where} QUALIFY rank <= {n})"


_NUMBERED = """
m AS (SELECT src, dst, ts, weight, row_number() OVER w AS place, count(*) OVER (PARTITION BY src) AS n,
             sum(weight) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, sum(weight) OVER (PARTITION BY src) AS total
      FROM e WINDOW w AS (PARTITION BY src ORDER BY dst, seq)),
t AS (SELECT DISTINCT src, n, total FROM m)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sample(strategy: str, fanout: int, padding: str = "self", **options):
    return lambda spark, d: sample_neighbors(tables.customer_seeds(spark, d), tables.customer_part(spark, d), strategy, fanout, padding, **options)


def register(name: str, f: Callable, sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


_HEAD = _PURCHASES.lstrip() + ",\n"
_RECENT, _LEAST, _TOP = "ts DESC, seq DESC, dst", "ts, seq, dst", "weight DESC, dst, seq"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most recent parts of twenty customers up to T_MAX."""
    seeds = tables.customer_seeds(spark, sf_dir).where("seed_pos < 20")
    return sample_neighbors(seeds, tables.customer_part(spark, sf_dir), "most_recent", 3, "self", max_ts=T_MAX)


register("nbr_most_recent", _sample("most_recent", 3, max_ts=T_MAX), _padded(_rank(_RECENT, 3, f"ts <= {T_MAX}"), 3, "self", extra=_HEAD))
register("nbr_least_recent", _sample("least_recent", 5, min_ts=T_LOW), _padded(_rank(_LEAST, 5, f"ts >= {T_LOW}"), 5, "self", extra=_HEAD))
register("nbr_topn_weight", _sample("topn_weight", 5), _padded(_rank(_TOP, 5), 5, "self", extra=_HEAD))
register("nbr_time_range", _sample("most_recent", 4, "zero", min_ts=T_LOW, max_ts=T_HIGH), _padded(_rank(_RECENT, 4, f"ts BETWEEN {T_LOW} AND {T_HIGH}"), 4, "zero", extra=_HEAD))
register("nbr_min_weight", _sample("least_recent", 4, "zero", min_weight=25.0), _padded(_rank(_LEAST, 4, "weight >= 25"), 4, "zero", extra=_HEAD))
register("nbr_random_wor", _sample("random", 3, "zero", without_replacement=True), _padded(_rank(f"{_h('src', 'dst', '1', 'seed_pos')}, dst, seq", 3), 3, "zero", extra=_HEAD))
register("nbr_weight_wor", _sample("weight", 3, "zero", without_replacement=True), _padded(_rank(f"-ln({_u('src', 'dst', '1', 'seed_pos')}) / weight, dst, seq", 3), 3, "zero", extra=_HEAD))
register(
    "nbr_random_wr", _sample("random", 4),
    _padded(
        f"""{_NUMBERED.lstrip()},
d AS (SELECT seed_pos, id, n, unnest(range(4)) AS draw FROM seeds JOIN t ON t.src = seeds.id),
k AS (SELECT d.seed_pos, dst, ts, weight, draw + 1 AS rank FROM d JOIN m ON m.src = d.id AND m.place = least(floor({_u('d.seed_pos', 'd.id', '1', 'd.draw')} * d.n) + 1, d.n))""",
        4, "self", extra=_HEAD,
    ),
)
register(
    "nbr_weight_wr", _sample("weight", 4),
    _padded(
        f"""{_NUMBERED.lstrip()},
d0 AS (SELECT seed_pos, id, total, unnest(range(4)) AS draw FROM seeds JOIN t ON t.src = seeds.id),
d AS (SELECT seed_pos, id, draw, {_u('seed_pos', 'id', '1', 'draw')} * total AS mark FROM d0),
k AS (SELECT d.seed_pos, dst, ts, weight, draw + 1 AS rank FROM d JOIN m ON m.src = d.id AND d.mark > m.upto - m.weight AND d.mark <= m.upto)""",
        4, "self", extra=_HEAD,
    ),
)
for _name, _padding in (("pad_zero", "zero"), ("pad_self", "self"), ("pad_loop", "neigh_loop"), ("pad_none", "no_padding")):
    register(_name, _sample("most_recent", 50, _padding, min_ts=T_HIGH), _padded(_rank(_RECENT, 50, f"ts >= {T_HIGH}"), 50, _padding, extra=_HEAD))
register("drop_padding", _sample("most_recent", 8, min_ts=T_HIGH, drop_padding=True), _padded(_rank(_RECENT, 8, f"ts >= {T_HIGH}"), 8, "zero", extra=_HEAD) + " WHERE s.draw < coalesce(c.n, 0)")


@query(f"WITH {_PURCHASES} SELECT src, dst, ts, weight FROM e WHERE ts <= {T_MAX} QUALIFY row_number() OVER (PARTITION BY src ORDER BY ts DESC, seq DESC, dst DESC) = 1")
def asof_latest(spark, d):
    return as_of(tables.customer_part(spark, d), T_MAX)


_HOP1 = _padded(_rank(_RECENT, 2), 2, "zero", extra=_HEAD).strip()


@query(
    f"""WITH one AS ({_HOP1}), {_PURCHASES}, b AS (SELECT dst AS src, src AS dst, weight, ts, seq FROM e),
seeds2 AS (SELECT seed_pos * 2 + draw AS seed_pos, dst AS id FROM one),
{_rank(_TOP, 3, edges='b', seeds='seeds2')},
cnt AS (SELECT seed_pos, count(*) AS n FROM k GROUP BY seed_pos),
s AS (SELECT seed_pos, id, unnest(range(3)) AS draw FROM seeds2)
SELECT s.seed_pos, s.id AS src, CAST(s.draw AS INTEGER) AS draw, coalesce(k.dst, s.id) AS dst, coalesce(k.ts, 0) AS ts, coalesce(k.weight, 0.0) AS weight, s.draw >= coalesce(c.n, 0) AS padded
FROM s LEFT JOIN cnt c USING (seed_pos) LEFT JOIN k ON k.seed_pos = s.seed_pos AND k.rank = s.draw + 1"""
)
def two_hop(spark, d):
    """Customers to recent parts, and those to the customers who bought most."""
    forward = tables.customer_part(spark, d)
    one = sample_neighbors(tables.customer_seeds(spark, d), forward, "most_recent", 2, "zero")
    return sample_neighbors(next_seeds(one, 2), lookup.reverse(forward), "topn_weight", 3, "self")


@query(
    f"""WITH one AS ({_HOP1}), {_PURCHASES}, b AS (SELECT dst AS src, src AS dst, weight, ts, seq FROM e),
p AS (SELECT l_partkey + 1 AS src, l_suppkey + 1 AS dst, l_quantity AS weight, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts, l_orderkey * 10 + l_linenumber AS seq FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY CAST(floor(epoch(l_shipdate)) AS BIGINT) DESC, l_orderkey * 10 + l_linenumber DESC, l_quantity DESC) = 1),
seeds2 AS (SELECT seed_pos * 2 + draw AS seed_pos, dst AS id FROM one),
{_rank(_LEAST, 2, edges='b', seeds='seeds2', name='k2')},
s2 AS (SELECT seed_pos, id, unnest(range(2)) AS draw FROM seeds2),
two AS (SELECT s2.seed_pos, s2.draw, coalesce(k2.dst, 0) AS dst FROM s2 LEFT JOIN k2 ON k2.seed_pos = s2.seed_pos AND k2.rank = s2.draw + 1),
back AS (SELECT two.seed_pos * 2 + two.draw AS seed_pos, two.dst AS id FROM two),
{_rank(_RECENT, 2, edges='e', seeds='back', name='k3')},
s3 AS (SELECT seed_pos, id, unnest(range(2)) AS draw FROM back),
parts AS (SELECT s3.seed_pos * 2 + s3.draw AS seed_pos, coalesce(k3.dst, 0) AS id FROM s3 LEFT JOIN k3 ON k3.seed_pos = s3.seed_pos AND k3.rank = s3.draw + 1),
{_rank(_TOP, 1, edges='p', seeds='parts', name='k4')}
SELECT parts.seed_pos, parts.id AS src, 0 AS draw, coalesce(k4.dst, 0) AS dst, coalesce(k4.ts, 0) AS ts, coalesce(k4.weight, 0.0) AS weight, k4.dst IS NULL AS padded
FROM parts LEFT JOIN k4 USING (seed_pos)"""
)
def three_hop_hetero(spark, d):
    """A chain over three relations by the fluent API: customer, part, customer, part, supplier."""
    graph, forward = Graph(spark), tables.customer_part(spark, d)
    for name, edges in (("C2P", forward), ("P2C", lookup.reverse(forward)), ("P2S", tables.part_supplier(spark, d))):
        graph.add_relation(Relation(spark, RelationConfig(name), edges))
    chain = graph.set_nodes("C2P", tables.customer_seeds(spark, d), "seed")
    chain.sample_neighbor("C2P", "a").sample(2).by("most_recent", "zero").sample_neighbor("P2C", "b").sample(2).by("least_recent", "zero")
    chain.sample_neighbor("C2P", "c").sample(2).by("most_recent", "zero").sample_neighbor("P2S", "d").sample(1).by("topn_weight", "zero")
    return chain.emit()["d"]


def _customer_nodes(spark, d) -> DataFrame:
    counts = stats.node_counts(tables.customer_part(spark, d)).drop("total_weight")
    nodes = tables.customers(spark, d).join(counts, "id", "left")
    return nodes.select("id", F.coalesce("edge_num", F.lit(0)).alias("degree"), F.coalesce("edge_num", F.lit(0)).alias("edge_num"), F.lit(0).cast("long").alias("expire_ts"), "int_attrs", "float_attrs")


_NODES = f"{_PURCHASES}, cn AS (SELECT src, count(*) AS n FROM e GROUP BY src), nodes AS (SELECT c_custkey + 1 AS id, coalesce(n, 0) AS degree, c_nationkey AS nation, CAST(c_acctbal AS FLOAT) AS bal FROM customer LEFT JOIN cn ON src = c_custkey + 1)"


@query(
    f"""WITH {_NODES}, q AS (SELECT o_orderkey AS seed_pos, o_custkey + o_orderkey % 3 * 1000000 + 1 AS id FROM orders)
SELECT q.seed_pos, q.id, nodes.id IS NOT NULL AS attr_exist, coalesce(degree, 0) AS degree, coalesce(nation, 0)::BIGINT AS i0, 0::BIGINT AS i1, coalesce(bal, 0)::DOUBLE AS f0
FROM q LEFT JOIN nodes ON q.id = nodes.id"""
)
def node_attrs(spark, d):
    orders = tables.table(spark, d, "orders")
    ids = orders.select(F.col("o_orderkey").alias("seed_pos"), (F.col("o_custkey") + F.col("o_orderkey") % 3 * 1000000 + 1).alias("id"))
    out = lookup.node_attrs(ids, _customer_nodes(spark, d), 2, 1)
    return out.select("seed_pos", "id", "attr_exist", "degree", F.col("int_attrs")[0].alias("i0"), F.col("int_attrs")[1].alias("i1"), F.col("float_attrs")[0].cast("double").alias("f0"))


@query(
    f"""WITH {_PURCHASES}, q AS (SELECT l_orderkey * 10 + l_linenumber AS pos, o_custkey + 1 AS src, l_partkey + 1 + l_linenumber % 2 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT q.pos, q.src, CASE WHEN e.weight IS NULL THEN 0 ELSE q.dst END AS dst, coalesce(e.weight, 0) AS weight, coalesce(e.ts, 0) AS ts, e.weight IS NOT NULL AS found FROM q LEFT JOIN e ON e.src = q.src AND e.dst = q.dst"""
)
def edge_lookup(spark, d):
    pairs = tables.purchases(spark, d).select(F.col("seq").alias("pos"), "src", (F.col("dst") + F.col("seq") % 10 % 2).alias("dst"))
    return lookup.edge_lookup(pairs, tables.customer_part(spark, d))


@query(f"WITH {_PURCHASES} SELECT src, dst, weight, ts FROM e WHERE src IN (SELECT c_custkey + 1 FROM customer WHERE c_nationkey = 3)")
def edge_all(spark, d):
    ids = tables.table(spark, d, "customer").where("c_nationkey = 3").select((F.col("c_custkey") + 1).alias("id"))
    return lookup.edges_of(tables.customer_part(spark, d), ids)


def _dying(spark, d) -> DataFrame:
    """Customers as nodes of which a third is expired at T_HIGH, some to the second."""
    shift = F.when(F.col("id") % 3 == 0, F.col("id") % 2).otherwise(-(F.col("id") % 5))
    return _customer_nodes(spark, d).withColumn("expire_ts", F.when(F.col("id") % 4 == 0, 0).otherwise(T_HIGH - shift).cast("long"))


_DYING = f"{_NODES}, dying AS (SELECT id, degree, CASE WHEN id % 4 = 0 THEN 0 WHEN id % 3 = 0 THEN {T_HIGH} - id % 2 ELSE {T_HIGH} + id % 5 END AS expire_ts FROM nodes), alive AS (SELECT * FROM dying WHERE expire_ts = 0 OR expire_ts > {T_HIGH})"


def _nbr_live(spark, d):
    """Samples of expired sources are padded; each slot carries its source's degree."""
    nodes = _dying(spark, d)
    layer = sample_neighbors(tables.customer_seeds(spark, d), tables.customer_part(spark, d), "most_recent", 3, nodes=nodes, now=T_HIGH)
    return lookup.with_degree(layer, nodes, T_HIGH)


register(
    "nbr_live", _nbr_live,
    f"SELECT q.*, coalesce(alive.degree, 0)::BIGINT AS degree FROM ({_padded(_rank(_RECENT, 3, 'src IN (SELECT id FROM alive)'), 3, 'self', extra=_DYING.strip() + ',' + chr(10))}) q LEFT JOIN (WITH {_DYING.strip()} SELECT * FROM alive) alive ON alive.id = q.src",
)


@query(
    f"""WITH {_DYING}, q AS (SELECT l_orderkey * 10 + l_linenumber AS pos, o_custkey + 1 AS src, l_partkey + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT q.pos, q.src, CASE WHEN g.weight IS NULL THEN 0 ELSE q.dst END AS dst, coalesce(g.weight, 0) AS weight, coalesce(g.ts, 0) AS ts, g.weight IS NOT NULL AS found
FROM q LEFT JOIN (SELECT e.* FROM e WHERE src NOT IN (SELECT id FROM dying WHERE id NOT IN (SELECT id FROM alive))) g ON g.src = q.src AND g.dst = q.dst"""
)
def edge_live(spark, d):
    """Edges of expired sources are missed."""
    pairs = tables.purchases(spark, d).select(F.col("seq").alias("pos"), "src", "dst")
    return lookup.edge_lookup(pairs, tables.customer_part(spark, d), _dying(spark, d), T_HIGH)


@query(f"WITH {_DYING}, q AS (SELECT o_orderkey AS pos, o_custkey + o_orderkey % 3 * 1000000 + 1 AS id FROM orders) SELECT pos, q.id, coalesce(expire_ts, 0)::BIGINT AS expire_ts, coalesce(degree, 0)::BIGINT AS degree, coalesce(degree, 0)::BIGINT AS edge_num FROM q LEFT JOIN alive ON alive.id = q.id")
def node_getters(spark, d):
    """Expiry, degree and list length of nodes; 0 for missing and expired ones."""
    ids = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") + F.col("o_orderkey") % 3 * 1000000 + 1).alias("id"))
    return lookup.node_getters(ids, _dying(spark, d), T_HIGH)


@query(f"WITH {_NODES} SELECT (SELECT count(*) FROM nodes) AS keys, (SELECT count(*) FROM nodes) * 24 + (SELECT count(*) FROM e) * 26 AS bytes, floor((SELECT count(*) FROM nodes) * 10000 / 100000)::BIGINT AS key_usage, floor(((SELECT count(*) FROM nodes) * 24 + (SELECT count(*) FROM e) * 26) * 10000 / 100000000)::BIGINT AS byte_usage")
def memory_usage(spark, d):
    """Keys and bytes in use, and their shares of a limit of 100,000 keys and 100 MB."""
    return stats.usage(_customer_nodes(spark, d), tables.customer_part(spark, d), 100_000, 100_000_000, attr_values=2)


@query("""SELECT c_custkey + 1 AS id, coalesce(o.n, 0) + c_nationkey AS v FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey
WHERE coalesce(o.n, 0) < 12 UNION ALL SELECT o_custkey + 1, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey HAVING count(*) < 12""")
def merge_rows(spark, d):
    """A user's function merges each customer's orders into its row, and erases customers of twelve orders and more."""
    base = tables.table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("id"), F.col("c_nationkey").cast("long").alias("v"))
    rows = tables.table(spark, d, "orders").select((F.col("o_custkey") + 1).alias("id"))

    def update(stored, payload):
        out = stored if len(stored) else payload[["id"]].head(1).assign(v=0)
        return out.assign(v=out["v"] + len(payload)) if len(payload) < 12 else out.head(0)

    return store.merge(base, rows, update)


@query(f"WITH {_PURCHASES} SELECT src AS id, count(*) AS degree FROM raw GROUP BY src")
def node_degree(spark, d):
    """Lifetime degree: every accepted insert counts."""
    return upsert.valid_edges(tables.purchases(spark, d)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


@query(f"WITH {_PURCHASES} SELECT src AS id, count(*) AS edge_num, sum(weight) AS total_weight FROM e GROUP BY src")
def total_weight(spark, d):
    return stats.node_counts(tables.customer_part(spark, d))


@query(f"WITH {_PURCHASES} SELECT count(DISTINCT src) AS node_count, count(*) AS edge_count, sum(weight) AS total_weight, min(ts) AS oldest, max(ts) AS newest FROM e")
def relation_stats(spark, d):
    return stats.relation_stats(tables.customer_part(spark, d))


@query(f"WITH {_PURCHASES} SELECT DISTINCT src AS id FROM e WHERE {_h('src')} % 7 = 3")
def traverse_part(spark, d):
    return lookup.traverse_part(tables.customer_part(spark, d).select(F.col("src").alias("id")), 7, 3)


@query(f"WITH {_PURCHASES} SELECT id, place FROM (SELECT src AS id, row_number() OVER (ORDER BY src) - 1 AS place FROM (SELECT DISTINCT src FROM e)) WHERE place BETWEEN 100 AND 199")
def iter_page(spark, d):
    return lookup.exact_page(tables.customer_part(spark, d).select(F.col("src").alias("id")), 100, 1)


def _draws(weight: str, n: int, keep: str = "TRUE") -> str:
    return f"""WITH {_NODES}, pool AS (SELECT id, {weight} AS w FROM nodes WHERE {keep}),
run AS (SELECT id, w, sum(w) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER () AS total FROM pool WHERE w > 0),
d AS (SELECT unnest(range({n})) AS draw), x AS (SELECT draw, {_u('draw', '1')} * (SELECT max(total) FROM run) AS mark FROM d)
SELECT draw, id FROM x JOIN run ON mark > upto - w AND mark <= upto"""


@query(_draws("1.0::DOUBLE", 1000))
def random_nodes(spark, d):
    return pools.random_nodes(_customer_nodes(spark, d), 1000)


@query(_draws("degree::DOUBLE", 1000))
def random_nodes_degree(spark, d):
    return pools.random_nodes(_customer_nodes(spark, d), 1000, "degree")


@query(_draws("pow(nation, 2.0)::DOUBLE", 1000, "degree BETWEEN 5 AND 10000"))
def pool_custom(spark, d):
    """Nodes of 5 to 10,000 edges by the square of an attribute."""
    return pools.random_nodes(_customer_nodes(spark, d), 1000, "int_attr", pools.pool_filter(degree=(5, 10000)), index=0, transform="power", exponent=2.0)


def _arrivals(merge: str, rows: str = "raw") -> str:
    """SQL that walks each pair's rows in the order of arrival; merge gives the weight from a (stored) and x (new)."""
    return f"""SELECT src, dst, f.w AS weight, f.t AS ts FROM (
SELECT src, dst, list_reduce(list({{'w': weight, 't': ts}} ORDER BY seq, ts, weight), lambda a, x: CASE WHEN x.t < a.t THEN a ELSE {{'w': {merge}, 't': x.t}} END) AS f FROM {rows} GROUP BY src, dst)"""


@query(f"WITH {_PURCHASES} {_arrivals('a.w + x.w')}")
def upsert_add(spark, d):
    """Rows arrive by order number; a ship date before one already stored makes a row late."""
    return upsert.combine(tables.purchases(spark, d), "add").drop("seq")


@query(f"WITH {_PURCHASES} SELECT src, dst, weight, ts FROM e")
def upsert_replace(spark, d):
    return upsert.combine(tables.purchases(spark, d), "replace").drop("seq")


@query(f"WITH {_PURCHASES} {_arrivals('greatest(a.w, x.w)')}")
def upsert_max(spark, d):
    return upsert.combine(tables.purchases(spark, d), "max").drop("seq")


@query(f"WITH {_PURCHASES} {_arrivals('(a.w + x.w) / 2')}")
def upsert_avg(spark, d):
    return upsert.combine(tables.purchases(spark, d), "avg").drop("seq")


def _odd_log(spark, d) -> DataFrame:
    """Purchases by ten parts, in which some destinations are 0 and some weights out of bounds; many rows are late."""
    return tables.purchases(spark, d).select(
        "src", F.when(F.col("seq") % 11 == 0, 0).otherwise(F.col("dst") % 10 + 1).cast("long").alias("dst"),
        (F.col("weight") * F.when(F.col("seq") % 13 == 0, 1000).otherwise(1)).alias("weight"), "ts", (F.col("seq") * 10_000_000 + F.col("dst")).alias("seq"),
    )


@query(
    f"""WITH {_PURCHASES}, o AS (SELECT src, CASE WHEN seq % 11 = 0 THEN 0 ELSE dst % 10 + 1 END AS dst, weight * CASE WHEN seq % 13 = 0 THEN 1000 ELSE 1 END AS weight, ts, seq * 10000000 + dst AS seq FROM raw),
v AS (SELECT * FROM o WHERE dst <> 0 AND weight < 1000)
{_arrivals('a.w + x.w', 'v')}"""
)
def upsert_late(spark, d):
    """Invalid rows and late ones change nothing."""
    return upsert.combine(_odd_log(spark, d), "add").drop("seq")


@query(
    f"""WITH {_PURCHASES}, o AS (SELECT src, CASE WHEN seq % 11 = 0 THEN 0 ELSE dst % 10 + 1 END AS dst, weight * CASE WHEN seq % 13 = 0 THEN 1000 ELSE 1 END AS weight, ts, seq * 10000000 + dst AS seq FROM raw),
v AS (SELECT * FROM o WHERE dst <> 0 AND weight < 1000)
{_arrivals('a.w + x.w', 'v')}"""
)
def fold_late(spark, d):
    """The same rows folded one by one."""
    folded = upsert.fold(None, None, _odd_log(spark, d), RelationConfig("C2P"), "add", T_HIGH)
    return upsert.split_folded(folded)[0].select("src", "dst", "weight", "ts")


def _fold(spark, d, cfg: RelationConfig, action: str = "replace") -> tuple[DataFrame, DataFrame]:
    log = tables.purchases(spark, d)
    return upsert.split_folded(upsert.fold(None, None, log, cfg, action, now=T_HIGH))


_DISTINCT = f"WITH {_PURCHASES}, f AS (SELECT src, dst, weight, seq * 10000000 + dst AS ts, seq * 10000000 + dst AS seq FROM raw QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY raw.seq, weight) = 1)"


def _first_pairs(spark, d) -> DataFrame:
    first = tables.purchases(spark, d).groupBy("src", "dst").agg(F.min(F.struct("seq", "weight")).alias("e"))
    at = F.col("e.seq") * 10_000_000 + F.col("dst")  # lines of an order may share a number; these times are distinct
    return first.select("src", "dst", "e.weight", at.alias("ts"), at.alias("seq"))


@query(f"{_DISTINCT} SELECT src, dst, weight, ts FROM f QUALIFY row_number() OVER (PARTITION BY src ORDER BY ts DESC) <= 10")
def cap_lru(spark, d):
    """The fold with a capacity of 10 that evicts the oldest."""
    folded = upsert.fold(None, None, _first_pairs(spark, d), RelationConfig("C2P", edge_max_num=10), "replace", T_HIGH)
    return upsert.split_folded(folded)[0].select("src", "dst", "weight", "ts")


@query(f"{_DISTINCT} SELECT src, dst, weight, ts FROM f QUALIFY row_number() OVER (PARTITION BY src ORDER BY seq) <= 10")
def cap_cancel(spark, d):
    folded = upsert.fold(None, None, _first_pairs(spark, d), RelationConfig("C2P", edge_max_num=10, eviction="cancel"), "replace", T_HIGH)
    return upsert.split_folded(folded)[0].select("src", "dst", "weight", "ts")


def _walk(room: str, fields: str, merge: str) -> str:
    """SQL that folds each source's rows one by one into a list of at most 10; room makes the tenth free."""
    return f"""WITH RECURSIVE {_PURCHASES},
o AS (SELECT src, dst, weight, ts, row_number() OVER (PARTITION BY src ORDER BY seq, dst, ts, weight) AS i FROM raw),
f(src, i, l) AS (
  SELECT DISTINCT src, 0::BIGINT, []::STRUCT({fields})[] FROM o
  UNION ALL
  SELECT src, i, list_concat(list_filter(m, lambda e: e.d <> dst), [CASE WHEN h IS NULL THEN {{0}} WHEN ts >= h.t THEN {{1}} ELSE h END])
  FROM (SELECT *, list_filter(m, lambda e: e.d = dst)[1] AS h FROM (
    SELECT o.src, o.i, o.dst, o.weight, o.ts, CASE WHEN len(f.l) >= 10 THEN {room} ELSE f.l END AS m FROM f JOIN o ON o.src = f.src AND o.i = f.i + 1))),
x AS (SELECT src, unnest(l) AS e FROM f QUALIFY i = max(i) OVER (PARTITION BY src))
SELECT src, e.d AS dst, e.w AS weight, e.t AS ts FROM x""".replace("{0}", "{'" + fields.split()[0] + "': " + ("weight, 'd': dst" if fields[0] == "w" else "dst, 'w': weight") + ", 't': ts}").replace("{1}", "{'" + fields.split()[0] + "': " + (f"{merge}, 'd': dst" if fields[0] == "w" else f"dst, 'w': {merge}") + ", 't': ts}")


@query(_walk("list_sort(f.l)[2:]", "w DOUBLE, d BIGINT, t BIGINT", "weight + h.w"))
def cap_weight(spark, d):
    """A capacity of 10 from which the lightest edge goes, also where the destination is there already."""
    return _fold(spark, d, RelationConfig("C2P", edge_max_num=10, eviction="weight"), "add")[0].select("src", "dst", "weight", "ts")


@query(_walk(f"list_filter(list_sort(f.l), lambda e, k: k <> floor({_u('1', 'o.src', chr(39) + 'evict' + chr(39), 'o.i')} * (len(f.l) - 1e-9)) + 1)", "d BIGINT, w DOUBLE, t BIGINT", "weight"))
def cap_random(spark, d):
    """A capacity of 10 from which an edge goes that a hash of the source and the row's number chooses."""
    return _fold(spark, d, RelationConfig("C2P", edge_max_num=10, eviction="random"))[0].select("src", "dst", "weight", "ts")


@query(f"WITH {_EVENTS} SELECT src, dst, weight, ts FROM u QUALIFY row_number() OVER (PARTITION BY src ORDER BY ts DESC, seq DESC, dst) <= 20")
def cdf_append_cap(spark, d):
    return upsert.keep_newest(tables.user_event(spark, d), 20).select("src", "dst", "weight", "ts")


@query(f"WITH {_PURCHASES} SELECT src AS id, count(*) AS degree, count(DISTINCT dst) AS edge_num, {T_HIGH} + 86400 AS expire_ts FROM raw GROUP BY src")
def fold_nodes(spark, d):
    """Degrees, list lengths and expiry of the folded nodes."""
    nodes = _fold(spark, d, RelationConfig("C2P", edge_max_num=60000, expire_interval=86400))[1]
    return nodes.select("id", "degree", "edge_num", "expire_ts")


@query(f"WITH {_PURCHASES} SELECT src, dst, weight, ts FROM e WHERE (src, dst) NOT IN (SELECT o_custkey + 1, l_partkey + 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')")
def delete_edges(spark, d):
    lines, orders = tables.table(spark, d, "lineitem").where("l_returnflag = 'R'"), tables.table(spark, d, "orders")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") + 1).alias("src"), (F.col("l_partkey") + 1).alias("dst"))
    return upsert.delete_edges(tables.customer_part(spark, d), pairs).select("src", "dst", "weight", "ts")


@query(
    f"""WITH {_PURCHASES}, p AS (SELECT o_custkey + 1 AS src, o_orderkey AS run, CASE WHEN l_linenumber = 5 THEN 0 ELSE l_partkey + 1 END AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
g AS (SELECT src, run, list(dst) AS d FROM p GROUP BY src, run), gone AS (SELECT DISTINCT src, unnest(d) AS dst FROM g WHERE NOT list_contains(d, 0))
SELECT e.src, e.dst, weight, ts FROM e LEFT JOIN gone ON gone.src = e.src AND gone.dst = e.dst WHERE gone.src IS NULL"""
)
def delete_zero(spark, d):
    """Returned lines of an order are a group; one with an id 0 deletes nothing."""
    lines, orders = tables.table(spark, d, "lineitem").where("l_returnflag = 'R'"), tables.table(spark, d, "orders")
    dst = F.when(F.col("l_linenumber") == 5, 0).otherwise(F.col("l_partkey") + 1).cast("long")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") + 1).alias("src"), dst.alias("dst"), F.col("o_orderkey").alias("run"))
    return upsert.delete_edges(tables.customer_part(spark, d), pairs).select("src", "dst", "weight", "ts")


@query(f"WITH {_PURCHASES} SELECT src, dst, weight, ts FROM e WHERE ts = 0 OR ts + 31536000 >= {T_HIGH}")
def edge_expire(spark, d):
    return maintain.expire_edges(tables.customer_part(spark, d), 31536000, T_HIGH).select("src", "dst", "weight", "ts")


@query(f"WITH {_PURCHASES} SELECT src, dst, weight * 0.5 * 0.5 AS weight, ts FROM e WHERE weight * 0.5 >= 4 AND weight * 0.5 * 0.5 >= 4")
def time_decay(spark, d):
    return maintain.decay_edges(tables.customer_part(spark, d), 0.5, 4.0, 2).select("src", "dst", "weight", "ts")


@query(f"WITH {_PURCHASES} SELECT src AS id, CAST(floor(floor(count(*) * 0.7::DOUBLE) * 0.7::DOUBLE) AS BIGINT) AS degree FROM raw GROUP BY src")
def degree_decay(spark, d):
    return maintain.decay_degrees(node_degree(spark, d), 0.7, 2)


@query(f"WITH {_PURCHASES} SELECT src AS id, max(ts) + 86400000 AS expire_ts FROM e GROUP BY src HAVING max(ts) + 86400000 > {T_HIGH} + 90000000")
def node_expire(spark, d):
    nodes = tables.customer_part(spark, d).groupBy(F.col("src").alias("id")).agg((F.max("ts") + 86400000).alias("expire_ts"))
    return maintain.expire_nodes(nodes, T_HIGH + 90000000)


@query(f"WITH {_PURCHASES}, n AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src) SELECT id, degree FROM n QUALIFY row_number() OVER (ORDER BY degree, {_h('id')}) > floor(count(*) OVER () * (0.05 / 0.95))")
def mem_evict(spark, d):
    """Under pressure (occupancy 0.95) 0.05 / 0.95 of the nodes go, those of the smallest degrees."""
    nodes = tables.customer_part(spark, d).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return maintain.evict_under_pressure(nodes, 0.95)


@query(f"SELECT c_custkey + 1 AS id, c_custkey % 2 AS degree FROM customer QUALIFY row_number() OVER (ORDER BY c_custkey % 2, {_h('c_custkey + 1')}) > floor(count(*) OVER () * 0.3::DOUBLE)")
def evict_ties(spark, d):
    """Half of the nodes tie at the cut; three tenths go, not all that tie."""
    nodes = tables.table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("id"), (F.col("c_custkey") % 2).alias("degree"))
    return maintain.evict_under_pressure(nodes, 1.0, reduce=0.3)


@query(f"""WITH n AS (SELECT c_custkey + 1 AS id, c_custkey % 7 AS expire_ts, c_custkey AS seq FROM customer), live AS (SELECT * FROM n WHERE expire_ts = 0 OR expire_ts > 2)
SELECT id, expire_ts, seq FROM live QUALIFY row_number() OVER (ORDER BY seq DESC) <= floor(0.95::DOUBLE * (SELECT count(*) // 2 FROM n))""")
def fifo_recycle(spark, d):
    """Expired nodes go, then the first inserted, until 0.95 of a capacity of half of all nodes is kept."""
    customers = tables.table(spark, d, "customer")
    nodes = customers.select((F.col("c_custkey") + 1).alias("id"), (F.col("c_custkey") % 7).alias("expire_ts"), F.col("c_custkey").alias("seq"))
    return maintain.recycle(nodes, 2, customers.count() // 2)


@query(f"WITH {_PURCHASES} SELECT dst AS src, src AS dst, weight, ts FROM e")
def reverse_edges(spark, d):
    return lookup.reverse(tables.customer_part(spark, d)).select("src", "dst", "weight", "ts")


@query(f"WITH {_PURCHASES} SELECT src, dst, weight, ts FROM e UNION ALL SELECT dst, src, weight, ts FROM e")
def undirected(spark, d):
    return lookup.undirected(tables.customer_part(spark, d)).select("src", "dst", "weight", "ts")


@query(
    f"""WITH {_PURCHASES},
p AS (SELECT l_partkey + 1 AS dst, l_suppkey + 1 AS src, l_quantity AS weight, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts, l_orderkey * 10 + l_linenumber AS seq FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY CAST(floor(epoch(l_shipdate)) AS BIGINT) DESC, l_orderkey * 10 + l_linenumber DESC, l_quantity DESC) = 1),
b AS (SELECT dst AS src, src AS dst, weight, ts, seq FROM e), pb AS (SELECT dst AS src, src AS dst, weight, ts, seq FROM p),
parts AS (SELECT p_partkey AS seed_pos, p_partkey + 1 AS id FROM part),
{_rank(_RECENT, 4, edges='b', seeds='parts', name='k1')}, {_rank(_RECENT, 3, edges='pb', seeds='parts', name='k2')}
SELECT 'C2P' AS edge_type, dst AS neighbour, seed_pos + 1 AS node FROM k1 UNION ALL SELECT 'S2P', dst, seed_pos + 1 FROM k2"""
)
def subgraph_coo(spark, d):
    """For each part the sampled customers and suppliers, as pairs by edge type."""
    parts = tables.table(spark, d, "part").select(F.col("p_partkey").alias("seed_pos"), (F.col("p_partkey") + 1).alias("id"))
    return lookup.subgraph(parts, [("C2P", lookup.reverse(tables.customer_part(spark, d)), 4), ("S2P", tables.part_supplier(spark, d), 3)])


@query(f"WITH {_PURCHASES} SELECT dst AS id, row_number() OVER (ORDER BY dst) - 1 AS label FROM (SELECT DISTINCT dst FROM e)")
def reindex(spark, d):
    return lookup.reindex(tables.customer_part(spark, d), "dst")


@query(
    f"""WITH {_PURCHASES}, {_rank(_RECENT, 1)}, n AS (SELECT count(*) AS c FROM customer), pool AS (SELECT p_partkey + 1 AS id, row_number() OVER (ORDER BY p_partkey) AS upto, count(*) OVER () AS total FROM part),
neg AS (SELECT draw, id FROM (SELECT draw, {_u('draw', '1')} * (SELECT max(total) FROM pool) AS mark FROM (SELECT unnest(range((SELECT c * 2 FROM n))) AS draw)) JOIN pool ON mark > upto - 1 AND mark <= upto)
SELECT seeds.seed_pos AS pos, seeds.id AS src, coalesce(k.dst, 0) AS dst, 1 AS label FROM seeds LEFT JOIN k USING (seed_pos)
UNION ALL SELECT seeds.seed_pos, seeds.id, neg.id, 0 FROM seeds JOIN neg ON neg.draw // 2 = seeds.seed_pos"""
)
def neg_pairs(spark, d):
    """Each customer's most recent part with label 1, and two random parts with label 0."""
    seeds = tables.customer_seeds(spark, d)
    positives = sample_neighbors(seeds, tables.customer_part(spark, d), "most_recent", 1, "zero")
    parts = tables.table(spark, d, "part").select((F.col("p_partkey") + 1).alias("id"), F.lit(1.0).alias("weight"))
    return lookup.label_pairs(positives, pools.draw_nodes(parts, seeds.count() * 2), 2)


@query(f"WITH {_PURCHASES} SELECT avg(n) AS avg_len FROM (SELECT count(*) AS n FROM e GROUP BY src)")
def len_avg(spark, d):
    return stats.average_length(stats.node_counts(tables.customer_part(spark, d)))


@query(
    f"""WITH {_PURCHASES}, c AS (SELECT count(*) AS n FROM e GROUP BY src), h AS (SELECT n, count(*) AS k FROM c GROUP BY n),
s AS (SELECT n, floor(sum(k) OVER (ORDER BY n) * 100 / (SELECT count(*) FROM c)) AS share FROM h), q AS (SELECT unnest(range(10, 101, 10)) AS q)
SELECT CAST(q AS INTEGER) AS q, min(n) AS length FROM q JOIN s ON share >= q GROUP BY q"""
)
def len_quantiles(spark, d):
    return stats.length_quantiles(stats.node_counts(tables.customer_part(spark, d)))


@query(
    f"""WITH {_PURCHASES}, c AS (SELECT least(count(src), 40) AS n FROM seeds LEFT JOIN e ON e.src = seeds.id GROUP BY seed_pos), h AS (SELECT n, count(*) AS k FROM c GROUP BY n),
s AS (SELECT n, floor(sum(k) OVER (ORDER BY n) * 100 / (SELECT count(*) FROM c)) AS share FROM h), q AS (SELECT unnest(range(10, 101, 10)) AS q)
SELECT CAST(q AS INTEGER) AS q, min(n) AS length FROM q JOIN s ON share >= q GROUP BY q"""
)
def sample_quantiles(spark, d):
    """Quantiles of the slots that a sample of 40 fills."""
    return stats.length_quantiles(stats.sample_counts(_sample("most_recent", 40)(spark, d)))


@query(f"WITH {_PURCHASES} SELECT src, count(*) FILTER (ts BETWEEN {T_LOW} AND {T_HIGH}) AS n FROM e GROUP BY src")
def time_range_count(spark, d):
    return stats.count_in_range(tables.customer_part(spark, d), T_LOW, T_HIGH)


@query(f"WITH {_PURCHASES} SELECT src, dst, sum(weight) OVER (PARTITION BY src ORDER BY ts DESC, seq DESC, dst ROWS UNBOUNDED PRECEDING) AS cum_weight FROM e")
def running_weight(spark, d):
    return stats.running_weight(tables.customer_part(spark, d)).select("src", "dst", "cum_weight")


@query(
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'floor-10' WHEN p_size < 20 THEN '10-20' WHEN p_size < 30 THEN '20-30' WHEN p_size < 45 THEN '30-45' ELSE '45-upper' END AS label FROM part"""
)
def range_label(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", scalars.range_label(F.col("p_size"), [10, 20, 30, 45]).alias("label"))


@query(
    """WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 WHEN 1 THEN epoch_us(ts) // 1000 WHEN 2 THEN epoch_us(ts) ELSE -event_id END AS t FROM events)
SELECT event_id, CASE WHEN t < 0 THEN 0 WHEN t < 4320432000 THEN t WHEN t < 4320432000000 THEN t // 1000 WHEN t < 4320432000000000 THEN t // 1000000 ELSE 0 END AS sec FROM t"""
)
def ts_normalize(spark, d):
    """Times of four units as seconds."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    kind = F.col("event_id") % 4
    t = F.when(kind == 0, F.floor(us / 1000000)).when(kind == 1, F.floor(us / 1000)).when(kind == 2, us).otherwise(-F.col("event_id"))
    return tables.table(spark, d, "events").select("event_id", scalars.to_seconds(t).alias("sec"))


@query(
    """WITH p AS (SELECT o_orderkey, o_orderdate AS t, o_orderkey % 3 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 2 THEN 0 WHEN 1 THEN CAST(epoch(date_trunc('day', t)) AS BIGINT) - 28800 + 3600 * 7 + 60 * 5 ELSE CAST(epoch(date_trunc('day', t)) AS BIGINT) - 28800 END AS sec FROM p"""
)
def dt_path(spark, d):
    """Times of dt= in paths: with a day, with a day and a clock, and without a valid date."""
    day = F.date_format("o_orderdate", "yyyyMMdd")
    kind = F.col("o_orderkey") % 3
    path = F.when(kind == 2, F.lit("/a/dt=20211399/x")).when(kind == 1, F.concat(F.lit("/a/dt="), day, F.lit("0705/x"))).otherwise(F.concat(F.lit("/a/dt="), day, F.lit("/x")))
    return tables.table(spark, d, "orders").select("o_orderkey", scalars.path_time(path).alias("sec"))


@query(
    f"""WITH {_PURCHASES}, c AS (SELECT src, count(*) AS n, sum(weight) AS w FROM e GROUP BY src)
SELECT id, coalesce(n, 0) AS n, coalesce(w, 0) AS w, c_nationkey::BIGINT AS i0 FROM (SELECT c_custkey + 1 AS id, c_nationkey FROM customer) LEFT JOIN c ON src = id"""
)
def parse_line(spark, d):
    """A relation written as text lines and parsed again."""
    edges = tables.customer_part(spark, d).withColumns({"int_attrs": F.array(F.lit(1).cast("long")), "float_attrs": F.array(F.lit(0.5).cast("float"))})
    lines = text.format_lines(edges, _customer_nodes(spark, d))
    parsed = text.parse_lines(lines, F.lit(0).cast("long"))
    total = F.aggregate("dests", F.lit(0.0), lambda a, e: a + e["weight"])
    return parsed.where("ok").select(F.col("src").alias("id"), F.size("dests").cast("long").alias("n"), total.alias("w"), F.col("node_ints")[0].alias("i0"))


@query()
def string_ids(spark, d):
    return tables.table(spark, d, "customer").select("c_name", scalars.string_id(F.col("c_name")).alias("id"))


@query(f"WITH {_PURCHASES} SELECT src AS pos, src * 2 AS id, (src * 2) IN (SELECT src FROM e) AS found FROM (SELECT DISTINCT src FROM e)")
def attr_exist(spark, d):
    sources = tables.customer_part(spark, d).select(F.col("src").alias("id")).distinct()
    return lookup.exists(sources.select(F.col("id").alias("pos"), (F.col("id") * 2).alias("id")), sources)


@query(f"WITH {_PURCHASES}, c AS (SELECT src AS id, count(*) AS n FROM e GROUP BY src) SELECT id, n, ln(n) AS w_log, ln(n + 1) AS w_log1p, pow(n, 0.75) AS w_power FROM c WHERE n > 1")
def weight_transforms(spark, d):
    c = stats.node_counts(tables.customer_part(spark, d)).where("edge_num > 1")
    n = F.col("edge_num")
    return c.select("id", n.alias("n"), scalars.transform_weight(n, "log").alias("w_log"), scalars.transform_weight(n, "log1p").alias("w_log1p"), scalars.transform_weight(n, "power", 0.75).alias("w_power"))


@query("""SELECT c_custkey + 1 AS id, coalesce(o.v, c_acctbal) AS v FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS v FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey
UNION ALL SELECT o_custkey + 1, max_by(o_totalprice, o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey""")
def put_rows(spark, d):
    """Whole rows put by key: the last order's price replaces the balance."""
    base = tables.table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("id"), F.col("c_acctbal").alias("v"))
    rows = tables.table(spark, d, "orders").select((F.col("o_custkey") + 1).alias("id"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"))
    return store.put(base, rows)


@query("SELECT c_custkey + 1 AS id, c_acctbal AS v FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING')")
def erase_where(spark, d):
    base = tables.table(spark, d, "customer")
    return store.erase_where(base, (F.col("c_acctbal") < 0) | (F.col("c_mktsegment") == "BUILDING")).select((F.col("c_custkey") + 1).alias("id"), F.col("c_acctbal").alias("v"))


@query(f"WITH {_PURCHASES} SELECT src AS id, 24 + count(*) * 26 AS size FROM e GROUP BY src")
def key_sizes(spark, d):
    return store.key_sizes(tables.customer_part(spark, d), attr_values=2)


@query(f"WITH {_PURCHASES}, n AS (SELECT src AS id, max(ts) + 86400000 AS expire_ts FROM e GROUP BY src) SELECT id, expire_ts - ({T_HIGH} + 90000000) AS left FROM n WHERE expire_ts > {T_HIGH} + 90000000".replace(" AS left", " AS \"left\""))
def copy_live(spark, d):
    nodes = tables.customer_part(spark, d).groupBy(F.col("src").alias("id")).agg((F.max("ts") + 86400000).alias("expire_ts"))
    return store.copy_live(nodes, T_HIGH + 90000000).select("id", "left")


@query(f"WITH {_PURCHASES}, kept AS (SELECT * FROM e WHERE src NOT IN (SELECT o_custkey + 1 FROM orders WHERE o_orderpriority = '1-URGENT')), logs AS (SELECT * FROM raw WHERE src IN (SELECT o_custkey + 1 FROM orders WHERE o_orderpriority = '1-URGENT')) SELECT src, dst, weight FROM kept UNION ALL SELECT src, dst, weight FROM ({_arrivals('a.w + x.w', 'logs')})")
def insert_overwrite(spark, d):
    """Sources of a log lose their edges before its own are inserted."""
    urgent = tables.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") + 1).alias("src")).distinct()
    logs = tables.purchases(spark, d).join(urgent, "src", "left_semi")
    return upsert.overwrite(tables.customer_part(spark, d), logs, "add").select("src", "dst", "weight")
