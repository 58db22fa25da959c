"""Upserts of edges: order-free aggregations, and the ordered fold for everything else."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.schema import EVICTIONS, INSERT_ACTIONS, NO_NODE, RelationConfig, choose
from tidegraph.unions import union

MIN_WEIGHT, MAX_WEIGHT = 0.001, 1000.0
EDGE = "src long, dst long, weight double, ts long, seq long, int_attrs array<long>, float_attrs array<float>"
FOLDED = f"kind int, {EDGE}, degree long, edge_num long, expire_ts long"


def valid_edges(log: DataFrame, multigraph: bool = False) -> DataFrame:
    """Rows that an insert accepts: a destination, and a weight within bounds (missing ones are given later)."""
    w = F.col("weight")
    bound = w > 0 if multigraph else (w > MIN_WEIGHT) & (w < MAX_WEIGHT)
    return log.where((F.col("dst") != NO_NODE) & (w.isNull() | bound))


def in_time(log: DataFrame) -> DataFrame:
    """Rows of a log that are not late: none of their pair that arrived before (by seq) has a later time."""
    arrived = Window.partitionBy("src", "dst").orderBy("seq", "ts", "weight")
    before = F.max("ts").over(arrived.rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("newest", before).where(F.col("newest").isNull() | (F.col("ts") >= F.col("newest"))).drop("newest")


def combine(log: DataFrame, action: str = "replace", *, precise: bool = True, late: bool = True) -> DataFrame:
    """One edge a pair from a log in the order of arrival (seq), without a size limit: what fold gives then.

    Invalid rows and late ones change nothing. add: sum; replace: the last weight; max: the
    largest; avg: the running midpoint, which lists that are not `precise` replace instead.
    `late=False` promises that no row is late and saves the sort by arrival; replace never needs it.
    Missing times are 0; a missing weight, which fold draws, is an error of the log and dropped here.
    """
    choose(action, INSERT_ACTIONS, "action")
    if action == "avg" and not precise:
        action = "replace"
    rows = valid_edges(log).where("weight is not null").withColumn("ts", F.coalesce("ts", F.lit(0)).cast("long"))
    if late and action != "replace":
        rows = in_time(rows)
    last = F.max(F.struct("ts", "seq", "weight"))
    if action == "avg":
        # halved once for each row behind; the first row, which nothing precedes, once less
        pair = Window.partitionBy("src", "dst")
        behind = F.row_number().over(pair.orderBy(F.desc("seq"), F.desc("ts"), F.desc("weight")))
        halvings = F.least(behind, F.count("*").over(pair) - 1)
        rows = rows.withColumn("part", F.col("weight") * F.pow(F.lit(0.5), halvings))
    weight = {"add": F.sum("weight"), "max": F.max("weight"), "avg": F.sum("part") if action == "avg" else None, "replace": last["weight"]}[action]
    out = rows.groupBy("src", "dst").agg(weight.alias("weight"), last.alias("e"))
    return out.select("src", "dst", "weight", "e.ts", "e.seq")


def keep_newest(edges: DataFrame, cap: int) -> DataFrame:
    """The `cap` newest edges a source: eviction of the oldest where times are distinct and pairs are unique,
    and appends to a multigraph list in the order (ts, seq)."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("ts"), F.desc("seq"), "dst"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank")


def valid_deletes(pairs: DataFrame) -> DataFrame:
    """The pairs that a delete acts on: a group without an id 0 on either side.

    A group is a source's rows, or its rows of one `run` where pairs have that column.
    """
    key = ["src", "run"] if "run" in pairs.columns else ["src"]
    bad = pairs.where(F.coalesce(F.col("dst"), F.lit(0)) == 0).select(*key).distinct()
    return pairs.where("src <> 0").join(bad, key, "left_anti").select("src", "dst").distinct()


def delete_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """edges without the given (src, dst); degrees are the nodes' and stay. A group with an id 0 deletes nothing."""
    return edges.join(valid_deletes(pairs), ["src", "dst"], "left_anti")


def overwrite(edges: DataFrame, log: DataFrame, action: str = "replace") -> DataFrame:
    """The log's sources lose all their edges before its edges are inserted."""
    kept = edges.join(log.select("src").distinct(), "src", "left_anti")
    fresh = combine(log, action)
    return union(kept, fresh.select(*[c for c in kept.columns if c in fresh.columns]), missing=True)


class _List:
    """One source's edges while a batch is folded in."""

    def __init__(self, cfg: RelationConfig, src: int):
        self.cfg, self.src = cfg, src
        self.edges: dict[int, list] = {}  # key -> [dst, weight, ts, touch, ints, floats]
        self.degree, self.expire, self.touch = 0, 0, 0
        self.ints: list | None = None
        self.floats: list | None = None
        self.new, self.touched = True, False
        self.queue: list[tuple] = []  # (rank, key) of every edge, and of some that changed since: for the first to go
        self.keys: list[int] = []  # in rising order, for random eviction

    def _random(self, *what) -> float:
        text = ":".join(map(str, (self.cfg.seed, self.src, *what)))
        return (int(hashlib.md5(text.encode()).hexdigest()[:12], 16) + 1) / ((1 << 48) + 1)

    def load(self, dst, weight, ts, touch, ints, floats) -> None:
        self._put(touch if self.cfg.multigraph else dst, [dst, weight, ts, touch, ints, floats])
        self.touch = max(self.touch, touch)

    def _rank(self, edge: list) -> tuple:
        return (edge[1],) if self.cfg.eviction == "weight" and not self.cfg.multigraph else (edge[2], edge[3])

    def _put(self, key: int, edge: list) -> None:
        if self.cfg.eviction == "random":
            if key not in self.edges:
                insort(self.keys, key)
        elif self.cfg.eviction != "cancel":
            heappush(self.queue, (*self._rank(edge), key))
            if len(self.queue) > 2 * len(self.edges) + 64:
                self.queue = [(*self._rank(e), k) for k, e in self.edges.items() if k != key] + [(*self._rank(edge), key)]
                heapify(self.queue)
        self.edges[key] = edge

    def _drop(self, key: int) -> None:
        del self.edges[key]
        if self.cfg.eviction == "random":
            del self.keys[bisect_left(self.keys, key)]

    def _first(self) -> int:
        """The key of the edge that goes first: the oldest, or the one of the least weight."""
        while True:
            *rank, key = self.queue[0]
            if key in self.edges and self._rank(self.edges[key]) == tuple(rank):
                return key
            heappop(self.queue)

    def add(self, dst, weight, ts, ints, floats, action) -> bool:
        """Fold one edge in; true if it counts towards the degree."""
        cfg = self.cfg
        if not dst:
            return False
        self.touch += 1
        ts = ts or 0
        if weight is None:
            weight = 1.0 if cfg.multigraph else 0.1 + 0.9 * self._random("weight", dst, self.touch)
        if weight <= 0 if cfg.multigraph else not MIN_WEIGHT < weight < MAX_WEIGHT:
            return False
        for block, length in ((ints, cfg.edge_int_attr_len), (floats, cfg.edge_float_attr_len)):
            if block and len(block) != length:
                return False
        full = len(self.edges) >= cfg.edge_max_num
        if cfg.multigraph:
            if full and cfg.eviction == "cancel":
                return False
            if full:
                old = self._first()
                if ts < self.edges[old][2]:
                    return True
                self._drop(old)
            self._put(self.touch, [dst, weight, ts, self.touch, ints, floats])
            return True
        if full:  # room is made before the destination is looked up
            if cfg.eviction == "cancel":
                return False
            if cfg.eviction == "lru":
                old = self._first()
                if ts <= self.edges[old][2] and self.edges[old][2] > 0:
                    return False
            elif cfg.eviction == "weight":
                old = self._first()
            else:
                old = self.keys[int(self._random("evict", self.touch) * (len(self.keys) - 1e-9))]
            self._drop(old)
        have = self.edges.get(dst)
        if have is None:
            self._put(dst, [dst, weight, ts, self.touch, ints, floats])
        elif ts >= have[2]:
            if action == "add":
                weight += have[1]
            elif action == "max":
                weight = max(weight, have[1])
            elif action == "avg" and cfg.precise:
                weight = (weight + have[1]) / 2
            self._put(dst, [dst, weight, ts, self.touch, ints or have[4], floats or have[5]])
        return True


def fold(edges: DataFrame | None, nodes: DataFrame | None, batch: DataFrame, cfg: RelationConfig, action: str, now: int, use_item_ts: bool = False) -> DataFrame:
    """Fold a batch into a relation, source by source in the order seq; the reference semantics of every upsert.

    batch: src, dst, weight, ts, seq and optionally int_attrs, float_attrs (of the edge), node_ints,
    node_floats, renew (whether the row renews the node's life; null: yes). Sources of the batch
    only are folded; the result has kind 0 rows (edges) and kind 1 rows (nodes). A row with neither
    a destination nor node attributes is rejected: it makes and renews no node.
    """
    choose(action, INSERT_ACTIONS, "action")
    choose(cfg.eviction, EVICTIONS, "eviction")
    kinds = {"int_attrs": "array<bigint>", "float_attrs": "array<float>", "node_ints": "array<bigint>", "node_floats": "array<float>", "renew": "boolean"}

    def col(df: DataFrame, name: str, kind: str) -> Column:
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)

    shape = [("src", "long"), ("dst", "long"), ("weight", "double"), ("ts", "long"), ("seq", "long"), *kinds.items()]
    rows = batch.select(F.lit(2).alias("kind"), *[col(batch, n, k) for n, k in shape], F.lit(0).cast("long").alias("degree"), F.lit(0).cast("long").alias("expire_ts"))
    touched = batch.select("src").distinct()
    if edges is not None:
        own = edges.join(touched, "src", "left_semi")
        rows = union(rows, own.select(F.lit(1).alias("kind"), *[col(own, n, k) for n, k in shape], F.lit(0).cast("long").alias("degree"), F.lit(0).cast("long").alias("expire_ts")))
    if nodes is not None:
        own = nodes.withColumnRenamed("id", "src").join(touched, "src", "left_semi")
        own = own.withColumnsRenamed({"int_attrs": "node_ints", "float_attrs": "node_floats"})
        rows = union(rows, own.select(F.lit(0).alias("kind"), *[col(own, n, k) for n, k in shape], "degree", "expire_ts"))
    dealt = rows.repartition("src").sortWithinPartitions("src", "kind", "seq", "dst", "ts", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _List | None = None
        out: list[tuple] = []
        first_ts: int | None = None
        renew = False

        def close() -> None:
            life = cfg.life
            if state.new and not state.touched:
                return
            if state.new:
                state.expire = now + life
            elif renew:
                state.expire = max(state.expire, (first_ts if use_item_ts and first_ts else now) + life)
            for dst, weight, ts, touch, ints, floats in state.edges.values():
                out.append((0, state.src, dst, weight, ts, touch, ints, floats, None, None, None))
            out.append((1, state.src, None, None, None, None, state.ints, state.floats, state.degree, len(state.edges), state.expire))

        for b in batches:
            c = {name: b.column(i).to_pylist() for i, name in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                src, kind = c["src"][i], c["kind"][i]
                if state is None or src != state.src:
                    if state is not None:
                        close()
                    state, first_ts, renew = _List(cfg, src), None, False
                if kind == 0:
                    state.new = False
                    state.degree, state.expire = c["degree"][i] or 0, c["expire_ts"][i] or 0
                    state.ints, state.floats = c["node_ints"][i], c["node_floats"][i]
                elif kind == 1:
                    state.load(c["dst"][i], c["weight"][i], c["ts"][i], c["seq"][i], c["int_attrs"][i], c["float_attrs"][i])
                elif c["dst"][i] or c["node_ints"][i] or c["node_floats"][i]:
                    state.touched = True
                    if c["node_ints"][i] and len(c["node_ints"][i]) == cfg.int_attr_len:
                        state.ints = c["node_ints"][i]
                    if c["node_floats"][i] and len(c["node_floats"][i]) == cfg.float_attr_len:
                        state.floats = c["node_floats"][i]
                    first_ts = c["ts"][i] if first_ts is None else first_ts
                    renew |= c["renew"][i] is not False
                    state.degree += state.add(c["dst"][i], c["weight"][i], c["ts"][i], c["int_attrs"][i], c["float_attrs"][i], action)
            if len(out) > 50_000:
                yield _folded(out)
                out.clear()
        if state is not None:
            close()
        if out:
            yield _folded(out)

    return dealt.mapInArrow(run, FOLDED)


def _folded(rows: list[tuple]) -> pa.RecordBatch:
    i, d, ints, floats = pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float32())
    kinds = (pa.int32(), i, i, d, i, i, ints, floats, i, i, i)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.strip().split(" ")[0] for x in FOLDED.split(", ")])


def join_folded(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges and nodes as the rows that fold gives: the inverse of split_folded."""

    def shaped(df: DataFrame, kind: int, names: dict[str, str]) -> DataFrame:
        fields = [x.split(" ") for x in FOLDED.split(", ")[1:]]
        return df.select(F.lit(kind).alias("kind"), *[(F.col(names.get(n, n)) if names.get(n, n) in df.columns else F.lit(None)).cast(k).alias(n) for n, k in fields])

    return union(shaped(edges, 0, {}), shaped(nodes, 1, {"src": "id"}))


def split_folded(folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a folded table, which should be materialised."""
    edges = folded.where("kind = 0").select("src", "dst", "weight", "ts", "seq", "int_attrs", "float_attrs")
    nodes = folded.where("kind = 1").select(F.col("src").alias("id"), "degree", "edge_num", "expire_ts", "int_attrs", "float_attrs")
    return edges, nodes
