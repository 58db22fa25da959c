"""The fluent API: relations, and chains of steps that become one lazy DataFrame a named layer."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.scalars import expired, string_id
from tidegraph.operators import lookup, maintain, pools, upsert
from tidegraph.operators.sampling import next_seeds, sample_neighbors
from tidegraph.schema import EDGE_SCHEMA, PADDINGS, SEED_SCHEMA, STRATEGIES, RelationConfig, choose, relation_configs
from tidegraph.scratch import materialise
from tidegraph.unions import union


class Relation:
    """Edges and nodes of one type; every change gives new tables and leaves the old ones as they were."""

    def __init__(self, spark: SparkSession, cfg: RelationConfig, edges: DataFrame | None = None, nodes: DataFrame | None = None):
        self.spark, self.cfg = spark, cfg
        self.edges = edges if edges is not None else spark.createDataFrame([], EDGE_SCHEMA)
        self.nodes = nodes if nodes is not None else self._nodes_of(self.edges)

    def _nodes_of(self, edges: DataFrame) -> DataFrame:
        counts = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        return counts.select("id", "degree", F.col("degree").alias("edge_num"), F.lit(0).cast("long").alias("expire_ts"), F.array().cast("array<long>").alias("int_attrs"), F.array().cast("array<float>").alias("float_attrs"))

    def upsert(self, batch: DataFrame, now: int, action: str = "replace", use_item_ts: bool = False, where: str | None = None) -> Relation:
        """Fold a batch in. The new tables are written as Parquet (below `where`, or in the scratch folder), so plans don't grow."""
        folded = upsert.fold(self.edges, self.nodes, batch, self.cfg, action, now, use_item_ts)
        touched = batch.select("src").distinct()
        others = upsert.join_folded(self.edges, self.nodes).join(touched, "src", "left_anti").select(*folded.columns)
        return Relation(self.spark, self.cfg, *upsert.split_folded(materialise(union(folded, others), "folded", where)))

    def stored(self, where: str | None = None) -> Relation:
        """The same relation, written as Parquet."""
        return Relation(self.spark, self.cfg, *upsert.split_folded(materialise(upsert.join_folded(self.edges, self.nodes), "folded", where)))

    def delete(self, pairs: DataFrame, now: int) -> Relation:
        """Delete edges (src, dst and optionally run); a group with an id 0 deletes nothing (upsert.valid_deletes),
        a node without edges left expires."""
        if self.cfg.multigraph:
            raise ValueError("a cdf relation cannot delete by pair")
        edges = upsert.delete_edges(self.edges, pairs)
        return Relation(self.spark, self.cfg, edges, maintain.empty_nodes_expire(self.nodes, edges, now))

    def expire(self, now: int) -> Relation:
        """Drop expired edges and nodes."""
        edges = self.edges if self.cfg.multigraph else maintain.expire_edges(self.edges, self.cfg.edge_expire_interval_s, now)
        nodes = maintain.expire_nodes(maintain.empty_nodes_expire(self.nodes, edges, now), now)
        return Relation(self.spark, self.cfg, edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi"), nodes)

    def decay(self, before: int, now: int) -> Relation:
        """The decay ticks between two times."""
        ticks = maintain.ticks_between(before, now, self.cfg.decay_interval_s)
        edges = maintain.decay_edges(self.edges, self.cfg.weight_decay_ratio, self.cfg.delete_threshold_weight, ticks, self.cfg.multigraph)
        return Relation(self.spark, self.cfg, edges, maintain.decay_degrees(self.nodes, self.cfg.degree_decay_ratio, ticks))

    def evict(self, capacity: int) -> Relation:
        """Make room when the nodes exceed the occupancy rate of a capacity."""
        cfg = self.cfg
        nodes = maintain.evict_under_pressure(self.nodes, self.nodes.count() / capacity, cfg.max_occupancy_rate, cfg.reduce_occupancy_rate, cfg.reduce_by)
        return Relation(self.spark, cfg, self.edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi"), nodes)

    def clear(self) -> Relation:
        return Relation(self.spark, self.cfg)

    def node(self, id_: int, now: int | None = None) -> DataFrame:
        """One node's row with its edges in the order of time; expired ones are hidden when `now` is given."""
        own = self.nodes.where(F.col("id") == id_)
        if now is not None:
            own = own.where(~expired(F.col("expire_ts"), now))
        edges = self.edges.where(F.col("src") == id_).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "dst", "weight"))).alias("edges"))
        return own.join(edges, own["id"] == edges["src"], "left").drop("src")


class Graph:
    """Named relations; chains begin at random_nodes, set_nodes or iter.

    With a clock (a function that gives epoch seconds) samples of expired sources find nothing.
    """

    def __init__(self, spark: SparkSession, clock: Callable[[], int] | None = None):
        self.spark, self.clock = spark, clock
        self.relations: dict[str, Relation] = {}
        self._pages: dict[str, lookup.NodePages] = {}

    @classmethod
    def from_config(cls, spark: SparkSession, document: dict, host: str = "default", clock: Callable[[], int] | None = None, checkpoints: str | None = None) -> Graph:
        """The relations of a host's configuration, each from the newest checkpoint, then from its text loaders."""
        from tidegraph.sources import checkpoint, text

        graph, now = cls(spark, clock), (clock or (lambda: int(time.time())))()
        for cfg, loaders in relation_configs(document, host):
            relation = Relation(spark, cfg)
            if checkpoints and checkpoint.versions(spark, checkpoints):
                relation = Relation(spark, cfg, *checkpoint.load(spark, checkpoints, cfg.name))
            for loader in loaders:
                batch, _ = text.load_text(spark, loader["path"], now, loader.get("ts_from_path", False))
                relation = relation.upsert(batch, now, loader.get("action", "add"))
            graph.add_relation(relation)
        return graph

    def now(self) -> int | None:
        return self.clock() if self.clock else None

    def add_relation(self, relation: Relation, iter_part_size: int = 1024, iter_shard_num: int = 1, iter_shard_id: int = 0) -> Graph:
        name = relation.cfg.name
        if name in self.relations:
            raise ValueError(f"relation {name!r} is already known")
        self.relations[name] = relation
        self._page_args = {**getattr(self, "_page_args", {}), name: (iter_part_size, iter_shard_num, iter_shard_id)}
        return self

    def set_nodes(self, relation: str, ids: Sequence[int] | Sequence[str] | DataFrame, name: str) -> Chain:
        """Seeds as given, repeated ids and order kept; strings are hashed to ids, a DataFrame has (seed_pos, id)."""
        self._known(relation)
        if isinstance(ids, DataFrame):
            seeds = ids.select("seed_pos", "id")
        else:
            ids = list(ids)
            text = bool(ids) and isinstance(ids[0], str)
            seeds = self.spark.createDataFrame(list(enumerate(ids)), "seed_pos long, id string" if text else SEED_SCHEMA)
            if text:
                seeds = seeds.select("seed_pos", string_id(F.col("id")).alias("id"))
        return Chain(self, name, seeds)

    def random_nodes(self, relation: str, name: str, batch: int = 1, pool: str | Column = "uniform", seed: int = 1, now: int | None = None, **weight) -> Chain:
        nodes = self._known(relation).nodes
        keep = None if now is None else pools.pool_filter(now=now)
        drawn = pools.random_nodes(nodes, batch, pool, keep, seed, **weight)
        return Chain(self, name, drawn.withColumnRenamed("draw", "seed_pos"))

    def iter(self, relation: str, name: str) -> Chain:
        """The next page of a relation's nodes; its seeds are numbered by their hashes' order in the page."""
        nodes = self._known(relation).nodes
        if relation not in self._pages:
            self._pages[relation] = lookup.NodePages(nodes, *self._page_args[relation])
        page = self._pages[relation].next()
        return Chain(self, name, lookup.reindex(page).select(F.col("label").alias("seed_pos"), "id"))

    def insert_edges(self, relation: str, int_attr_len: int = 0, float_attr_len: int = 0) -> Insert:
        self._known(relation)
        return Insert(self, relation, int_attr_len, float_attr_len)

    def delete_edges(self, relation: str) -> Delete:
        self._known(relation)
        return Delete(self, relation)

    def _known(self, relation: str) -> Relation:
        if relation not in self.relations:
            raise KeyError(f"unknown relation {relation!r}")
        return self.relations[relation]


class Chain:
    """A chain of layers. Steps are remembered; emit composes them."""

    def __init__(self, graph: Graph, name: str, seeds: DataFrame):
        self.graph = graph
        self.layers: dict[str, DataFrame] = {name: seeds}
        self.name, self.seeds = name, seeds
        self._hop: dict | None = None

    def sample_neighbor(self, relation: str, name: str) -> Chain:
        self._close()
        self.graph._known(relation)
        self._hop = {"relation": relation, "name": name, "fanout": 1, "strategy": "random", "padding": "self", "without_replacement": False, "min_weight": 0.0, "max_ts": 0, "min_ts": 0}
        return self

    def _open(self) -> dict:
        if self._hop is None:
            raise ValueError("this step follows sample_neighbor")
        return self._hop

    def sample(self, n: int) -> Chain:
        if not isinstance(n, int) or isinstance(n, bool) or n < 1:
            raise TypeError("sample takes a positive whole number")
        self._open()["fanout"] = n
        return self

    def by(self, strategy: str, padding_type: str = "self", sampling_without_replacement: bool = False, min_weight_required: float = 0.0) -> Chain:
        if not isinstance(strategy, str) or not isinstance(padding_type, str) or not isinstance(sampling_without_replacement, bool):
            raise TypeError("strategy and padding_type are strings, sampling_without_replacement is a bool")
        choose(strategy, STRATEGIES, "strategy")
        choose(padding_type, PADDINGS, "padding")
        self._open().update(strategy=strategy, padding=padding_type, without_replacement=sampling_without_replacement, min_weight=min_weight_required)
        return self

    def max_timestamp(self, t: int) -> Chain:
        self._open()["max_ts"] = seconds(whole(t))
        return self

    def min_timestamp(self, t: int) -> Chain:
        self._open()["min_ts"] = seconds(whole(t))
        return self

    def with_attr(self, relation: str, int64_attr_len: int, float_attr_len: int) -> Chain:
        """Adds attributes of the previous layer's ids to that layer; the next hop starts from the same ids."""
        self._close()
        nodes = self.graph._known(relation).nodes
        int64_attr_len, float_attr_len = whole(int64_attr_len), whole(float_attr_len)
        attrs = lookup.node_attrs(self.seeds, nodes, int64_attr_len, float_attr_len)
        self.layers[self.name] = self.layers[self.name].join(attrs.drop("id"), "seed_pos") if "draw" not in self.layers[self.name].columns else self._with_slots(attrs)
        return self

    def _with_slots(self, attrs: DataFrame) -> DataFrame:
        layer, fanout = self.layers[self.name], self._fanout
        return layer.withColumn("slot", F.col("seed_pos") * fanout + F.col("draw")).join(attrs.drop("id").withColumnRenamed("seed_pos", "slot"), "slot").drop("slot")

    def _close(self) -> None:
        hop, self._hop = self._hop, None
        if hop is None:
            return
        relation = self.graph._known(hop.pop("relation"))
        name = hop.pop("name")
        self._fanout = hop["fanout"]
        layer = sample_neighbors(self.seeds, relation.edges, hop.pop("strategy"), hop.pop("fanout"), hop.pop("padding"), elst=relation.cfg.elst, seed=relation.cfg.seed, nodes=relation.nodes, now=self.graph.now(), **hop)
        self.layers[name] = layer
        self.name, self.seeds = name, next_seeds(layer, self._fanout)

    def emit(self) -> dict[str, DataFrame]:
        """Every named layer as a lazy DataFrame; of layers of one name the last."""
        self._close()
        return dict(self.layers)


class Insert:
    """Collects edges to insert; each optional column is given always or never."""

    def __init__(self, graph: Graph, relation: str, int_len: int, float_len: int):
        self.graph, self.relation, self.int_len, self.float_len = graph, relation, int_len, float_len
        self.rows: list[tuple] = []
        self.given: tuple | None = None

    def more_edges(self, src: Sequence[int], dst: Sequence[int] | None = None, weights: Sequence[float] | None = None, timestamps: Sequence[int] | None = None, int_attrs: Sequence[int] | None = None, float_attrs: Sequence[float] | None = None) -> Insert:
        n = len(src)
        for what, values in (("dst", dst), ("weights", weights), ("timestamps", timestamps)):
            if values is not None and len(values) != n:
                raise ValueError(f"{what} has {len(values)} values for {n} sources")
        for what, values, length in (("int_attrs", int_attrs, self.int_len), ("float_attrs", float_attrs, self.float_len)):
            if values is not None and len(values) != n * length:
                raise ValueError(f"{what} needs {length} values a source")
        given = tuple(x is not None for x in (dst, weights, timestamps, int_attrs, float_attrs))
        if self.given not in (None, given):
            raise ValueError("optional columns must be given always or never")
        self.given = given
        for i in range(n):
            ints = list(int_attrs[i * self.int_len : (i + 1) * self.int_len]) if int_attrs is not None else None
            floats = [float(x) for x in float_attrs[i * self.float_len : (i + 1) * self.float_len]] if float_attrs is not None else None
            self.rows.append((int(src[i]), int(dst[i]) if dst is not None else 0, float(weights[i]) if weights is not None else None, int(timestamps[i]) if timestamps is not None else None, len(self.rows), ints, floats))
        return self

    def frame(self) -> DataFrame:
        return self.graph.spark.createDataFrame(self.rows, "src long, dst long, weight double, ts long, seq long, node_ints array<long>, node_floats array<float>")

    def emit(self, now: int, action: str = "replace") -> None:
        self.graph.relations[self.relation] = self.graph.relations[self.relation].upsert(self.frame(), now, action)


class Delete:
    """Collects pairs to delete."""

    def __init__(self, graph: Graph, relation: str):
        self.graph, self.relation, self.rows, self.run = graph, relation, [], 0

    def more_edges(self, src: Sequence[int], dst: Sequence[int]) -> Delete:
        if len(src) != len(dst):
            raise ValueError("src and dst differ in length")
        for a, b in zip(src, dst, strict=True):
            self.run += bool(self.rows) and self.rows[-1][0] != int(a)  # rows of one source that follow each other are a group
            self.rows.append((int(a), int(b), self.run))
        return self

    def emit(self, now: int) -> None:
        pairs = self.graph.spark.createDataFrame(self.rows, "src long, dst long, run long")
        self.graph.relations[self.relation] = self.graph.relations[self.relation].delete(pairs, now)


def whole(n: int) -> int:
    if not isinstance(n, int) or isinstance(n, bool):
        raise TypeError(f"a whole number is asked for, not {n!r}")
    return n


def seconds(t: int) -> int:
    """A time in seconds, milliseconds or microseconds as seconds; 0 where it is none of them."""
    from tidegraph.functions.scalars import YEARS_137

    if t < 0:
        return 0
    for unit in (1, 1000, 1_000_000):
        if t < YEARS_137 * unit:
            return t // unit
    return 0
