"""Lookups of nodes and edges, scans by part, and pages of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.scalars import expired, fit_attrs, part_of
from tidegraph.scratch import materialise
from tidegraph.unions import union


def node_attrs(layer: DataFrame, nodes: DataFrame, int_len: int, float_len: int) -> DataFrame:
    """For each (seed_pos, id) of a layer: attr_exist, degree and the first attributes, zeros where missing.

    Expired nodes are not hidden.
    """
    have = nodes.select("id", F.lit(True).alias("found"), *[F.col(c) if c in nodes.columns else F.lit(0).cast("long").alias(c) for c in ("degree",)], "int_attrs", "float_attrs")
    out = layer.join(have, "id", "left")
    return out.select(
        "seed_pos", "id", F.coalesce("found", F.lit(False)).alias("attr_exist"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"),
        fit_attrs(F.col("int_attrs"), int_len).alias("int_attrs"), fit_attrs(F.col("float_attrs"), float_len, "float").alias("float_attrs"),
    )


def live(ids: DataFrame, nodes: DataFrame | None, now: int | None, column: str = "id") -> DataFrame:
    """Rows whose id is not that of a node expired at `now`; all without nodes or now."""
    if nodes is None or now is None:
        return ids
    gone = nodes.where(expired(F.col("expire_ts"), now)).select(F.col("id").alias(column))
    return ids.join(gone, column, "left_anti")


def node_getters(ids: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """For each (pos, id): expire_ts, degree and edge_num of the node; 0 where it is missing or expired."""
    own = expire_filter(nodes, now).select("id", "expire_ts", "degree", "edge_num")
    out = ids.join(own, "id", "left")
    return out.select("pos", "id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("expire_ts", "degree", "edge_num")])


def expire_filter(nodes: DataFrame, now: int) -> DataFrame:
    return nodes.where(~expired(F.col("expire_ts"), now))


def with_degree(layer: DataFrame, nodes: DataFrame, now: int | None = None) -> DataFrame:
    """A layer of samples with the lifetime degree of each slot's source; 0 where the node is missing or expired."""
    own = nodes if now is None else expire_filter(nodes, now)
    own = own.select(F.col("id").alias("src"), F.col("degree").cast("long").alias("degree"))
    return layer.join(own, "src", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def edge_lookup(pairs: DataFrame, edges: DataFrame, nodes: DataFrame | None = None, now: int | None = None) -> DataFrame:
    """For each (pos, src, dst): the edge's weight and ts, and found; a miss is a zero edge.

    With nodes and now, edges of expired sources are missed.
    """
    found = live(edges.select("src", "dst", "weight", "ts").join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi"), nodes, now, "src")
    out = pairs.join(found, ["src", "dst"], "left")
    hit = F.col("weight").isNotNull()
    return out.select("pos", "src", F.when(hit, F.col("dst")).otherwise(0).alias("dst"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("ts", F.lit(0)).cast("long").alias("ts"), hit.alias("found"))


def edges_of(edges: DataFrame, sources: DataFrame, nodes: DataFrame | None = None, now: int | None = None) -> DataFrame:
    """All edges of the given sources (id); with nodes and now, not those of expired ones."""
    wanted = live(sources.select("id").distinct(), nodes, now).withColumnRenamed("id", "src")
    return edges.join(wanted, "src", "left_semi").select("src", "dst", "weight", "ts")


def exists(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each (pos, id) with whether a node has that id."""
    have = nodes.select("id").distinct().withColumn("found", F.lit(True))
    return ids.join(have, "id", "left").select("pos", "id", F.coalesce("found", F.lit(False)).alias("found"))


def traverse_part(nodes: DataFrame, parts: int, part: int) -> DataFrame:
    """Ids of one of `parts` disjoint parts, expired ones too."""
    if not 0 <= part < parts:
        raise ValueError("part must lie in [0, parts)")
    return nodes.select("id").distinct().where(part_of(F.col("id"), parts) == part)


class NodePages:
    """A cursor over the parts of a node table: shard_id, then every shard_num-th part; ends once, then starts anew."""

    def __init__(self, nodes: DataFrame, part_size: int = 1024, shard_num: int = 1, shard_id: int = 0):
        self.nodes, self.shard_num, self.shard_id = nodes, shard_num, shard_id
        self.parts = max(1, -(-nodes.select("id").distinct().count() // part_size))
        self.at = shard_id

    def next(self) -> DataFrame:
        """The next part; an empty table when all are done."""
        if self.at >= self.parts:
            self.at = self.shard_id
            return self.nodes.select("id").limit(0)
        page = traverse_part(self.nodes, self.parts, self.at)
        self.at += self.shard_num
        return page


def exact_page(nodes: DataFrame, size: int, page: int) -> DataFrame:
    """Page `page` (from 0) of the ids in rising order, exactly `size` long but for the last.

    Rows before the page are counted by ranges of ids, so no task ranks them all.
    """
    placed = numbered(nodes.select("id").distinct()).withColumnRenamed("number", "place")
    return placed.where((F.col("place") >= page * size) & (F.col("place") < (page + 1) * size))


def numbered(ids: DataFrame) -> DataFrame:
    """(id, number): distinct ids numbered 0, 1, ... in rising order, by ranges that are numbered on their own.

    The ranges are written first: their bounds are drawn anew whenever they are evaluated again.
    """
    dealt = materialise(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    placed = dealt.join(F.broadcast(before), "part")  # one row a partition
    number = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    return placed.select("id", number.cast("long").alias("number"))


def reverse(edges: DataFrame) -> DataFrame:
    """The edges with source and destination exchanged."""
    other = {"src": "dst", "dst": "src"}
    return edges.select(*[F.col(c).alias(other.get(c, c)) for c in edges.columns])


def undirected(edges: DataFrame) -> DataFrame:
    return union(edges, reverse(edges))


def reindex(ids: DataFrame, column: str = "id") -> DataFrame:
    """Distinct ids with labels 0, 1, ... in rising order."""
    return numbered(ids.select(F.col(column).alias("id")).distinct()).withColumnRenamed("number", "label")


def subgraph(nodes: DataFrame, hops: list[tuple[str, DataFrame, int]], strategy: str = "most_recent") -> DataFrame:
    """One hop of a bipartite subgraph: for each (edge type, reverse edges, fanout) the sampled pairs (edge_type, neighbour, node)."""
    from tidegraph.operators.sampling import sample_neighbors

    out = None
    for name, edges, fanout in hops:
        found = sample_neighbors(nodes, edges, strategy, fanout, "zero", drop_padding=True)
        rows = found.select(F.lit(name).alias("edge_type"), F.col("dst").alias("neighbour"), F.col("src").alias("node"))
        out = rows if out is None else union(out, rows)
    return out


def label_pairs(positives: DataFrame, negatives: DataFrame, k: int) -> DataFrame:
    """(pos, src, dst, label): each sampled pair with label 1, and the k negatives at places pos * k to pos * k + k - 1 with label 0."""
    pos = positives.select(F.col("seed_pos").alias("pos"), "src", "dst", F.lit(1).alias("label"))
    own = positives.select(F.col("seed_pos").alias("pos"), "src")
    neg = negatives.select(F.floor(F.col("draw") / k).cast("long").alias("pos"), F.col("id").alias("dst"))
    return union(pos, own.join(neg, "pos").select("pos", "src", "dst", F.lit(0).alias("label")))
