"""Neighbour sampling: per seed, `fanout` slots filled from the seed's edges.

Seeds are (seed_pos, id); edges are (src, dst, weight, ts, seq). A source's list is at most the
relation's edge_max_num long, so what is ranked within one source stays small; seeds repeat
freely, each draws on its own. Strategies that don't draw rank each source's edges once, and
only the first `fanout` of them travel to the seeds.

The result has every slot: seed_pos, src, draw (0 to fanout - 1), dst, ts, weight, padded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.scalars import uniform
from tidegraph.operators.lookup import live
from tidegraph.schema import PADDINGS, STRATEGIES, choose

SLOT = "array<struct<dst:bigint,ts:bigint,weight:double>>"


def select_edges(edges: DataFrame, max_ts: int = 0, min_ts: int = 0, min_weight: float = 0.0, elst: str = "cpt") -> DataFrame:
    """Edges within the time range and of the least weight; 0 turns a filter off.

    A cdf list takes min_ts itself out of the range and has no weight filter.
    """
    if max_ts:
        edges = edges.where(F.col("ts") <= max_ts)
    if min_ts:
        edges = edges.where(F.col("ts") > min_ts if elst == "cdf" else F.col("ts") >= min_ts)
    if min_weight and elst != "cdf":
        edges = edges.where(F.col("weight") >= min_weight)
    return edges


def _orders(strategy: str) -> list[Column]:
    if strategy == "most_recent":
        return [F.desc("ts"), F.desc("seq"), F.asc("dst")]
    if strategy == "least_recent":
        return [F.asc("ts"), F.asc("seq"), F.asc("dst")]
    return [F.desc("weight"), F.asc("dst"), F.asc("seq")]


def _ranked(seeds: DataFrame, edges: DataFrame, strategy: str, fanout: int) -> DataFrame:
    """(src, slots): the first edges of each source that is a seed."""
    wanted = edges.join(seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(*_orders(strategy)))
    first = wanted.withColumn("rank", rank).where(F.col("rank") <= fanout)
    return _slots(first, "src")


def _slots(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, rank, dst, ts, weight) as one sorted array a key."""
    item = F.struct("rank", "dst", "ts", "weight")
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("found"))
    return packed.select(key, F.transform("found", lambda x: F.struct(x["dst"].alias("dst"), x["ts"].alias("ts"), x["weight"].alias("weight"))).alias("slots"))


def _numbered(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of seed sources with place (from 1), count, the weight before and up to each, and the total, all in the order (dst, seq)."""
    wanted = edges.join(seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    order = Window.partitionBy("src").orderBy("dst", "seq")
    every = Window.partitionBy("src")
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return wanted.select(
        "src", "dst", "ts", "weight", F.row_number().over(order).alias("place"), F.count("*").over(every).alias("n"),
        before.alias("before"), upto.alias("upto"), F.sum("weight").over(every.orderBy("dst", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )


def _drawn(seeds: DataFrame, edges: DataFrame, strategy: str, fanout: int, seed: int) -> DataFrame:
    """With replacement: (seed_pos, slots)."""
    numbered = _numbered(seeds, edges)
    sums = numbered.groupBy("src").agg(F.first("n").alias("n"), F.first("total").alias("total"))
    draws = seeds.join(sums, seeds["id"] == sums["src"]).select("seed_pos", "src", "n", "total", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("draw"))
    draws = draws.withColumn("u", uniform(F.col("seed_pos"), F.col("src"), F.lit(seed), F.col("draw")))
    if strategy == "random":
        draws = draws.withColumn("place", F.least(F.floor(F.col("u") * F.col("n")) + 1, F.col("n")).cast("int"))
        met = draws.select("seed_pos", "src", "draw", "place").join(numbered.select("src", "place", "dst", "ts", "weight"), ["src", "place"])
    else:
        draws = draws.select("seed_pos", F.col("src").alias("s"), "draw", (F.col("u") * F.col("total")).alias("mark"))
        inside = (F.col("mark") > F.col("before")) & (F.col("mark") <= F.col("upto"))
        met = draws.join(numbered, (F.col("s") == F.col("src")) & inside)
    return _slots(met.select("seed_pos", F.col("draw").alias("rank"), "dst", "ts", "weight"), "seed_pos")


def _picked(seeds: DataFrame, edges: DataFrame, strategy: str, fanout: int, seed: int) -> DataFrame:
    """Without replacement: the edges with the smallest keys; for 'weight' exponential keys, so that
    the order of the keys is that of drawing one by one in proportion to the weights."""
    met = seeds.join(edges, seeds["id"] == edges["src"])
    key = uniform(F.col("src"), F.col("dst"), F.lit(seed), F.col("seed_pos"))
    if strategy == "weight":
        key = -F.log(key) / F.col("weight")
    rank = F.row_number().over(Window.partitionBy("seed_pos").orderBy(key, "dst", "seq"))
    met = met.select("seed_pos", "dst", "ts", "weight", rank.alias("rank")).where(F.col("rank") <= fanout)
    return _slots(met, "seed_pos")


def fill(seeds: DataFrame, fanout: int, padding: str) -> DataFrame:
    """Seeds with slots (null: none) as `fanout` rows each."""
    choose(padding, PADDINGS, "padding")
    have = F.coalesce("slots", F.array().cast(SLOT))
    zero = F.lit(0).cast("long")

    def empty(dst: Column) -> Column:
        return F.struct(dst.cast("long").alias("dst"), zero.alias("ts"), F.lit(0.0).alias("weight"))

    def slot(j: Column) -> Column:
        if padding == "neigh_loop":
            pad = F.coalesce(F.get(have, j % F.greatest(F.size(have), F.lit(1))), empty(F.col("id")))
        else:
            pad = empty(F.col("id") if padding == "self" else zero)
        return F.struct(j.alias("draw"), F.coalesce(F.get(have, j), pad).alias("e"), (j >= F.size(have)).alias("padded"))

    each = seeds.select("seed_pos", F.col("id").alias("src"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), slot)).alias("s"))
    return each.select("seed_pos", "src", "s.draw", "s.e.dst", "s.e.ts", "s.e.weight", "s.padded")


def sample_neighbors(
    seeds: DataFrame, edges: DataFrame, strategy: str = "random", fanout: int = 1, padding: str = "self", *,
    without_replacement: bool = False, max_ts: int = 0, min_ts: int = 0, min_weight: float = 0.0, elst: str = "cpt", seed: int = 1,
    drop_padding: bool = False, nodes: DataFrame | None = None, now: int | None = None,
) -> DataFrame:
    """Sample `fanout` neighbours of each seed. drop_padding leaves padded slots out.

    With nodes and now, a seed whose node is expired finds nothing, as one that is not there.
    """
    choose(strategy, STRATEGIES, "strategy")
    if fanout < 1:
        raise ValueError("fanout must be positive")
    if elst == "cdf" and strategy == "topn_weight":
        raise ValueError("a cdf list has no order by weight")
    kept, alive = select_edges(edges, max_ts, min_ts, min_weight, elst), live(seeds, nodes, now)
    if strategy in ("most_recent", "least_recent", "topn_weight"):
        slots = _ranked(alive, kept, strategy, fanout)
        met = seeds.join(slots, seeds["id"] == slots["src"], "left").select("seed_pos", "id", "slots")
    else:
        draw = _picked if without_replacement and elst != "cdf" else _drawn
        met = seeds.join(draw(alive, kept, strategy, fanout, seed), "seed_pos", "left")
    out = fill(met, fanout, padding)
    return out.where("not padded") if drop_padding else out


def next_seeds(layer: DataFrame, fanout: int) -> DataFrame:
    """All slots of a layer as seeds of the next hop, padded ones too."""
    return layer.select((F.col("seed_pos") * fanout + F.col("draw")).alias("seed_pos"), F.col("dst").alias("id"))


def as_of(edges: DataFrame, t: int) -> DataFrame:
    """The latest edge of each source up to a time."""
    last = edges.where(F.col("ts") <= t).groupBy("src").agg(F.max(F.struct("ts", "seq", "dst", "weight")).alias("e"))
    return last.select("src", "e.dst", "e.ts", "e.weight")
