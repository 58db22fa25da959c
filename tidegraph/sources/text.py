"""Loading relations from text: src|ints|floats|destinations a line.

Fields are separated by |, elements of node attributes and destinations by commas; a
destination is id, weight, ints, floats separated by \\x03, elements of its attributes by \\x04.
\\N stands for an empty field. A line without a source is bad and goes to a side table. A destination
of one part (an id) or two (id and weight) loads as well as one of all four; any other number of
parts makes that destination invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.scalars import path_time

PART, ITEM = "\u0003", "\u0004"


def _list(text: Column, separator: str, kind: str) -> Column:
    some = F.when((text != "") & (text != "\\N"), F.split(text, separator)).otherwise(F.array().cast("array<string>"))
    return F.transform(some, lambda x: x.try_cast(kind))


def parse_lines(lines: DataFrame, default_ts: Column) -> DataFrame:
    """Lines (value) as src, node_ints, node_floats, dests (array of edges) and ok."""
    field = F.split("value", r"\|")
    src = F.trim(F.get(field, 0)).try_cast("long")
    dests = F.coalesce(F.get(field, 3), F.lit(""))

    def dest(text: Column) -> Column:
        part = F.split(text, PART)
        return F.struct(
            F.get(part, 0).try_cast("long").alias("dst"), F.get(part, 1).try_cast("double").alias("weight"),
            _list(F.coalesce(F.get(part, 2), F.lit("")), ITEM, "long").alias("int_attrs"),
            _list(F.coalesce(F.get(part, 3), F.lit("")), ITEM, "float").alias("float_attrs"),
            F.size(part).isin(1, 2, 4).alias("valid"),
        )

    edges = F.when((dests != "") & (dests != "\\N"), F.transform(F.split(dests, ","), dest))
    edges = F.filter(F.coalesce(edges, F.array()), lambda e: e["valid"] & e["dst"].isNotNull() & (e["dst"] != 0))
    ok = src.isNotNull() & (src != 0) & (F.size(field) >= 3)
    return lines.select(
        "value", src.alias("src"), _list(F.coalesce(F.get(field, 1), F.lit("")), ",", "long").alias("node_ints"),
        _list(F.coalesce(F.get(field, 2), F.lit("")), ",", "float").alias("node_floats"), edges.alias("dests"), default_ts.alias("ts"), ok.alias("ok"),
    )


def edge_log(parsed: DataFrame) -> DataFrame:
    """A batch for fold: one row a destination, and one without a destination where a line has none."""
    good = parsed.where("ok").withColumn("line", F.monotonically_increasing_id())
    each = good.select("src", "node_ints", "node_floats", "ts", "line", F.posexplode_outer("dests").alias("place", "d"))
    seq = F.col("line") * 65536 + F.coalesce("place", F.lit(0))
    return each.select("src", F.coalesce("d.dst", F.lit(0)).alias("dst"), "d.weight", "ts", seq.alias("seq"), "d.int_attrs", "d.float_attrs", "node_ints", "node_floats")


def load_text(spark: SparkSession, path: str, now: int, ts_from_path: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edge log, bad lines) of a file or folder; times are `now`, or the dt= of each file's path."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    ts = path_time(F.col("file")) if ts_from_path else F.lit(now).cast("long")
    parsed = parse_lines(lines.withColumn("ts", ts), F.col("ts"))
    return edge_log(parsed), parsed.where("not ok").select("value")


def format_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges and nodes as text lines (value), the inverse of parse_lines."""

    def join(values: Column, separator: str) -> Column:
        own = F.coalesce(F.array_join(values.cast("array<string>"), separator), F.lit(""))
        return F.when(own == "", "\\N").otherwise(own)

    dest = F.concat_ws(PART, F.col("dst").cast("string"), F.col("weight").cast("string"), join(F.col("int_attrs"), ITEM), join(F.col("float_attrs"), ITEM))
    packed = edges.withColumn("text", dest).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("d"))
    out = nodes.join(packed, nodes["id"] == packed["src"], "left")
    dests = F.coalesce(F.array_join(F.transform("d", lambda x: x["text"]), ","), F.lit("\\N"))
    return out.select(F.concat_ws("|", F.col("id").cast("string"), join(F.col("int_attrs"), ","), join(F.col("float_attrs"), ","), dests).alias("value"))
