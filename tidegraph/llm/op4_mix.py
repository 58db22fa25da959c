"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each source gets a share of all words by its weight (5, 2, 1, repeating over the sources in
code-point order, null last), at most CAP times its own size; what a capped source cannot
take is shared again by weight. Document rates r = exp(lambda_source), at most CAP, minimise
the relative entropy of the mix's words to the corpus's words under one token constraint a
source; Newton iterations on the convex dual, over the table of sources, find lambda. Rates become copies:
floor(r) copies of each document, then one more for documents in the order of a hash of
their id until their source's words are nearest to its target.

Defined results: a null text has size 0 and is never repeated; a source without words has
target 0; repeated rows are separate documents, and rows alike in id and text are taken
together by the last step; a very long text is one document, which a source's words may miss their
target by; an empty table gives an empty table; extra columns are ignored
by the digest and kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import materialise, read, scratch_dir

CAP = 3
WEIGHTS = (5, 2, 1)
#: Newton ends when each source's words differ by less than this share from its target.
TOLERANCE = 1e-12
MAX_STEPS = 60
#: Up to so many sources their table is broadcast; beyond it is shuffled.
BROADCAST_SOURCES = 100_000
#: Bins of the id's hash in which a source's words are summed to find its last copies.
BINS = 4096


def size_of(text: Column) -> Column:
    """Words of a text (null: 0): places where one begins."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column, text: Column) -> Column:
    """48 bits of md5 of the id and the text's md5: the same for the same document in every run."""
    both = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 12), 16, 10).cast("long")


def ranked(sources: DataFrame, where: str) -> DataFrame:
    """sources with their rank from 0 in code-point order, null last: range partitions, then an offset each."""
    parts = sources.repartitionByRange(F.col("source").isNull(), F.col("source").asc_nulls_last())
    parts = materialise(parts.withColumn("part", F.spark_partition_id()), "sources", where)
    counts = parts.groupBy("part").count()
    before = counts.withColumn("first", F.sum("count").over(Window.orderBy("part")) - F.col("count")).drop("count")
    within = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return parts.join(before, "part").withColumn("rank", F.col("first") + F.row_number().over(within) - 1).drop("part", "first")


def water_fill(sources: DataFrame) -> DataFrame:
    """Adds target: shares by weight, no source above CAP times its size. Each pass is one sum over the sources."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = CAP * F.col("source_size")
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else cap < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum(F.when(over, cap).otherwise(0)).alias("fixed"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("free"),
            F.count_if(over).alias("n"),
        ).first()
        if not row["free"] or row["n"] == capped:
            break
        level, capped = (total - row["fixed"]) / row["free"], row["n"]
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level or 0.0))))


def attach(docs: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Join on source, null to null. The sources are broadcast only up to BROADCAST_SOURCES."""
    side = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    return docs.join(side, docs["source"].eqNullSafe(sources["source"]), "left").drop(sources["source"])


def solve(sources: DataFrame, where: str) -> DataFrame:
    """Adds tilt (lambda) to the sources.

    Dual: sum over documents of size * exp(lambda) minus sum over sources of lambda * target.
    All documents of a source have one lambda, so the sums over documents that a Newton step needs
    are source_size * exp(lambda): documents are summed once, steps run over the sources. Steps fall
    to the solution from above after the first one; MAX_STEPS without it raise RuntimeError.
    """
    sources = sources.withColumn("tilt", F.lit(0.0))
    for step in range(MAX_STEPS):
        mass = F.col("source_size") * F.exp("tilt")
        gap = mass - F.col("target")
        moved = F.when(mass > 0, F.least(F.col("tilt") - gap / mass, F.col("tilt") + 2.0)).otherwise(0.0)
        share = F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))
        sources = materialise(sources.withColumn("gap", share).withColumn("tilt", moved), f"tilt{step}", where)
        if (sources.agg(F.max("gap")).first()[0] or 0.0) < TOLERANCE:
            return sources.drop("gap")
        sources = sources.drop("gap")
    raise RuntimeError(f"no weights after {MAX_STEPS} Newton steps")


def plan(small: DataFrame) -> tuple[DataFrame, int]:
    """From documents (source, size, u): the sources with source_size, target, whole and until, and their number."""
    where = scratch_dir(small.sparkSession)
    sources = small.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = ranked(sources, where)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    sources = materialise(water_fill(sources.withColumn("weight", weight)).drop("rank", "weight"), "targets", where)
    n_sources = sources.count()
    sources = solve(sources, where)
    # a rate a hair below a whole number is that number
    rate = F.least(F.round(F.exp("tilt"), 9), F.lit(float(CAP)))
    whole = F.when(F.col("source_size") > 0, F.floor(rate)).otherwise(0).cast("long")
    sources = sources.select("source", "source_size", "target", whole.alias("whole"))
    sources = sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    limits = last_copies(small, sources, n_sources)
    return materialise(attach(sources, limits, n_sources), "limits", where), n_sources


def with_copies(docs: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """docs (source, size, u, and any others) with source_size, target and n_copies."""
    out = attach(docs, sources, n_sources)
    extra = (F.col("u") < F.col("until")) & (F.col("whole") < CAP) & (F.col("size") > 0)
    return out.withColumn("n_copies", F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")).drop("whole", "rest", "until")


def last_copies(docs: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """(source, until): documents with u below `until` get one copy more.

    Words are summed in bins of u first; only the bin in which a source's rest runs out is
    then ordered document by document, BINS times fewer rows than the source has.
    """
    width = (1 << 48) // BINS
    keyed = attach(docs.where("size > 0"), sources.select("source", "rest"), n_sources).where("rest > 0")
    keyed = keyed.withColumn("bin", F.floor(F.col("u") / width).cast("int"))
    bins = keyed.groupBy("source", "rest", "bin").agg(F.sum("size").alias("size"))
    run = Window.partitionBy("source").orderBy("bin")
    bins = bins.withColumn("before", F.sum("size").over(run) - F.col("size"))
    cross = bins.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest")))
    cross = cross.select("source", "bin", "before", "rest")
    side = F.broadcast(cross) if n_sources <= BROADCAST_SOURCES else cross
    near = docs.where("size > 0").withColumn("bin", F.floor(F.col("u") / width).cast("int"))
    same = near["source"].eqNullSafe(cross["source"]) & (near["bin"] == cross["bin"])
    near = near.join(side, same).select(near["source"], "u", "size", "before", "rest")
    near = near.groupBy("source", "u", "before", "rest").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("u"))
    near = near.withColumn("upto", F.col("before") + upto)
    # a document whose middle lies below the target brings the sum nearer to it
    taken = F.when(F.col("upto") - F.col("size") / 2 <= F.col("rest"), F.col("u") + 1)
    found = near.groupBy("source").agg(F.coalesce(F.max(taken), F.min("u")).alias("until"))
    everything = sources.select("source", F.when(F.col("rest") >= F.col("source_size"), F.lit(1 << 48)).otherwise(F.lit(0)).cast("long").alias("all_or_none"))
    return attach(everything, found, n_sources).select("source", F.coalesce("until", "all_or_none").alias("until"))


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), order_key(F.col(id_col), F.col(text)).alias("u"))


def mix_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, n_copies, taken."""
    small = materialise(sized(docs), "sizes")
    out = with_copies(small, *plan(small))
    return out.select("doc_id", "source", "size", "source_size", "target", "n_copies", (F.col("size") * F.col("n_copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as many times as it has copies, with the columns of docs."""
    sources, n_sources = plan(materialise(sized(docs), "sizes"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select("source", size_of(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text")).alias("u"), row)
    out = with_copies(keyed, sources, n_sources).where("n_copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int")))).select("row.*")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(read(spark, sf_dir, "documents", "doc_id", "source", "text"))
