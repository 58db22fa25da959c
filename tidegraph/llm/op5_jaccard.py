"""N-gram Jaccard join of whole texts by chosen paths.

A text's set are the 64-bit hashes of its runs of SHINGLE words ([^\\x20\\x09-\\x0D]+, A-Z lowered);
a text of fewer words has one, of all its words. Texts of equal sets form a class of copies,
which the join treats as one set with a multiplicity.

In each of RUNS runs a set of n tokens chooses the tokens whose hash for the run lies below
BRANCH / n: similar sets choose alike, so they meet in the bucket of a shared token. A bucket
of more than SMALL sets is split again by tokens chosen by their hash for its path, unless a child
holds half of it (its sets are alike, splitting does not help) or LEVELS are reached. Buckets are
then compared by brute force, large ones in pairs of blocks of BLOCK sets, and every pair is counted
in the first bucket that both sets share.

Sets of similarity 0.8 share at least 1.6 chosen tokens a bucket in the mean, and buckets choose
independently, so a run loses a pair with a chance of at most q(1) = e**-1.6 at the first level and
q(k) = e**(-1.6 (1 - q(k - 1))) at level k. RUNS are as many as keep the chance that all of them
lose it below 1 - RECALL at the deepest level.

Results: per row its class_id (the smallest doc_id among the texts that links join, directly or
through others) and n_links (other rows whose sets have a similarity of at least 0.8, copies
included). Defined results: a null text or one without words has no links and is its own
class; repeated rows are copies of each other; a null doc_id sorts before others; a very long
text is compared as a whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import arrow_rows, materialise, read, release_memory, scratch_dir, steps
from tidegraph.llm.components import components
from tidegraph.llm.words import mix, scan, windows

SHINGLE = 5
#: Similarity as a fraction: 4 / 5.
NUMERATOR, DENOMINATOR = 4, 5
LEVELS, BRANCH = 3, 2.0
#: Least chance of each link to be found, also of one whose buckets are split at all levels.
RECALL = 0.9999
SMALL = 64
BLOCK = 1024
#: Bytes kept of a token's hash where sets are compared.
TOKEN_BYTES = 5
#: Cells of a dense block of sets by tokens.
CELLS = 1 << 22
#: Tokens by paths of a step in which crowded buckets choose.
CHOICES = 1 << 17


def run_loss(levels: int) -> float:
    """A bound on the chance that a run loses a pair of the least similarity, if all buckets are split down to a level."""
    lost = 0.0
    for _ in range(levels):
        lost = math.exp(-BRANCH * NUMERATOR / DENOMINATOR * (1 - lost))
    return lost


RUNS = math.ceil(math.log(1 - RECALL) / math.log(run_loss(LEVELS)))
_SEEDS = mix(np.arange(1, RUNS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def token_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of each text's set, sorted, one text after another, and the texts' bounds."""
    w = scan(texts)
    h, n = w.hashes(lower=True), len(texts)
    counts, doc = w.counts, w.doc
    runs = windows(h, width)
    whole = np.flatnonzero(doc[: len(runs)] == doc[width - 1 :]) if len(runs) else np.zeros(0, np.int64)
    tokens, owner = runs[whole], doc[whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = [mix(np.bitwise_xor.reduce(mix(h[w.doc_start[i] : w.doc_start[i + 1]] + np.arange(1, counts[i] + 1, dtype=np.uint64)))[None])[0] for i in short]
        tokens, owner = np.concatenate([tokens, np.array(own, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    if len(tokens):
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        tokens, owner = tokens[new], owner[new]
    return tokens, np.searchsorted(owner, np.arange(n + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


SETS_SCHEMA = "row long, doc_id long, key long, n long, d1 long, d2 long, chosen array<long>"


def limits(sizes: np.ndarray) -> np.ndarray:
    """The hashes up to which sets of these sizes choose tokens."""
    share = np.minimum(BRANCH / np.maximum(sizes, 1), 1.0)
    limit = np.minimum(share * 2.0**64, 2.0**64 - 2048).astype(np.uint64)
    limit[share >= 1] = np.uint64(2**64 - 1)
    return limit


def further_paths(tokens: np.ndarray, bounds: np.ndarray, at: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The paths by which set at[i] leaves bucket paths[i]: each one's i, and the path."""
    sizes, seeds = np.diff(bounds), mix(paths ^ np.uint64(0xD1B54A32D192ED03))
    limit, total = limits(sizes), np.concatenate([[0], np.cumsum(sizes[at])])
    which, out, first = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while first < len(at):
        stop = max(first + 1, int(np.searchsorted(total, total[first] + CHOICES, side="right")) - 1)
        n = sizes[at[first:stop]]
        i = np.repeat(np.arange(first, stop), n)
        place = np.arange(len(i)) + np.repeat(bounds[at[first:stop]] - (total[first:stop] - total[first]), n)
        mixed = mix(tokens[place] ^ seeds[i])
        hit = np.flatnonzero(mixed <= limit[at[i]])
        which.append(i[hit])
        out.append(mix(mixed[hit] + seeds[i[hit]]))
        first = stop
    return np.concatenate(which), np.concatenate(out)


def describe(docs: DataFrame) -> DataFrame:
    """Per row: a row number, the text's hash, its set's size and 128-bit digest, and the tokens chosen in all runs."""
    arrow_rows(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, texts in steps(batch, "text"):
                tokens, bounds = token_sets(texts)
                sizes, n = np.diff(bounds), len(texts)
                limit, owner = np.repeat(limits(sizes), sizes), np.repeat(np.arange(n), sizes)
                slots, values = [], []
                for seed in _SEEDS:
                    mixed = mix(tokens ^ seed)
                    at = np.flatnonzero(mixed <= limit)
                    slots.append(owner[at])
                    values.append(mixed[at])
                slot, value = np.concatenate(slots), np.concatenate(values)
                order = np.argsort(slot, kind="stable")
                inner = np.searchsorted(slot[order], np.arange(n + 1))
                chosen = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(value[order].view(np.int64)))
                d1 = _sums(mix(tokens + np.uint64(1)), bounds)
                d2 = _sums(mix(tokens ^ np.uint64(0xA0761D6478BD642F)), bounds)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), part.column(0), part.column(1), pa.array(sizes), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), chosen], names=[x.split(" ")[0] for x in SETS_SCHEMA.split(", ")])
                row += n

    return src.mapInArrow(run, SETS_SCHEMA)


def _sized(members: DataFrame, *more) -> DataFrame:
    """(path, size, mark): buckets of two sets and more, and a mark that only buckets of equal members share."""
    found = members.groupBy("path").agg(F.count("*").alias("size"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("mark"), *more)
    return found.where("size > 1")


def with_texts(docs: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (row, ...) with copies and text; rows alike in id and text come once for each of them."""
    needed = rows.join(reps.select("row", "copies", F.col("doc_id").alias("d"), F.col("key").alias("k")), "row")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return texts.join(needed, texts["doc_id"].eqNullSafe(F.col("d")) & (texts["key"] == F.col("k")))


def branches(docs: DataFrame, reps: DataFrame, large: DataFrame) -> DataFrame:
    """(row, level, parent, path): the paths of all further levels below large (row, path)."""
    crowded = with_texts(docs, reps, large.groupBy("row").agg(F.collect_list("path").alias("paths"))).select("row", "paths", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            for part, texts in steps(batch, "text"):
                tokens, bounds = token_sets(texts)
                rows, lists = part.column(0).to_numpy(), part.column(1)
                paths = lists.flatten().to_numpy().view(np.uint64)
                at = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
                for level in range(2, LEVELS + 1):
                    above, path = further_paths(tokens, bounds, at, paths)
                    at, parent, paths = at[above], paths[above], path
                    yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(np.full(len(at), level, np.int32)), pa.array(parent.view(np.int64)), pa.array(paths.view(np.int64))], names=["row", "level", "parent", "path"])

    return crowded.mapInArrow(run, "row long, level int, parent long, path long").distinct()


def chosen_buckets(docs: DataFrame, reps: DataFrame, where: str) -> DataFrame:
    """(row, path, size): the buckets to compare by brute force, each set of members once."""
    members = materialise(reps.select("row", F.explode("chosen").alias("path")), "members1", where)
    sizes = materialise(_sized(members), "sizes1", where)
    leaves = []
    for level in range(1, LEVELS + 1):
        inside = members.join(sizes, "path")
        leaves.append(inside.where(F.col("size") <= SMALL).select("row", "path", "size", "mark"))
        large = materialise(inside.where(F.col("size") > SMALL), f"large{level}", where)
        if level == LEVELS or large.isEmpty():
            leaves.append(large.select("row", "path", "size", "mark"))
            break
        if level == 1:
            below = materialise(branches(docs, reps, large), "branches", where)
        parents = large.select(F.col("path").alias("parent"), F.col("size").alias("parent_size")).distinct()
        children = below.where(F.col("level") == level + 1).join(parents, "parent").select("row", "parent", "parent_size", "path")
        children = materialise(children, f"members{level + 1}", where)
        sized = materialise(_sized(children, F.first("parent").alias("parent"), F.first("parent_size").alias("parent_size")), f"sizes{level + 1}", where)
        alike = sized.where(2 * F.col("size") >= F.col("parent_size")).select("parent").distinct()
        leaves.append(large.join(alike, large["path"] == alike["parent"], "left_semi").select("row", "path", "size", "mark"))
        members = children.select("row", "path")
        sizes = sized.join(alike, "parent", "left_anti").select("path", "size", "mark")
    every = leaves[0]
    for more in leaves[1:]:
        every = every.unionByName(more)
    every = materialise(every, "leaves", where)
    once = every.groupBy("size", "mark").agg(F.min("path").alias("path")).select("path")
    return every.join(once, "path", "left_semi").select("row", "path", "size").distinct()


def pack_tokens(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def unpack_tokens(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, TOKEN_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :TOKEN_BYTES] = raw
    return out.reshape(-1).view("<u8")


def shared_tokens(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections of left with right (None: with left itself)."""
    sets = left + (right or [])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, seen = np.unique(flat, return_inverse=True, return_counts=True)
    common = seen > 1
    place = np.cumsum(common) - 1
    keep = common[inverse]
    owner, token = owner[keep], place[inverse[keep]]
    n_tokens = int(common.sum())
    out = np.zeros((len(left), len(right) if right is not None else len(left)), np.float32)
    width = max(1, CELLS // len(sets))
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    for first in range(0, n_tokens, width):
        a, b = np.searchsorted(token, [first, first + width])
        cells = np.zeros((len(sets), min(width, n_tokens - first)), np.float32)
        cells[owner[a:b], token[a:b] - first] = 1
        out += cells[: len(left)] @ (cells[len(left) :] if right is not None else cells).T
    return out.astype(np.int32)


def _owned_elsewhere(path: int, a: list[list[int]], b: list[list[int]], out: np.ndarray) -> None:
    """Clear the pairs that meet in a bucket before this one."""
    earlier: dict[int, tuple[list[int], list[int]]] = {}
    for side, paths in ((0, a), (1, b)):
        for i, own in enumerate(paths):
            for p in own:
                if p < path:
                    earlier.setdefault(p, ([], []))[side].append(i)
    for left, right in earlier.values():
        if left and right:
            out[np.ix_(left, right)] = False


def smallest_reached(linked: np.ndarray, row_a: np.ndarray, row_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest row that links between two blocks reach from each row of either; every row is visited once."""
    rows = np.concatenate([row_a, row_b])
    label, n = rows.copy(), len(row_a)
    seen_a, seen_b = ~linked.any(axis=1), ~linked.any(axis=0)
    for i in np.argsort(rows, kind="stable").tolist():
        if seen_a[i] if i < n else seen_b[i - n]:
            continue
        at_a, at_b = (np.array([i]), np.zeros(0, np.int64)) if i < n else (np.zeros(0, np.int64), np.array([i - n]))
        while len(at_a) or len(at_b):
            seen_a[at_a], seen_b[at_b] = True, True
            label[at_a], label[n + at_b] = rows[i], rows[i]
            at_a, at_b = np.flatnonzero(linked[:, at_b].any(axis=1) & ~seen_a), np.flatnonzero(linked[at_a].any(axis=0) & ~seen_b)
    return label[:n], label[n:]


def compare(path: int, rows: list[tuple]) -> list[tuple[int, int, int]]:
    """Links within a bucket, or between two of its blocks.

    rows: (row, copies, paths, tokens, side); side 0 and 1 are the blocks. Returns
    (row, smallest row that links here reach from it, or its smallest linked row where it is that
    itself, other rows linked in pairs counted here): these edges join all that the links join.
    """
    a = [r for r in rows if r[4] == 0]
    b = [r for r in rows if r[4] == 1] or None
    right = b or a
    inter = shared_tokens([r[3] for r in a], None if b is None else [r[3] for r in b])
    size_a, size_b = (np.array([len(r[3]) for r in x], np.int32) for x in (a, right))
    # shared / (a + b - shared) >= NUMERATOR / DENOMINATOR
    linked = (DENOMINATOR + NUMERATOR) * inter >= NUMERATOR * (size_a[:, None] + size_b[None, :])
    del inter
    if b is None:
        np.fill_diagonal(linked, False)
    _owned_elsewhere(path, [r[2] for r in a], [r[2] for r in right], linked)
    if not linked.any():
        return []
    row_a, row_b = (np.array([r[0] for r in x]) for x in (a, right))
    copies_a, copies_b = (np.array([r[1] for r in x]) for x in (a, right))
    top = np.iinfo(np.int64).max
    links_a = linked @ copies_b
    low_a = np.where(linked, row_b[None, :], top).min(axis=1)
    out = [(int(row_a[i]), int(low_a[i]), int(links_a[i])) for i in np.flatnonzero(links_a)]
    if b is not None:
        links_b = copies_a @ linked
        label_a, label_b = smallest_reached(linked, row_a, row_b)
        low_b = np.where(linked, row_a[:, None], top).min(axis=0)
        out = [(r, int(label_a[i]) if label_a[i] != r else low, k) for (r, low, k), i in zip(out, np.flatnonzero(links_a), strict=True)]
        return out + [(int(row_b[i]), int(label_b[i] if label_b[i] != row_b[i] else low_b[i]), int(links_b[i])) for i in np.flatnonzero(links_b)]
    # the smallest neighbours alone may leave a group in parts: add each row's smallest reachable one
    label = np.minimum(row_a, low_a)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], top).min(axis=1))
        if (new == label).all():
            break
        label = new
    return [(r, int(label[i]) if label[i] != r else low, k) for (r, low, k), i in zip(out, np.flatnonzero(links_a), strict=True)]


def find_links(docs: DataFrame, reps: DataFrame, buckets: DataFrame) -> DataFrame:
    """(row, peer, links): compare the sets of each bucket; copies of one pair count by their number."""
    needed = buckets.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("path", "size"))).alias("buckets"))
    met = with_texts(docs, reps, needed)
    met = met.select("row", "copies", F.col("buckets.path").alias("paths"), F.col("buckets.size").alias("sizes"), "text")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            for part, texts_ in steps(batch, "text"):
                tokens, bounds = token_sets(texts_)
                out: list[tuple] = []
                held = 0
                for i, (row, copies, paths, sizes) in enumerate(zip(*(part.column(j).to_pylist() for j in range(4)), strict=True)):
                    packed = pack_tokens(tokens[bounds[i] : bounds[i + 1]])
                    for path, size in zip(paths, sizes, strict=True):
                        blocks = -(-size // BLOCK)
                        own = int(mix(np.array([row], np.uint64))[0] % np.uint64(blocks))
                        for other in range(blocks):
                            low, high = min(own, other), max(own, other)
                            block = low * blocks + high if low != high else -1 - own
                            out.append((path, block, int(own == high and low != high), row, copies, paths, packed))
                            held += len(packed)
                            if held > 4 << 20:
                                yield _spread_batch(out)
                                out, held = [], 0
                if out:
                    yield _spread_batch(out)

    dealt = met.mapInArrow(spread, "path long, block long, side int, row long, copies long, paths array<long>, tokens binary")
    dealt = dealt.repartition("path", "block").sortWithinPartitions("path", "block")

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        now, rows, seen = None, [], set()

        def done() -> Iterator[pa.RecordBatch]:
            # a block compared with one that has no rows has no pairs; negative: one block by itself
            if len(rows) > 1 and (now[1] < 0 or len({r[4] for r in rows}) == 2):
                found = compare(now[0], rows)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["row", "peer", "links"])

        for batch in batches:
            c = [batch.column(j).to_pylist() for j in range(7)]
            for path, block, side, row, copies, paths, packed in zip(*c, strict=True):
                if (path, block) != now:
                    yield from done()
                    now, rows, seen = (path, block), [], set()
                if row not in seen:  # rows alike in id and text come once for each of them
                    seen.add(row)
                    rows.append((row, copies, paths, unpack_tokens(packed), side))
        yield from done()

    return dealt.mapInArrow(brute, "row long, peer long, links long")


def _spread_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
    names = ["path", "block", "side", "row", "copies", "paths", "tokens"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def classes(docs: DataFrame) -> DataFrame:
    """Per row of docs: row, doc_id, key (the text's hash), class_id, n_links, and first (it stands for its class)."""
    where = scratch_dir(docs.sparkSession)
    sets = materialise(describe(docs), "sets", where)
    some = sets.where("n > 0")
    groups = some.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.count("*").alias("copies"))
    groups = groups.select("d1", "d2", "n", F.col("least.row").alias("rep"), F.col("least.doc_id").alias("least_id"), "copies")
    groups = materialise(groups, "groups", where)
    reps = some.join(groups.select(F.col("rep").alias("row"), "copies"), "row").select("row", "doc_id", "key", "copies", "chosen")
    reps = materialise(reps, "reps", where)
    buckets = materialise(chosen_buckets(docs, reps, where), "buckets", where)
    links = materialise(find_links(docs, reps, buckets), "links", where)
    counted = links.groupBy("row").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("row").alias("a"), F.col("peer").alias("b")))
    named = joined.join(reps.select(F.col("row").alias("node"), "doc_id"), "node")
    least = named.groupBy("component").agg(F.min(F.struct("doc_id", F.col("node").alias("row"))).alias("least"))
    named = named.join(least, "component").select("node", "least")
    out = groups.join(counted, groups["rep"] == counted["row"], "left").join(named, groups["rep"] == named["node"], "left")
    out = out.select(
        "d1", "d2", "n", F.coalesce("least", F.struct(F.col("least_id").alias("doc_id"), F.col("rep").alias("row"))).alias("least"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    out = materialise(out, "classes", where)
    members = some.select("row", "doc_id", "key", "d1", "d2", "n").join(out, ["d1", "d2", "n"])
    members = members.select("row", "doc_id", "key", F.col("least.doc_id").alias("class_id"), "n_links", (F.col("row") == F.col("least.row")).alias("first"))
    alone = sets.where("n = 0").select("row", "doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return members.unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their class, with all their columns.

    Of rows alike in doc_id and text the one stays that is the first as JSON.
    """
    kept = classes(docs).where("first").select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    found = own.join(kept, own["id"].eqNullSafe(kept["kept_id"]) & (own["key"] == kept["kept_key"]), "left_semi")
    again = own.groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("again_id"), F.col("key").alias("again_key"))
    repeated = found["id"].eqNullSafe(again["again_id"]) & (found["key"] == again["again_key"])
    single = found.join(again, repeated, "left_anti").select("row")
    several = found.join(again, repeated, "left_semi").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.unionByName(several).select("row.*")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id", "n_links")
