"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Each text becomes STATS statistics, standardised by the training rows. FEATURES random cosines
approximate a Gaussian kernel over them; partitions sum Z'Z and Z'y of the labelled training
rows and the driver solves one FEATURES x FEATURES system. Labelled training rows that a second
hash sets apart are not fitted; their labels, summed in BINS of the raw score, give a rising step
function (pool adjacent violators) that turns raw scores into shares of label 1.

Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0; a document with several
labels counts with their mean. Labels, lang, source and doc_id are never inputs of a score.

Defined results: a null or empty text has statistics of 0 and a score like any other; without
labels every score is 0.5; repeated rows are scored one by one; a very long text is measured
as a whole; an empty table gives an empty
table; extra columns are ignored; a null doc_id has no label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import arrow_rows, fold_of, materialise, read, scratch_dir, steps
from tidegraph.llm.op8_rules import Texts
from tidegraph.llm.words import per_text

FEATURES = 384
RIDGE = 1e-3
BINS = 1000
THRESHOLD = 0.3
#: Rows of Z'Z that one summed row carries, and the groups in which partitions are added up before the last sum.
BLOCK_ROWS = 48
GROUPS = 64

_CLASSES = (b"!?", b".,;:", b"|", b"0123456789", b"\n")
STATS = 13 + len(_CLASSES)


def statistics(texts: pa.Array) -> np.ndarray:
    """float32 [texts, STATS]."""
    t = Texts(texts)
    w, n = t.words, t.get("n_words").astype(np.float64)
    chars = np.maximum(t.get("word_chars"), 1)
    words = np.maximum(n, 1)
    letters = np.maximum(t.get("letters"), 1)
    h, doc = w.hashes(lower=True), w.doc
    distinct = np.zeros(t.n)
    most = np.zeros(t.n)
    if len(h):
        order = np.lexsort((h, doc))
        hs, ds = h[order], doc[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        at = np.flatnonzero(new)
        runs = np.diff(np.append(at, len(hs)))
        distinct = np.bincount(ds[at], minlength=t.n).astype(np.float64)
        np.maximum.at(most, ds[at], runs)
    columns = [
        np.log1p(n), chars / words, t.get("n_symbols") / words, t.get("upper") / letters, t.get("letters") / chars,
        t.get("n_dup_lines") / np.maximum(t.get("n_lines"), 1), t.get("n_repeat_words") / words, t.get("adjacent") / words,
        distinct / words, most / words, np.log1p(t.get("n_lines")), n / np.maximum(t.get("n_lines"), 1) / 20, np.minimum(n, 50) / 50,
    ]
    for some in _CLASSES:
        table = np.zeros(256, bool)
        table[list(some)] = True
        columns.append(per_text(table[w.data], w.text_start) / words)
    return np.stack(columns, axis=1).astype(np.float32)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fold (crc32 of the id mod 5) and stats of each row."""
    arrow_rows(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), fold_of(F.col(id_col)).cast("int").alias("fold"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, "text"):
                flat = pa.array(statistics(texts).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * STATS, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["doc_id", "fold", "stats"])

    return src.mapInArrow(run, "doc_id long, fold int, stats array<float>")


class Model:
    """The fitted classifier; a few MB, sent to the tasks that score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(7))
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((STATS, FEATURES)) / np.sqrt(STATS) * 1.2
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.at, self.level = np.array([0.0]), np.array([0.5])

    def lift(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / FEATURES)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.at, self.level), 0.0, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATS).astype(np.float64)


def isotonic(at: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising fit of total / weight over rising places: pool adjacent violators."""
    pools: list[list[float]] = []
    for x, t, w in zip(at, total, weight, strict=True):
        pools.append([x, x, t, w])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            _, x1, t1, w1 = pools.pop()
            pools[-1][1], pools[-1][2], pools[-1][3] = x1, pools[-1][2] + t1, pools[-1][3] + w1
    xs = [v for p in pools for v in ((p[0], p[1]) if p[1] > p[0] else (p[0],))]
    ys = [p[2] / p[3] for p in pools for _ in range(2 if p[1] > p[0] else 1)]
    return np.array(xs), np.array(ys)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows of stats whose fold is not 0; labels: doc_id, quality."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    rows = stats.where("fold <> 0").join(marks, "doc_id")
    rows = materialise(rows.select("stats", "y", (F.xxhash64("doc_id") % 5 == 0).alias("apart")), "labelled")
    parts = [F.struct(F.avg(F.get("stats", i)).alias("m"), F.stddev_pop(F.get("stats", i)).alias("s")).alias(f"f{i}") for i in range(STATS)]
    moments = rows.agg(*parts).first()
    if moments[0]["m"] is None:
        return Model(np.zeros(STATS), np.ones(STATS))
    model = Model(np.array([x["m"] for x in moments]), np.maximum(np.array([x["s"] for x in moments]), 1e-6))
    size = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = model.lift(_matrix(batch.column(0)))
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ batch.column(1).to_numpy()
        blocks = [total[i : i + BLOCK_ROWS].tobytes() for i in range(0, size, BLOCK_ROWS)]
        part = [TaskContext.get().partitionId() % GROUPS] * len(blocks)
        yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "block": pa.array(range(len(blocks)), pa.int32()), "sums": pa.array(blocks, pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        out = np.zeros(len(table.column("sums")[0].as_py()) // 8)
        for x in table.column("sums"):
            out += np.frombuffer(x.as_py())
        return pa.table({"part": table.column("part")[:1], "block": table.column("block")[:1], "sums": pa.array([out.tobytes()], pa.binary())})

    # a task adds up a block of one in GROUPS partitions, then one of the GROUPS sums
    kind = "part int, block int, sums binary"
    summed = rows.where("not apart").select("stats", "y").mapInArrow(sums, kind)
    got = summed.groupBy("part", "block").applyInArrow(merge, kind).groupBy("block").applyInArrow(merge, kind).collect()
    full = np.concatenate([np.frombuffer(r["sums"]).reshape(-1, size + 1) for r in sorted(got, key=lambda r: r["block"])])
    n = max(full[size - 1, size - 1], 1.0)
    penalty = np.full(size, RIDGE * n / FEATURES)
    penalty[-1] = 1e-9 * n
    model.beta = np.linalg.solve(full[:, :size] + np.diag(penalty), full[:, size])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column(0)))
            yield pa.RecordBatch.from_pydict({"bin": pa.array(np.floor(np.clip(raw, -1, 2) * (BINS / 3)).astype(np.int32)), "raw": pa.array(raw), "y": batch.column(1)})

    bins = rows.where("apart").select("stats", "y").mapInArrow(binned, "bin int, raw double, y double")
    bins = bins.groupBy("bin").agg(F.avg("raw").alias("at"), F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if bins:
        model.at, model.level = isotonic(np.array([r["at"] for r in bins]), np.array([r["y"] for r in bins]), np.array([float(r["n"]) for r in bins]))
    return model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    stats = materialise(with_statistics(docs), "stats", scratch_dir(docs.sparkSession))
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(2)))
            held = batch.column(1).to_numpy() == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))
