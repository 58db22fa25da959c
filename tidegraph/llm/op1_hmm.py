"""Hidden Markov language model: Baum-Welch over all partitions, exact scaled forward scores.

Tokens are the words [^\\x20\\x09-\\x0D]+ of a text, A-Z lowered, then one end. The FREQUENT words
with the most training tokens emit themselves; any other word emits the class of its last three
bytes (SUFFIXES classes) and is then drawn from that class by its smoothed training count. So
the states' tables have a fixed size, whatever the vocabulary, and

    log P(text) = log P(classes of the text)   by the scaled forward recursion
                + sum over its other words of log((c + 0.5) / (C + 0.5 * (V + 1)))

with c the word's count, C and V its class's tokens and distinct words, all from training texts.
Baum-Welch sums expected counts over all whole training texts in each of ITERATIONS passes: tasks
add them up, as fixed-point whole numbers, so that their order does not matter, and the sums of
all tasks are decimals, which no corpus overflows. A text too long for a task's memory is run
through in pieces, forward once to learn where each begins and then backward, with the same counts.

Counts of the other words are never broadcast: they are joined by a 64-bit hash of the word.

Defined results: a null text is empty and holds the end alone; a null doc_id counts as an empty
text for the fold; repeated rows are scored one by one; a very long text is scored and trained
on as a whole; without training texts N and V are 0,
the base takes 0.5 / 0.5 for each token and the model has its starting tables; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import arrow_rows, fold_of, materialise, read, scratch_dir, steps
from tidegraph.llm.words import Words, mix, scan

log = logging.getLogger(__name__)

STATES = 8
ITERATIONS = 8
FREQUENT = 32768
SUFFIXES = 4096
#: Tokens that one vectorised pass of the recursions takes together, and the most it holds at once.
LANE_TOKENS = 1 << 20
HOLD_TOKENS = 3 << 20
#: Texts of more tokens wait for each other, since each step of a pass takes one token of every text.
LONG_TOKENS = 2048
#: Pseudo-tokens of the class unigrams in each state's table.
PRIOR = 50.0
FIXED = 1e6
END = 0  # the hash of the end
END_CLASS = FREQUENT
CLASSES = FREQUENT + 1 + SUFFIXES


def suffix_class(w: Words) -> np.ndarray:
    """The class of each word's last three bytes, A-Z lowered."""
    code = np.zeros(len(w.start), np.uint64)
    for back in (3, 2, 1):
        at = w.stop - back
        byte = w.data[np.maximum(at, 0)].astype(np.uint64)
        byte = np.where((byte >= 65) & (byte <= 90), byte + np.uint64(32), byte)
        code = code * np.uint64(257) + np.where(at >= w.start, byte + np.uint64(1), np.uint64(0))
    return (mix(code + np.uint64(1)) % np.uint64(SUFFIXES)).astype(np.int32)


def _hashes(w: Words) -> np.ndarray:
    h = w.hashes(lower=True)
    return np.where(h == END, np.uint64(1), h).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, suffix, n): training tokens of each word by its hash; the end has the hash 0."""
    train = docs.where("not held_out").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = ends = 0

        def flush() -> Iterator[pa.RecordBatch]:
            word, suffix, n = (np.concatenate(x) for x in zip(*held, strict=True))
            word, first, inverse = np.unique(word, return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=n).astype(np.int64)
            suffix = suffix[first]
            for i in range(0, len(word), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(word[i : i + 100_000]), pa.array(suffix[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["word", "suffix", "n"])

        for batch in batches:
            for _, texts in steps(batch, "text"):
                w = scan(texts)
                ends += len(texts)
                word, first, n = np.unique(_hashes(w), return_index=True, return_counts=True)
                held.append((word, suffix_class(w)[first], n))
                size += len(word)
                if size > 3_000_000:
                    yield from flush()
                    held, size = [], 0
        if ends:
            held.append((np.array([END]), np.array([0], np.int32), np.array([ends])))
        if held:
            yield from flush()

    parts = train.mapInArrow(run, "word long, suffix int, n long")
    return parts.groupBy("word").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"))


class Vocabulary:
    """The frequent words (bounded by FREQUENT) and sums over the others, by suffix class."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.distinct = total["n"] or 0, total["v"]
        ends = counts.where(F.col("word") == END).select("n").collect()
        self.ends = ends[0]["n"] if ends else 0
        words = counts.where(F.col("word") != END)
        # written first, as a plain collect of the top rows would send every partition's own top to the driver
        top = materialise(words.orderBy(F.desc("n"), "word").limit(FREQUENT), "top").toPandas().sort_values("word")
        self.word, self.count = top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
        self.class_tokens, self.class_words = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
        for r in words.groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            self.class_tokens[r["suffix"]], self.class_words[r["suffix"]] = r["n"], r["v"]
        np.subtract.at(self.class_tokens, top["suffix"].to_numpy(), self.count)
        np.subtract.at(self.class_words, top["suffix"].to_numpy(), 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The frequent class of each word, -1 for others."""
        if not len(self.word):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.word, hashes)
        at[at == len(self.word)] = 0
        return np.where(self.word[at] == hashes, at, -1)

    def unigrams(self) -> np.ndarray:
        """Smoothed share of each class among the training tokens."""
        n = np.full(CLASSES, 0.0)
        n[: len(self.count)] = self.count
        n[END_CLASS] = self.ends
        n[END_CLASS + 1 :] = self.class_tokens
        return (n + 0.5) / (n + 0.5).sum()


CODED_SCHEMA = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, rare_logs double, classes binary, rare array<long>"


def code_texts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per text: its classes, what the frequent words add to the base, and the other words' hashes."""
    log_count = np.log10(vocabulary.count + 0.5)
    log_class = -np.log10(vocabulary.class_tokens + 0.5 * (vocabulary.class_words + 1))
    log_end, end_known = float(np.log10(vocabulary.ends + 0.5)), int(vocabulary.ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, texts in steps(batch, "text"):
                w, n = scan(texts), len(texts)
                h = _hashes(w)
                own, suffix = vocabulary.find(h), suffix_class(w)
                rare = own < 0
                classes = np.where(rare, END_CLASS + 1 + suffix, own).astype("<u2")
                logs = np.zeros(len(h) + 1)
                np.cumsum(np.where(rare, 0.0, log_count[np.maximum(own, 0)] if len(log_count) else 0.0), out=logs[1:])
                rare_logs = np.zeros(len(h) + 1)
                np.cumsum(np.where(rare, log_class[suffix], 0.0), out=rare_logs[1:])
                upto = np.zeros(len(h) + 1, np.int64)
                np.cumsum(rare, out=upto[1:])
                b = w.doc_start
                known = np.diff(b) - np.diff(upto[b]) + end_known
                flat = np.insert(classes, b[1:], END_CLASS).tobytes()
                cuts = (2 * (b + np.arange(n + 1))).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
                lists = pa.ListArray.from_arrays(pa.array(upto[b], pa.int32()), pa.array(h[rare]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), part.column(0).cast(pa.int64()), part.column(1), pa.array(np.diff(b) + 1), pa.array(known), pa.array(np.diff(logs[b]) + log_end), pa.array(np.diff(rare_logs[b])), binary, lists],
                    names=[x.split(" ")[0] for x in CODED_SCHEMA.split(", ")],
                )
                row += n

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, CODED_SCHEMA)


class Hmm:
    """start [K], move [K, K], emit [CLASSES, K]; likelihood: log10 of the training texts under the model before."""

    def __init__(self, unigrams: np.ndarray, states: int = STATES):
        rng = np.random.Generator(np.random.PCG64(11))
        self.unigrams = unigrams
        self.start = np.full(states, 1 / states)
        self.move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(self.move, 0.9)
        emit = unigrams[:, None] * np.exp(rng.standard_normal((len(unigrams), states)))
        self.emit = emit / emit.sum(axis=0)
        self.likelihood: float | None = None

    def learn(self, emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> None:
        """The M step, with PRIOR pseudo-tokens of the unigrams in each state."""
        self.emit = (emitted + PRIOR * self.unigrams[:, None]) / (emitted.sum(axis=0) + PRIOR)
        self.move = (moved + 0.1) / (moved + 0.1).sum(axis=1, keepdims=True)
        self.start = (started + 0.1) / (started + 0.1).sum()


class _Lanes:
    """Texts side by side, the longest first, with their tokens in the order of time: step t takes the t-th of each."""

    def __init__(self, seq: np.ndarray, begin: np.ndarray, length: np.ndarray):
        self.order = np.argsort(-length, kind="stable")
        begin, length = begin[self.order], length[self.order]
        self.seq, self.begin, self.n = seq, begin, len(begin)
        self.active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")  # texts longer than t
        self.first = np.concatenate([[0], np.cumsum(self.active)])

    def pieces(self, hold: int) -> list[tuple[int, int]]:
        """Ranges of steps that hold about so many tokens."""
        cuts, t = [0], 0
        while t < len(self.active):
            t = max(t + 1, int(np.searchsorted(self.first, self.first[t] + hold, side="right")) - 1)
            cuts.append(min(t, len(self.active)))
        return list(zip(cuts[:-1], cuts[1:], strict=True))

    def classes(self, t0: int, t1: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """The classes and the texts of steps t0 to t1, one step after another, and where each step begins."""
        active = self.active[t0:t1]
        at = (self.first[t0 : t1 + 1] - self.first[t0]).tolist()
        text = np.arange(at[-1]) - np.repeat(at[:-1], active)
        return self.seq[self.begin[text] + np.repeat(np.arange(t0, t1), active)], text, at


def _forward(model_start: np.ndarray, move: np.ndarray, emit: np.ndarray, at: list[int], before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward variables of a range of steps, whose emissions are given, and the scales."""
    alpha, scale, ones = np.empty_like(emit), np.empty(len(emit), emit.dtype), np.ones(emit.shape[1], emit.dtype)
    for a, b in zip(at[:-1], at[1:], strict=True):
        now = alpha[a:b]
        if before is None:
            now[:] = model_start
        else:
            np.matmul(before[: b - a], move, out=now)
        np.multiply(now, emit[a:b], out=now)
        c = np.matmul(now, ones, out=scale[a:b])
        np.divide(now, c[:, None], out=now)
        before = now
    return alpha, scale


def expected_counts(model: Hmm, seq: np.ndarray, begin: np.ndarray, length: np.ndarray, hold: int = HOLD_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch sums of the whole texts seq[begin:begin+length], and their log10 likelihood."""
    lanes, k = _Lanes(seq, begin, length), len(model.start)
    start, emit, move = (x.astype(np.float32) for x in (model.start, model.emit, model.move))
    back = np.ascontiguousarray(move.T)
    pieces = lanes.pieces(hold)
    reached: list[np.ndarray | None] = [None]  # forward variables of the step before each piece
    for t0, t1 in pieces[:-1]:
        x, _, at = lanes.classes(t0, t1)
        reached.append(_forward(start, move, emit[x], at, reached[-1])[0][at[-2] :].copy())
    emitted, moved, total = np.zeros((len(emit), k)), np.zeros((k, k)), 0.0
    behind = np.ones((0, k), np.float32)  # of the step behind: emission times backward variable over scale
    for (t0, t1), before in zip(reversed(pieces), reversed(reached), strict=True):
        x, _, at = lanes.classes(t0, t1)
        b = emit[x]
        alpha, scale = _forward(start, move, b, at, before)
        total += float(np.log10(scale).sum(dtype=np.float64))
        for i in range(len(at) - 2, -1, -1):
            now = slice(at[i], at[i + 1])
            own = np.ones((at[i + 1] - at[i], k), np.float32)
            if len(behind):
                moved += alpha[now][: len(behind)].T @ behind
                np.matmul(behind, back, out=own[: len(behind)])
            behind = b[now] * own
            behind /= scale[now][:, None]
            b[now] = own  # emissions make room for backward variables
        np.multiply(alpha, b, out=alpha)
        for i in range(k):
            emitted[:, i] += np.bincount(x, weights=alpha[:, i], minlength=len(emit))
        if t0 == 0:
            started = alpha[: at[1]].sum(axis=0, dtype=np.float64)
    return emitted, moved * model.move, started, total


def forward(model: Hmm, seq: np.ndarray, begin: np.ndarray, length: np.ndarray, hold: int = HOLD_TOKENS) -> np.ndarray:
    """log10 likelihood of each text's classes by the scaled forward recursion."""
    lanes = _Lanes(seq, begin, length)
    total, before = np.zeros(lanes.n), None
    for t0, t1 in lanes.pieces(hold):
        x, text, at = lanes.classes(t0, t1)
        alpha, scale = _forward(model.start, model.move, model.emit[x], at, before)
        before = alpha[at[-2] :].copy()
        total += np.bincount(text, weights=np.log10(scale), minlength=lanes.n)
    out = np.empty(lanes.n)
    out[lanes.order] = total
    return out


def _gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Batches together up to LANE_TOKENS, with their classes one after another and the texts' bounds."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes // 2
        if size >= LANE_TOKENS:
            yield held, *_classes(held, column)
            held, size = [], 0
    if held:
        yield held, *_classes(held, column)


def _classes(held: list[pa.RecordBatch], column: int) -> tuple[np.ndarray, np.ndarray]:
    parts, lengths = [], []
    for batch in held:
        c = batch.column(column)
        cuts = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        parts.append(np.frombuffer(c.buffers()[2], "u1")[cuts[0] : cuts[-1]].view("<u2") if cuts[-1] > cuts[0] else np.zeros(0, "<u2"))
        lengths.append(np.diff(cuts) // 2)
    return np.concatenate(parts).astype(np.int32), np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)


def _training_lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(classes, begin, length) of texts to take together; long ones are held back until enough have come."""
    held: list[np.ndarray] = []
    size = 0

    def long_ones() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = np.array([len(x) for x in held])
        return np.concatenate(held), np.cumsum(length) - length, length

    for _, seq, bounds in _gathered(batches, 0):
        length = np.diff(bounds)
        short = length <= LONG_TOKENS
        if short.any():
            yield seq, bounds[:-1][short], length[short]
        for i in np.flatnonzero(~short).tolist():
            held.append(seq[bounds[i] : bounds[i + 1]].copy())
            size += len(held[-1])
        if size >= LANE_TOKENS:
            yield long_ones()
            held, size = [], 0
    if held:
        yield long_ones()


def baum_welch(coded: DataFrame, unigrams: np.ndarray, states: int = STATES, iterations: int = ITERATIONS) -> Hmm:
    """Train on the rows of coded that are not held out."""
    model = Hmm(unigrams, states)
    train = coded.where("not held_out").select("classes")
    names = [f"s{i}" for i in range(states)]

    for _ in range(iterations):

        def run(batches: Iterator[pa.RecordBatch], model: Hmm = model) -> Iterator[pa.RecordBatch]:
            emitted, moved, started, total = np.zeros((len(model.emit), states)), np.zeros((states, states)), np.zeros(states), np.zeros(states)
            for seq, begin, length in _training_lanes(batches):
                e, m, s, likelihood = expected_counts(model, seq, begin, length)
                emitted, moved, started = emitted + e, moved + m, started + s
                total[0] += likelihood
            table = np.rint(np.concatenate([emitted, moved, started[None, :], total[None, :]]) * FIXED).astype(np.int64)
            keep = np.flatnonzero(table.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), *(pa.array(table[keep, i]) for i in range(states))], names=["line", *names])

        sums = train.mapInArrow(run, "line int, " + ", ".join(f"{x} long" for x in names))
        # decimals: the whole numbers of all tasks together may exceed 64 bits
        got = sums.groupBy("line").agg(*[F.sum(F.col(x).cast("decimal(20,0)")).cast("double").alias(x) for x in names]).toPandas()
        if got.empty:
            break
        table = np.zeros((len(unigrams) + states + 2, states))
        table[got["line"].to_numpy()] = got[names].to_numpy() / FIXED
        fresh = Hmm(unigrams, states)
        fresh.learn(table[: len(unigrams)], table[len(unigrams) : -2], table[-2])
        fresh.likelihood = float(table[-1, 0])
        log.info("log10 likelihood of the training texts' classes: %.1f", fresh.likelihood)
        model = fresh
    return model


def rare_sums(coded: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, rare_count_logs, rare_known): per text, log10(c + 0.5) and c > 0 summed over its other words."""
    each = coded.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    joined = each.join(counts.select("word", "n"), "word", "left")
    c = F.coalesce("n", F.lit(0))
    return joined.groupBy("row").agg(F.sum(F.col("k") * F.log10(c + 0.5)).alias("rare_count_logs"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("rare_known"))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = docs.sparkSession
    arrow_rows(spark)
    where = scratch_dir(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), (fold_of(F.col(id_col)) == 1).alias("held_out"), F.col(text).alias("text"))
    counts = materialise(count_words(own), "counts", where)
    vocabulary = Vocabulary(counts)
    coded = materialise(code_texts(own, vocabulary), "coded", where)
    model = baum_welch(coded, vocabulary.unigrams())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, seq, bounds in _gathered(batches, 6):
            logs = forward(model, seq, bounds[:-1], np.diff(bounds))
            at = 0
            for batch in held:
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(logs[at : at + batch.num_rows])], names=[*batch.schema.names[:6], "forward"])
                at += batch.num_rows

    columns = ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "classes"]
    scored = coded.select(*columns, "rare_logs")
    scored = scored.select(*columns[:5], F.struct("logs", "rare_logs").alias("logs"), "classes")
    scored = scored.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, logs struct<logs:double,rare_logs:double>, forward double")
    out = scored.join(rare_sums(coded, counts), "row", "left")
    rare = F.coalesce("rare_count_logs", F.lit(0.0))
    unit = float(np.log10(vocabulary.tokens + 0.5 * (vocabulary.distinct + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("logs.logs") + rare - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("forward") + F.col("logs.rare_logs") + rare).alias("score"),
    )


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents", "doc_id", "text"))
