"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Every rule is a predicate over a text's words that is true for texts to reject. Their
costs (seconds a text) and selectivities (share rejected of what earlier rules let pass) are
estimated on a random sample of rows; the cascade then tries the rule with the most rejections
per second first and evaluates a later rule only for texts that every earlier one let pass. The
verdict is the conjunction of all rules, so the order changes the time, never a result. Where the
base counts are asked for of every text, the two base rules cost nothing more and come first.

Defined results: a null text has no words and fails for being short; repeated rows are
judged one by one; a very long text is judged as a whole; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import arrow_rows, read, release_memory, steps
from tidegraph.llm.words import Words, mix, per_text, scan, windows

#: Rows, about, on which costs and selectivities are estimated, and the seed that draws them. They only order the rules.
SAMPLE_ROWS, SEED = 2000, 5
MIN_WORDS = 20
REPEAT_WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True

BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


class Texts:
    """The texts of one step; what several rules need is computed once, when first asked for."""

    def __init__(self, texts: pa.Array):
        self.words: Words = scan(texts)
        self.n = len(texts)
        self._kept: dict[str, np.ndarray] = {}

    def get(self, name: str) -> np.ndarray:
        if name not in self._kept:
            self._kept[name] = getattr(self, f"_{name}")()
        return self._kept[name]

    def _n_words(self) -> np.ndarray:
        return self.words.counts

    def _word_chars(self) -> np.ndarray:
        """Code points in words: bytes of words that don't continue a character."""
        w = self.words
        return per_text(w.inside & ((w.data & 0xC0) != 0x80), w.text_start)

    def _n_symbols(self) -> np.ndarray:
        return per_text(_SYMBOL[self.words.data], self.words.text_start)

    def _upper(self) -> np.ndarray:
        return per_text(_UPPER[self.words.data], self.words.text_start)

    def _letters(self) -> np.ndarray:
        return per_text(_LETTER[self.words.data], self.words.text_start)

    def _n_lines(self) -> np.ndarray:
        return self._lines()[0]

    def _n_dup_lines(self) -> np.ndarray:
        return self._lines()[1]

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those equal to an earlier one."""
        if "lines" not in self._kept:
            raw, at = self.words.data.tobytes(), self.words.text_start.tolist()
            found = np.zeros((2, self.n), np.int64)
            for i in range(self.n):
                lines = [x for x in raw[at[i] : at[i + 1]].split(b"\n") if x.strip()]
                found[:, i] = len(lines), len(lines) - len(set(lines))
            self._kept["lines"] = found
        return self._kept["lines"]

    def _n_repeat_words(self) -> np.ndarray:
        """Words inside a window of eight words that stands twice or more in its text."""
        w, width = self.words, REPEAT_WINDOW
        keys = windows(w.hashes(), width)
        if not len(keys):
            return np.zeros(self.n, np.int64)
        doc = w.doc
        whole = np.flatnonzero(doc[: len(keys)] == doc[width - 1 :])
        keys = keys[whole] ^ mix(doc[whole].astype(np.uint64) + np.uint64(1))
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            return np.zeros(self.n, np.int64)
        at = np.searchsorted(twice, keys)
        at[at == len(twice)] = 0
        starts = whole[twice[at] == keys]
        change = np.zeros(len(doc) + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + width, -1)
        return per_text(np.cumsum(change[:-1]) > 0, w.doc_start)

    def _adjacent(self) -> np.ndarray:
        """Words equal to the word just before them."""
        w = self.words
        h, doc = w.hashes(), w.doc
        same = np.zeros(len(h), bool)
        if len(h):
            same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        return per_text(same, w.doc_start)


@dataclass(frozen=True)
class Rule:
    """reject(texts) is true for each text to reject."""

    name: str
    reject: Callable[[Texts], np.ndarray]


#: The production rules; the first two are the contract's base rules.
RULES = (
    Rule("short", lambda t: t.get("n_words") < MIN_WORDS),
    Rule("repeats", lambda t: 100 * t.get("n_repeat_words") > 30 * t.get("n_words")),
    Rule("symbols", lambda t: 10 * t.get("n_symbols") > t.get("n_words")),
    Rule("duplicate_lines", lambda t: 100 * t.get("n_dup_lines") > 30 * t.get("n_lines")),
    Rule("capitals", lambda t: 100 * t.get("upper") > 50 * np.maximum(t.get("letters"), 1)),
    Rule("stutter", lambda t: 100 * t.get("adjacent") > 25 * t.get("n_words")),
    Rule("word_length", lambda t: (t.get("word_chars") > 20 * t.get("n_words")) | (t.get("word_chars") < 2 * t.get("n_words"))),
)


MEASURES = "rule int, rejected long, n long, seconds double"


def measure(texts: pa.Array, rules: tuple[Rule, ...] = RULES) -> pa.RecordBatch:
    """MEASURES rows of some texts: each rule's seconds, run alone, and (rule -1) how many texts each set of
    rules rejects, as bits of the rules' places."""
    rows, bits = [], np.zeros(len(texts), np.int64)
    for i, rule in enumerate(rules):
        began = time.perf_counter()
        rejected = rule.reject(Texts(texts))
        rows.append((i, 0, len(texts), time.perf_counter() - began))
        bits |= rejected.astype(np.int64) << i
    rows += [(-1, int(b), int(n), 0.0) for b, n in zip(*np.unique(bits, return_counts=True), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=[x.split(" ")[0] for x in MEASURES.split(", ")])


def order_rules(seconds: dict[int, float], sets: dict[int, int], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules one after another: next is the one with the most rejections per second among the texts that
    those before let pass; names settle ties. seconds by rule; sets: texts by the bits of the rules that reject them."""
    left, ordered = list(range(len(rules))), []
    while left:
        alive = {b: n for b, n in sets.items() if not any(b >> i & 1 for i in ordered)}
        best = min(left, key=lambda i: (-sum(n for b, n in alive.items() if b >> i & 1) / max(seconds.get(i, 0.0), 1e-12), rules[i].name))
        ordered.append(best)
        left.remove(best)
    return tuple(rules[i] for i in ordered)


def cascade(texts: pa.Array, rules: tuple[Rule, ...]) -> np.ndarray:
    """True for texts that no rule rejects; a rule sees only what earlier rules let pass."""
    alive = np.arange(len(texts))
    for rule in rules:
        if not len(alive):
            break
        seen = texts if len(alive) == len(texts) else texts.take(pa.array(alive))
        alive = alive[~rule.reject(Texts(seen))]
    kept = np.zeros(len(texts), bool)
    kept[alive] = True
    return kept


def sample_order(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Order the rules by a random sample of about SAMPLE_ROWS rows, which tasks measure; sums come to the driver."""
    rows = docs.count()
    some = docs.select(F.col(text).alias("text"))
    if rows > SAMPLE_ROWS:
        some = some.where(F.rand(SEED) < SAMPLE_ROWS / rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in steps(batch, "text"):
                yield measure(texts, rules)

    got = some.mapInArrow(run, MEASURES).groupBy("rule", "rejected").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds")).collect()
    return order_rules({r["rule"]: r["seconds"] for r in got if r["rule"] >= 0}, {r["rejected"]: r["n"] for r in got if r["rule"] < 0}, rules)


def score_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: the id, the base counts, base_failed and kept."""
    arrow_rows(docs.sparkSession)
    ordered = sample_order(docs, text, rules)
    src = docs.select(id_col, text)
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.partition(" ")[0] for x in BASE_SCHEMA.split(", ")]
        for batch in batches:
            for part, texts in steps(batch, text):
                have = Texts(texts)
                base = {k: have.get(k) for k in names}
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
                kept = np.zeros(len(texts), bool)
                passed = np.flatnonzero(~failed)
                if len(passed):
                    kept[passed] = cascade(texts.take(pa.array(passed)), tuple(r for r in ordered if r.name not in ("short", "repeats")))
                columns = [part.column(0), *(pa.array(base[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *names, "base_failed", "kept"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, {BASE_SCHEMA}, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that every rule lets pass, with all their columns; evaluated as a cascade."""
    arrow_rows(docs.sparkSession)
    ordered = sample_order(docs, text, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            for part, texts in steps(batch, text):
                kept = part.filter(pa.array(cascade(texts, ordered)))
                if kept.num_rows:
                    yield kept

    return docs.mapInArrow(run, docs.schema)


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rules(read(spark, sf_dir, "documents", "doc_id", "text"))
