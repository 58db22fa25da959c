"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A window
is 13 consecutive words of a benchmark item; an item of fewer words is one window. Of a window
of L words, whichever place it stands at, L - s + 1 words (s = (L + 1) // 2) begin at a multiple
of s, so the scan looks up only those grams of a document in the broadcast table of all grams
of the windows, and compares the whole window, word by word, where one is found.

Defined results: a null text, or one without words, has no hits; an item without words has no
window; items of one id count as one, a null item id counts as an empty one; repeated documents
are judged once and each gets the result; a very long text is one row whose words are held
together in a task, all of them scanned; without documents or items nothing is hit; extra columns,
whatever their names, are ignored by the digest and kept by `decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import materialise, read

WINDOW = 13
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words and gaps of a text that is not lower-cased yet: they lie at the same places.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CASED_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows and their grams are broadcast up to this size; beyond it they are shuffled.
BROADCAST_BYTES = 64 << 20
#: Documents found (an id and a hash, and the few spans) are broadcast up to this number.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """The normalised words of a text (null: none)."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, NOT_WORD), "")


def stride(length: Column | int):
    """Of `length` consecutive places, one of the first `stride` is a multiple of it."""
    return (length + 1) // 2 if isinstance(length, int) else F.floor((length + 1) / 2).cast("int")


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(length, win, items): the distinct windows, as their words joined by spaces, and the items that hold them."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    starts = F.sequence(F.lit(0), F.size("words") - F.col("length"))
    each = items.select("item", "length", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, F.col("length")), " "))).alias("win"))
    return each.groupBy("length", "win").agg(F.array_sort(F.collect_set("item")).alias("items"))


def grams_of(wins: DataFrame) -> DataFrame:
    """(gram, ahead, length, win): each gram of a window that a scan can meet, and the words ahead of it."""
    cut = wins.withColumn("w", F.split("win", " ")).withColumn("s", stride(F.col("length")))
    size = F.col("length") - F.col("s") + 1
    found = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda o: F.struct(F.xxhash64(F.slice("w", o + 1, size)).alias("gram"), o.alias("ahead")))
    return cut.select(F.explode(found).alias("g"), "length", "win").select("g.gram", "g.ahead", "length", "win")


def _gram_at(words: Column, m: int):
    """A lambda of one parameter; a second one would get the element's index."""
    return lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(words, i + 1, F.lit(m))).alias("gram"))


def doc_grams(words: Column, lengths: list[int]) -> Column:
    """array<struct<at, gram>>: what the scan looks up for windows of the given lengths."""
    size = F.size(words)
    each = []
    for n in lengths:
        s = stride(n)
        m = n - s + 1
        places = F.when(size >= m, F.sequence(F.lit(0), size - m, F.lit(s))).otherwise(F.array().cast("array<int>"))
        each.append(F.transform(places, _gram_at(words, m)))
    return F.concat(*each) if len(each) > 1 else each[0]


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document id and text (id, key): n_rows of docs alike in both, n_words, spans (sorted array of
    start and length) and items (sorted distinct ids).

    Each text is read and cut into words once. A row with a gram of null stands for the text itself; it and the
    verified hits are all that is exchanged, never a text.
    """
    wins = materialise(windows_of(benchmark, window), "windows")
    lengths = sorted(r[0] for r in wins.select("length").distinct().collect()) or [window]
    grams = materialise(grams_of(wins), "grams")
    small = fits(grams, wins)
    own = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("words"))
    itself = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("long").alias("gram")))
    scanned = own.select("id", "key", "words", F.explode(F.concat(itself, doc_grams(F.col("words"), lengths))).alias("g"))
    if small:
        met = scanned.join(F.broadcast(grams), F.col("g.gram") == grams["gram"], "left").where("g.at < 0 or win is not null")
    else:
        # grams too many to send to every task: those found come back to the texts that hold them
        asked = own.select("id", "key", F.explode(doc_grams(F.col("words"), lengths)).alias("g")).distinct()
        found = asked.join(grams, F.col("g.gram") == grams["gram"]).select("id", "key", F.struct("g", "ahead", "length", "win").alias("f"))
        found = found.withColumnsRenamed({"id": "d", "key": "k"})
        each = own.dropDuplicates(["id", "key"]).join(found, F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
        nothing = F.lit(None).cast("int").alias("ahead"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("win")
        texts = own.select("id", "key", "words", F.element_at(itself, 1).alias("g"), *nothing)
        met = texts.unionByName(each.select("id", "key", "words", "f.*"))
    start = F.col("g.at") - F.col("ahead")
    same = (start >= 0) & (F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("length")), " ") == F.col("win"))
    text = F.col("g.at") < 0
    met = met.where(text | same).select("id", "key", text.alias("whole"), F.size("words").alias("n_words"), start.alias("start"), "length", "win")
    # a hit is met once for each gram of its window
    hits = met.groupBy("id", "key", "whole", "n_words", "start", "length", "win").agg(F.count("*").alias("n"))
    named = hits.join(F.broadcast(wins) if small else wins, ["length", "win"], "left")
    return named.groupBy("id", "key").agg(
        F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)).alias("n_rows"), F.first("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(~F.col("whole"), F.struct("start", "length")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def fits(grams: DataFrame, wins: DataFrame) -> bool:
    """Whether the tables of grams and windows, with all their text, are small enough to broadcast."""
    size = sum(F.length(c) for c in ("win",)) + 64
    own = grams.agg(F.sum(size)).first()[0] or 0
    more = wins.agg(F.sum(size + F.aggregate("items", F.lit(0), lambda a, x: a + F.length(x) + 16))).first()[0] or 0
    return own + more <= BROADCAST_BYTES


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(state: Column, span: Column) -> Column:
        end = span["start"] + span["length"]
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + F.greatest(F.lit(0), end - F.greatest(state["end"], span["start"]))).alias("n"))

    return F.aggregate(spans, zero, add, lambda state: state["n"])


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """occurrences with n_hit and contaminated."""
    out = occurrences(docs, benchmark, window).withColumn("n_hit", F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def with_marks(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Rows of docs (as `row`) joined with marks (id, key and maybe spans), which are broadcast up to BROADCAST_ROWS rows and spans."""
    marks = materialise(marks.withColumnsRenamed({"id": "m_id", "key": "m_key"}), "marks")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(row, F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    rows, spans = marks.agg(F.count("*"), F.sum(F.size("spans")) if "spans" in marks.columns else F.lit(0)).first()
    side = F.broadcast(marks) if rows + (spans or 0) <= BROADCAST_ROWS else marks
    return own.join(side, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")), how)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") without the hit words of any document.

    Only what is found joins the texts again: contaminated documents, or those with spans.
    """
    found = judged(docs, benchmark, window)
    if remove == "documents":
        return with_marks(docs, found.where("contaminated").select("id", "key"), "left_anti").select("row.*")
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    text = F.col("row.text")
    pieces = F.regexp_extract_all(text, F.lit(f"({CASED_WORD}|{CASED_GAP})"), F.lit(1))
    first = F.when(text.rlike(f"^{CASED_GAP}"), 1).otherwise(0)

    def stays(piece: Column, j: Column) -> Column:
        at = F.floor((j - first) / 2)
        hit = F.exists("spans", lambda s: (at >= s["start"]) & (at < s["start"] + s["length"]))
        return ((j - first) % 2 != 0) | ~hit

    marked = with_marks(docs, found.where("n_hit > 0").select("id", "key", "spans"), "left")
    cut = F.when(F.col("spans").isNotNull(), F.array_join(F.filter(pieces, stays), "")).otherwise(text)
    return marked.withColumn("row", F.col("row").withField("text", cut)).select("row.*")


def decontaminate_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs."""
    found = judged(docs.select("doc_id", "text"), benchmark)
    each = found.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return each.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate_digest(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark"))
