"""The operators on small tables with odd rows, against brute force."""

import hashlib
import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import block_coder, op1_hmm, op2_quality, op3_tokens, op4_mix, op5_jaccard, op6_warc, op7_decontaminate, op8_rules, op9_sections, op10_license, oracles
from tidegraph.llm.components import components
from tidegraph.llm.files import read_bytes
from tidegraph.llm.tokenizing import WordEncoder, _Places
from tidegraph.llm.words import scan

BASE = "the quick brown fox jumps over the lazy dog while nine other animals look on and say nothing at all about it".split()
LONG = " ".join(f"w{i % 997} x{i % 31}" for i in range(4000))
TEXTS = [
    (1, " ".join(BASE), "en", "a"),
    (2, " ".join(BASE), "en", "a"),
    (3, " ".join([*BASE, "extra"]), "en", "b"),
    (3, " ".join([*BASE, "extra"]), "en", "b"),
    (4, None, None, None),
    (5, "", "en", "a"),
    (6, " \t\n", "en", "c"),
    (7, "Short Text", None, "c"),
    (8, LONG, "en", "a"),
    (9, LONG + " tail", "en", None),
    (None, "a document without an id, released under the MIT License. " + " ".join(BASE), "en", "a"),
    (10, "Été À la MIT  LICENSE\nApache License\nGNU General Public License mit license mit license", "fr", "b"),
    (11, "line one is here\nline one is here\nline two | # *\n" * 9, "en", "a"),
    (12, "SHOUT LOUD " * 30, "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns with names that operators use themselves
    return spark.createDataFrame(TEXTS, SCHEMA).withColumns({"size": F.lit("x"), "key": F.lit(None).cast("string"), "row": F.lit(1), "u": F.lit(2), "words": F.lit(3), "kept": F.lit(True)}).repartition(3)


def split(text):
    return (text or "").encode().split()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# words

def test_scan_and_hashes():
    texts = ["a b", "", None, "  lead", "tail \x0b\x0c", "é ñ x", "A a", "\x1c\x85z"]
    w = scan(pa.array(texts, pa.large_string()).fill_null(""))
    got = [[w.word(i) for i in range(w.doc_start[d], w.doc_start[d + 1])] for d in range(len(texts))]
    assert got == [split(t) for t in texts]
    h = w.hashes(lower=True)
    assert h[w.doc_start[6]] == h[w.doc_start[6] + 1] == h[0]
    assert w.hashes()[w.doc_start[6]] != w.hashes()[0]
    part = scan(pa.array(texts, pa.large_string()).fill_null("").slice(3, 2))
    assert [part.word(i) for i in range(2)] == [b"lead", b"tail"]


# 1

def test_hmm_scores(spark, docs):
    got = op1_hmm.score_texts(docs).collect()
    tokens = [[x.lower() for x in split(t[1])] + [None] for t in TEXTS]
    fold = [zlib.crc32(str(t[0] if t[0] is not None else "").encode()) % 5 for t in TEXTS]
    counts = Counter(x for tok, f in zip(tokens, fold, strict=True) if f != 1 for x in tok)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        ((t[0], f == 1, len(tok), sum(counts[x] > 0 for x in tok), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tok), 6)) for t, tok, f in zip(TEXTS, tokens, fold, strict=True)),
        key=repr,
    )
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert op1_hmm.score_texts(docs.limit(0)).count() == 0


def test_forward_is_exact_and_training_helps():
    rng = np.random.default_rng(1)
    model = op1_hmm.Hmm(np.full(6, 1 / 6), 3)
    seq = rng.integers(0, 6, 5)
    direct = 0.0
    for path in np.ndindex(*(3,) * 5):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for t in range(1, 5):
            p *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
        direct += p
    assert abs(op1_hmm.forward(model, seq, np.array([0]), np.array([5]))[0] - math.log10(direct)) < 1e-9
    # expected counts against enumeration
    e, m, s, total = op1_hmm.expected_counts(model, seq, np.array([0]), np.array([5]))
    assert abs(total - math.log10(direct)) < 1e-4
    we, wm, ws = np.zeros((6, 3)), np.zeros((3, 3)), np.zeros(3)
    for path in np.ndindex(*(3,) * 5):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for t in range(1, 5):
            p *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
        p /= direct
        ws[path[0]] += p
        for t in range(5):
            we[seq[t], path[t]] += p
            if t:
                wm[path[t - 1], path[t]] += p
    assert np.allclose(e, we, atol=1e-4) and np.allclose(m, wm, atol=1e-4) and np.allclose(s, ws, atol=1e-4)


def plain_counts(model, texts):
    """Baum-Welch sums by the unscaled recursions of one text after another."""
    e, m, s = np.zeros_like(model.emit), np.zeros_like(model.move), np.zeros_like(model.start)
    for x in texts:
        alpha = np.zeros((len(x), len(model.start)))
        beta = np.ones_like(alpha)
        for t in range(len(x)):
            alpha[t] = (model.start if t == 0 else alpha[t - 1] @ model.move) * model.emit[x[t]]
            alpha[t] /= alpha[t].sum()
        for t in range(len(x) - 2, -1, -1):
            beta[t] = model.move @ (model.emit[x[t + 1]] * beta[t + 1])
            beta[t] /= beta[t].sum()
        for t in range(len(x)):
            gamma = alpha[t] * beta[t]
            e[x[t]] += gamma / gamma.sum()
            if t == 0:
                s += gamma / gamma.sum()
            else:
                xi = alpha[t - 1][:, None] * model.move * (model.emit[x[t]] * beta[t])[None, :]
                m += xi / xi.sum()
    return e, m, s


def test_expected_counts_of_whole_texts_in_pieces():
    rng = np.random.default_rng(4)
    model = op1_hmm.Hmm(np.full(9, 1 / 9), 4)
    texts = [rng.integers(0, 9, n) for n in (1, 700, 3, 40, 700, 2, 263)]
    length = np.array([len(x) for x in texts])
    seq, begin = np.concatenate(texts), np.cumsum(length) - length
    want = plain_counts(model, texts)
    for hold in (1, 64, 1000, 1 << 20):
        got = op1_hmm.expected_counts(model, seq, begin, length, hold)
        for g, w in zip(got, want, strict=False):
            assert np.allclose(g, w, rtol=2e-4, atol=2e-3)
        assert np.allclose(op1_hmm.forward(model, seq, begin, length, hold), op1_hmm.forward(model, seq, begin, length))
        assert abs(got[3] - op1_hmm.forward(model, seq, begin, length).sum()) < 0.05


def test_scores_are_those_of_plain_training(spark, docs, monkeypatch):
    """The score of every text, against training and scoring in plain loops; long texts are taken apart and together."""
    monkeypatch.setattr(op1_hmm, "LONG_TOKENS", 500)
    own = docs.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1).alias("held_out"), "text")
    counts = op1_hmm.count_words(own).cache()
    vocabulary = op1_hmm.Vocabulary(counts)
    known = {int(h): i for i, h in enumerate(vocabulary.word)}
    every, training = [], []
    for doc_id, text, *_ in TEXTS:
        w = scan(pa.array([(text or "")], pa.large_string()))
        x = [*(known[int(h)] if int(h) in known else op1_hmm.END_CLASS + 1 + int(c) for h, c in zip(op1_hmm._hashes(w), op1_hmm.suffix_class(w), strict=True)), op1_hmm.END_CLASS]
        every.append(np.array(x))
        if zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % 5 != 1:
            training.append(every[-1])
    model, likelihood = op1_hmm.Hmm(vocabulary.unigrams()), []
    for _ in range(op1_hmm.ITERATIONS):
        e, m, s = plain_counts(model, training)
        likelihood.append(sum(op1_hmm.forward(model, x, np.array([0]), np.array([len(x)]))[0] for x in training))
        model = op1_hmm.Hmm(vocabulary.unigrams())
        model.learn(e, m, s)
    assert all(b > a for a, b in zip(likelihood[:-1], likelihood[1:], strict=True))
    class_n, class_v, total = vocabulary.class_tokens, vocabulary.class_words, Counter({int(r["word"]): r["n"] for r in counts.collect()})
    want = []
    for (doc_id, text, *_), x in zip(TEXTS, every, strict=True):
        score = op1_hmm.forward(model, x, np.array([0]), np.array([len(x)]))[0]
        w = scan(pa.array([(text or "")], pa.large_string()))
        for h, c in zip(op1_hmm._hashes(w), op1_hmm.suffix_class(w), strict=True):
            if int(h) not in known:
                score += math.log10((total[int(h)] + 0.5) / (class_n[c] + 0.5 * (class_v[c] + 1)))
        want.append((doc_id or -1, score))
    got = sorted((r["doc_id"] or -1, r["score"]) for r in op1_hmm.score_texts(docs).collect())
    for (a, x), (b, y) in zip(got, sorted(want), strict=True):
        assert a == b and abs(x - y) < 1e-3 * max(1, abs(y))
    counts.unpersist()


def test_class_model_sums_to_one(spark, docs):
    """States' tables sum to 1, and seen words of a suffix class leave only the unseen ones' share."""
    own = docs.select("doc_id", (F.col("doc_id") == 8).alias("held_out"), "text").fillna({"held_out": False})
    counts = op1_hmm.count_words(own).cache()
    vocabulary = op1_hmm.Vocabulary(counts)
    assert abs(vocabulary.unigrams().sum() - 1) < 1e-9
    assert np.allclose(op1_hmm.Hmm(vocabulary.unigrams()).emit.sum(axis=0), 1)
    counts.unpersist()


# 2

def test_quality_learns_and_keeps_labels_apart(spark):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(600):
        good = i % 3 > 0
        some = [words[k] for k in rng.integers(0, 300, 60)]
        rows.append((i, " ".join(some if good else [w + "###" for w in some]), "en", "s"))
        marks.append((i, int(good)))
    docs = spark.createDataFrame([*rows, (None, None, None, None), (7000, "", None, None)], SCHEMA)
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in op2_quality.score_quality(docs, labels).collect()}
    assert len(got) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["predicted"] == int(i % 3 > 0) for i in held]) > 0.97
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in op2_quality.score_quality(docs, flipped).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-9 for i in held)
    none = op2_quality.score_quality(docs.limit(3), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert op2_quality.score_quality(docs.limit(0), labels).count() == 0


def test_quality_solves_the_normal_equations(spark):
    """Sums of partitions, in two levels, against one least-squares problem over all rows; repeated rows, long texts and odd columns."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 90, 30 + i % 50)) + "!" * (i % 3), "x") for i in range(300)]
    rows += [(5, rows[5][1], "x"), (900, LONG * 3, "x"), (901, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats string").withColumns({"fold": F.lit("z"), "y": F.lit(1)}).repartition(70)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(900, 1), (4, 1), (4, 0)], "doc_id long, quality int")
    stats = op2_quality.with_statistics(docs)
    model = op2_quality.fit(stats, labels)
    marks = {}
    for r in labels.collect():
        marks.setdefault(r["doc_id"], []).append(r["quality"])
    apart = {r["doc_id"] for r in labels.where(F.xxhash64("doc_id") % 5 == 0).collect()}
    used = [(r["stats"], np.mean(marks[r["doc_id"]]), r["doc_id"]) for r in stats.collect() if r["doc_id"] in marks and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    every = np.array([x for x, _, _ in used], np.float64)
    assert np.allclose(model.mean, every.mean(axis=0), rtol=1e-5, atol=1e-6) and np.allclose(model.scale, np.maximum(every.std(axis=0), 1e-6), rtol=1e-4, atol=1e-6)
    z = model.lift(np.array([x for x, _, d in used if d not in apart], np.float64))
    y = np.array([m for _, m, d in used if d not in apart])
    n = len(y)
    penalty = np.full(z.shape[1], op2_quality.RIDGE * n / op2_quality.FEATURES)
    penalty[-1] = 1e-9 * n
    # ridge as plain least squares with one more row for each weight
    want = np.linalg.lstsq(np.concatenate([z, np.diag(np.sqrt(penalty))]), np.concatenate([y, np.zeros(len(penalty))]), rcond=None)[0]
    assert np.allclose(z @ model.beta, z @ want, atol=1e-6)
    got = op2_quality.score_quality(docs, labels)
    assert got.count() == len(rows) and len({r["score"] for r in got.where("doc_id = 5").collect()}) == 1


def test_isotonic():
    at, level = op2_quality.isotonic(np.arange(4.0), np.array([0, 2, 1, 2.0]), np.array([2.0] * 4))
    assert np.allclose(np.interp([0, 1, 2, 3], at, level), [0, 0.75, 0.75, 1])


# 3

def test_block_coder_round_trip_and_checksum(spark):
    rng = np.random.default_rng(5)
    blocks = [ids.astype("<u4").tobytes() for n in (1, 2, 300, 4097, 30000) for ids in (rng.integers(0, 49408, n), rng.zipf(1.3, n) % 300, np.zeros(n, np.int64), rng.integers(0, 1 << 32, n), np.tile(rng.integers(0, 50, 20), n)[:n])]
    coded = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, ids binary").select("i", block_coder.encode_block(spark, F.col("ids")).alias("code"))
    got = {r["i"]: bytes(r["code"]) for r in coded.collect()}
    damaged = []
    for i in (3, 11, 16, 20):
        damaged += [got[i][:at] + bytes([got[i][at] ^ bit]) + got[i][at + 1 :] for at in {0, 5, 9, 14, len(got[i]) // 2, len(got[i]) - 1} for bit in (1, 128)] + [got[i][:-1], got[i] + b"x", got[i][:10], b""]
    every = [*got.items(), *((-1, b) for b in damaged)]
    back = spark.createDataFrame([(i, bytearray(b)) for i, b in every], "i int, code binary").select("i", block_coder.decode_block(spark, F.col("code")).alias("ids")).collect()
    for r in back:
        assert (r["ids"] is None) if r["i"] < 0 else bytes(r["ids"]) == blocks[r["i"]]
    # random ids cost what they hold, repeats next to nothing
    assert len(got[20]) < 1.1 * 30000 * 2 + 3 * 22000 and len(got[22]) < 400 and len(got[24]) < 400
    text = np.tile(rng.integers(0, 500, 200), 100).astype("<u4").tobytes()
    assert spark.createDataFrame([(bytearray(text),)], "b binary").select(F.length(block_coder.encode_block(spark, F.col("b"))).alias("n")).first()["n"] < 2000


def test_word_encoder_equals_whole_texts():
    coder = WordEncoder(op3_tokens.default_tokenizer(), 1)
    texts = ["Hello, it's me!! 123", "", "a <|endoftext|>b <|startoftext|>", "été Ångström   nbsp", "日本語 テスト 👩‍👩‍👧", "don't you'll  WE'RE", LONG, "Éa×b÷ ÀÝÞß,,, a.b... 's' x's, É!!' ſK İI ÿ# e\u0301. a-\u0301 é=\u0338 .. A.|. <|endoftext|>... x<|endoftext|>! it'S O'Ré"]
    ids, bounds = coder.encode(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*coder.tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_block_coder_asks_for_all_candidates_first(spark):
    """Symbols that a context has had once are candidates too: three that follow each other at random cost little."""
    rng = np.random.default_rng(8)
    follow, draw, ids = rng.integers(0, 400, (400, 3)), rng.integers(0, 3, 20000), np.zeros(20000, "<u4")
    for i in range(1, len(ids)):
        ids[i] = follow[ids[i - 1], draw[i]]
    coded = spark.createDataFrame([(bytearray(ids.tobytes()),)], "b binary").select("b", block_coder.encode_block(spark, F.col("b")).alias("code"))
    row = coded.select("code", (block_coder.decode_block(spark, F.col("code")) == F.col("b")).alias("same")).first()
    assert row["same"] and len(row["code"]) < 6000  # 6,341 where each candidate is asked for by itself


def test_word_encoder_takes_few_arrays():
    """Words are hashed by eight bytes and not by sums over all bytes of the texts."""
    coder, rng = WordEncoder(op3_tokens.default_tokenizer(), 1), np.random.default_rng(3)
    text = " ".join(f"w{'abcdefghij'[a]}{'klmnopqrst'[b]}o" for a, b in rng.integers(0, 10, (60_000, 2))) + "|"
    texts = pa.array([text], pa.large_string())
    coder.encode(texts)
    tracemalloc.start()
    try:
        coder.encode(texts)
        assert tracemalloc.get_traced_memory()[1] < 24 * len(text)  # 31 times before, 17 since
    finally:
        tracemalloc.stop()


def test_word_encoder_of_long_words_and_many_stops():
    coder = WordEncoder(op3_tokens.default_tokenizer(), 1)
    head = "xY" * 32
    texts = [f"{head}a {head}b {head.upper()}A {head}|a {head}|b", "a" + "!" * 7 + " b" + "!" * 8 + " c" + "!" * 9 + " é" + "." * 40 + " " + "." * 40, "", "!" * 30, "12345678 123456789 1234567 A|b a|b A|B", "x" * 1000 + "." * 1000]
    texts += ["".join(rng.choice(list("aB.!|<>é× \n7"), rng.integers(0, 90))) for rng in [np.random.default_rng(4)] for _ in range(300)]
    for _ in range(2):
        ids, bounds = coder.encode(pa.array(texts, pa.large_string()))
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == [*coder.tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_token_files(spark, docs):
    coder = WordEncoder(op3_tokens.default_tokenizer(), 1).tokenizer
    want, start = [], 0
    for doc_id, text in sorted(((t[0], t[1] or "") for t in TEXTS), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*coder.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert rows_of(op3_tokens.token_digest(docs)) == sorted(want, key=repr)
    assert op3_tokens.token_digest(docs.limit(0)).count() == 0


def test_token_files_of_many_blocks(spark, docs, tmp_path):
    """Documents longer than a block and than a file, null ids, and damage."""
    coder = WordEncoder(op3_tokens.default_tokenizer(), 1).tokenizer
    folder = f"file://{tmp_path}/tokens"
    manifest = op3_tokens.write_tokens(docs, folder, op3_tokens.default_tokenizer(), file_tokens=500, block=64)
    got = op3_tokens.read_tokens(manifest, with_ids=True).collect()
    want = sorted((t[0] or -1, [*coder.encode(t[1] or "", add_special_tokens=False).ids, 1]) for t in TEXTS)
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in got) == want
    assert manifest.count() > 2 and manifest.agg(F.sum("n_docs")).first()[0] == len(TEXTS)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and r["n_tokens"] == len(r["ids"]) for r in got)
    path = manifest.orderBy(F.desc("n_bytes")).first()["path"]
    data = read_bytes(path)
    (tmp_path / "tokens" / path.rpartition("/")[2]).write_bytes(data[:-3] + bytes([data[-3] ^ 4]) + data[-2:])
    with pytest.raises(Exception, match="checksum differs"):
        op3_tokens.read_tokens(manifest).collect()


def test_token_tasks_have_one_worker(spark, docs, tmp_path):
    """Between two Python steps of the token files stands an exchange, and batches of decoded blocks are bounded by bytes."""

    def steps_between_exchanges(df):
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        return [part.count("MapInArrow") for part in plan.split("Exchange")]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    tokenizer = op3_tokens.default_tokenizer()
    coded = op3_tokens.coded_blocks(docs, tokenizer, 1, 500, 64)
    assert max(steps_between_exchanges(coded.mapInArrow(sizes, "n long"))) == 1
    order = [tuple(r) for r in coded.select("part", "first", F.col("block") < 0, "block").collect()]
    for part in {r[0] for r in order}:
        own = [r for r in order if r[0] == part]
        assert own == sorted(own) and {r[1] for r in own} == {r[1] for r in own if r[2]}
    manifest = op3_tokens.write_tokens(docs, f"file://{tmp_path}/tokens", tokenizer, file_tokens=500, block=64)
    each = steps_between_exchanges(op3_tokens.read_tokens(manifest))
    assert sum(each) == 2 and max(each) == 1
    large = spark.range(300).selectExpr("cast(repeat('x', 131072) as binary) as b").coalesce(1)
    assert max(r["n"] for r in large.mapInArrow(sizes, "n long").collect()) < 3 * op3_tokens.BATCH_BYTES


def test_token_file_checks():
    data = op3_tokens.pack_file(op3_tokens.pack_documents([1, None], [3, 1]), [b"abc", b"d"])
    documents, blocks = op3_tokens.unpack_file(data)
    assert op3_tokens.unpack_documents(documents) == ([1, None], [3, 1]) and blocks == [b"abc", b"d"]
    for at in (3, 25, 40):
        with pytest.raises(ValueError):
            op3_tokens.unpack_file(data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :])


def test_word_places():
    rng = np.random.default_rng(2)
    places, known = _Places(4), {}
    for _ in range(20):
        keys = np.unique(rng.integers(1, 3000, 400).astype(np.uint64) * np.uint64(64))  # many for one place
        found = places.find(keys)
        assert found.tolist() == [known.get(int(k), -1) for k in keys]
        new = keys[found < 0]
        places.add(new, np.arange(len(known), len(known) + len(new), dtype=np.int32))
        known.update(zip(map(int, new), range(len(known), len(known) + len(new)), strict=True))


# 4

def test_mix(spark, docs):
    got = op4_mix.mix_digest(docs).collect()
    assert len(got) == len(TEXTS)
    sizes = defaultdict(int)
    for t in TEXTS:
        sizes[t[3]] += len(split(t[1]))
    total = sum(sizes.values())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(total)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left, free = left - sum(3 * sizes[s] for s in over), free - over
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["n_copies"]
        taken[r["source"]] += r["taken"]
    for s in names:
        largest = max(len(split(t[1])) for t in TEXTS if t[3] == s)
        assert abs(taken[s] - target[s]) <= largest
    assert rows_of(op4_mix.mix_digest(docs)) == sorted((tuple(r) for r in got), key=repr)
    mixed = op4_mix.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["n_copies"] for r in got)
    assert op4_mix.mix_digest(docs.limit(0)).count() == 0


# 5

def shingles(text):
    w = [x.lower() for x in split(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_classes(texts):
    sets = [shingles(t[1]) for t in texts]
    links, parent = [0] * len(sets), list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    key = lambda i: (texts[i][0] is not None, texts[i][0] or 0)
    least = {}
    for i in range(len(sets)):
        least[root(i)] = min(least.get(root(i), i), i, key=key)
    return sorted(((t[0], texts[least[root(i)]][0], links[i]) for i, t in enumerate(texts)), key=repr)


def test_join_against_brute_force(spark, docs):
    got = rows_of(op5_jaccard.classes(docs).select("doc_id", "class_id", "n_links"))
    assert got == brute_classes(TEXTS)
    assert op5_jaccard.classes(docs.limit(0)).count() == 0
    kept = op5_jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == 14 - 1 - 1 - 1 - 1  # 2 and both rows of 3 go with 1 and one of 8 and 9 goes


def test_one_of_each_keeps_any_columns(spark):
    """Columns named like the operator's own, and rows alike in id and text that differ elsewhere."""
    text = " ".join(BASE)
    rows = [(2, text, "b", 1.0, [1]), (2, text, "a", None, None), (1, text + " more", "c", 2.0, []), (3, None, None, None, None), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string, row double, id array<int>").repartition(3)
    got = sorted((tuple(r) for r in op5_jaccard.one_of_each(docs).collect()), key=repr)
    assert got == sorted([(1, text + " more", "c", 2.0, []), (3, None, None, None, None)], key=repr)
    same = op5_jaccard.one_of_each(docs.where("doc_id = 2")).collect()
    assert [tuple(r) for r in same] == [(2, text, "a", None, None)]
    assert op5_jaccard.one_of_each(docs.limit(0)).columns == docs.columns


def test_join_of_large_groups_splits_and_blocks(spark, monkeypatch):
    """Groups beyond SMALL and BLOCK, with and without a passage that all share."""
    monkeypatch.setattr(op5_jaccard, "SMALL", 6)
    monkeypatch.setattr(op5_jaccard, "BLOCK", 16)
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(120)]
    shared = [f"p{i}" for i in range(30)]
    texts = []
    for i in range(70):  # near copies of each other
        own = list(base)
        own[int(rng.integers(0, 120))] = f"e{i}"
        texts.append((i, " ".join(own), "", ""))
    for i in range(70, 130):  # alike in a passage only
        texts.append((i, " ".join([*shared, *(f"q{i}x{k}" for k in range(60))]), "", ""))
    texts += [(200 + i, texts[i][1], "", "") for i in range(5)]
    docs = spark.createDataFrame(texts, SCHEMA).repartition(3)
    got = rows_of(op5_jaccard.classes(docs).select("doc_id", "class_id", "n_links"))
    assert got == brute_classes(texts)


def joined_by(edges):
    """The sets of nodes that edges join."""
    found = []
    for edge in edges:
        touched = [x for x in found if x & set(edge)]
        found = [x for x in found if not x & set(edge)] + [set(edge).union(*touched)]
    return sorted(map(sorted, found))


def test_blocks_join_chains_of_near_copies():
    """Links between two blocks may form chains that each row's smallest linked row would cut."""
    text = [f"t{i}" for i in range(40)]
    near = {1: 0, 4: 4, 3: 8, 2: 12}  # 1-4, 4-3 and 3-2 are links, others are not
    sets = {r: np.array([zlib.crc32(x.encode()) for x in [*text, *(f"e{i}" for i in range(60))][k : k + 40]], np.uint64) for r, k in near.items()}
    rows = [(r, 1, [7], np.unique(sets[r]), int(r % 2 == 0)) for r in (1, 3, 2, 4)]
    found = op5_jaccard.compare(7, rows)
    assert {r: k for r, _, k in found} == {1: 1, 2: 1, 3: 2, 4: 2}
    assert joined_by([(r, p) for r, p, _ in found]) == [[1, 2, 3, 4]]
    rng = np.random.default_rng(4)
    for _ in range(200):
        linked = rng.random((9, 7)) < 0.12
        numbers = rng.permutation(16)
        a, b = op5_jaccard.smallest_reached(linked, numbers[:9], numbers[9:])
        groups = joined_by([(int(numbers[i]), int(numbers[9 + j])) for i, j in np.argwhere(linked)] + [(int(x), int(x)) for x in numbers])
        want = {x: g[0] for g in groups for x in g}
        assert [want[x] for x in numbers.tolist()] == [*a, *b]


def test_join_of_chains_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(op5_jaccard, "SMALL", 2)
    monkeypatch.setattr(op5_jaccard, "BLOCK", 3)
    words = [f"c{i}" for i in range(400)]
    texts = [(i, " ".join(words[3 * i : 3 * i + 60]), "", "") for i in range(100)]
    docs = spark.createDataFrame(texts, SCHEMA).repartition(3)
    # chosen_buckets gives one bucket that all share
    one = lambda docs, reps, where: reps.select("row", F.lit(1).cast("long").alias("path"), F.lit(100).cast("long").alias("size"))
    monkeypatch.setattr(op5_jaccard, "chosen_buckets", one)
    got = rows_of(op5_jaccard.classes(docs).select("doc_id", "class_id", "n_links"))
    assert got == brute_classes(texts)


def test_crowded_links_are_found(spark, monkeypatch):
    """Pairs of the least similarity whose shingles stand in many other sets, so that buckets are split at all levels."""
    assert op5_jaccard.run_loss(op5_jaccard.LEVELS) ** op5_jaccard.RUNS <= 1 - op5_jaccard.RECALL
    monkeypatch.setattr(op5_jaccard, "SMALL", 3)
    rng = np.random.default_rng(11)
    passages = [" ".join(f"p{i}w{k}" for k in range(14)) for i in range(60)]
    texts = []
    for i in range(500):
        own = [passages[k] for k in rng.choice(60, 16, replace=False)]
        words = " ".join(own).split()
        texts += [(2 * i, " ".join(words), "", ""), (2 * i + 1, " ".join([*words, *(f"e{i}x{k}" for k in range(len(shingles(" ".join(words))) // 4))]), "", "")]
    got = op5_jaccard.classes(spark.createDataFrame(texts, SCHEMA).repartition(3)).select("doc_id", "class_id", "n_links")
    assert rows_of(got) == sorted(((i, i - i % 2, 1) for i in range(1000)), key=repr)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in parent}


def test_components_settle(spark, monkeypatch):
    """However many rounds a long chain takes, none of its nodes is left with another component."""
    monkeypatch.setattr("tidegraph.llm.components.MAX_ROUNDS", 2, raising=False)
    order = np.random.default_rng(3).permutation(200).tolist()
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    assert rows_of(components(edges)) == sorted(((i, 0) for i in range(200)), key=repr)


# 6

def test_warc(spark):
    pages = [(3, "http://a/", "x" * 200), (1, None, "x" * 200), (2, "http://b/\r\nEvil: 1", "x" * 200), (4, "u", "tiny"), (5, "u", "tiny"), (6, "u", None), (None, "u", "x" * 200), (7, "u", "é" * 60 + "WARC/1.1\r\n"), (1, None, "x" * 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(2)
    folder = op6_warc.scratch_dir(spark)
    manifest = op6_warc.write_warc(df, folder)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = []
    for page, _, html in pages:
        size = len((html or "").encode())
        first = 1 if html == "x" * 200 else page
        again = size >= 100 and first != page
        want.append((page, size, sha(html), "revisit" if again else "response", first if again else None))
    assert rows_of(op6_warc.read_warc(manifest)) == sorted(want, key=repr)
    assert op6_warc.read_gaps(manifest).count() == 0
    assert read_bytes(manifest.collect()[0]["path"])[:2] == b"\x1f\x8b"
    assert op6_warc.read_warc(op6_warc.write_warc(df.limit(0), op6_warc.scratch_dir(spark))).count() == 0


def test_query_logs_gaps(spark, tmp_path, monkeypatch, caplog):
    """The query itself writes what it could not read of a damaged archive."""
    spark.createDataFrame([(i, "u", f"{i}" * 300) for i in range(4)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    write, folders = op6_warc.write_warc, []

    def damaged(pages, folder):
        manifest = write(pages, folder)
        path = manifest.first()["path"]
        data = bytearray(read_bytes(path))
        data[30] ^= 0xFF
        op6_warc.write_bytes(path, bytes(data))
        folders.append(folder)
        return manifest

    monkeypatch.setattr(op6_warc, "write_warc", damaged)
    assert op6_warc.op6_warc(spark, str(tmp_path)).count() == 3
    logged = spark.read.parquet(f"{folders[0]}/quarantine").collect()
    assert len(logged) == 1 and logged[0]["start"] == 0 < logged[0]["stop"] and "quarantine" in caplog.text


def test_foreign_records_do_not_stop_the_reader(spark, tmp_path):
    """Records of other types are passed over; what has no type or no number is logged with its bytes."""
    page = op6_warc.pack_record(4, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False)
    revisit = op6_warc.pack_record(5, "u", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), 4, True)
    odd = [page.replace(b"response\r\nWARC-Record", b"metadata\r\nWARC-Record"), page.replace(b"WARC-Type", b"X-Type"), page.replace(b"X-Page-Id: 4", b"X-Page-Id: four"), revisit.replace(b"X-Refers-To-Page", b"X-Other")]
    parts = [op6_warc.gzip_member(x) for x in (*odd, page, revisit)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")
    assert [(r["page_id"], r["record_type"]) for r in op6_warc.read_warc(paths).orderBy("page_id").collect()] == [(4, "response"), (5, "revisit")]
    at = np.cumsum([0, *map(len, parts)]).tolist()
    assert [(r["start"], r["stop"]) for r in op6_warc.read_gaps(paths).orderBy("start").collect()] == [(at[i], at[i + 1]) for i in (1, 2, 3)]


def test_salvage():
    records = [op6_warc.pack_record(i, f"u{i}", bytes([65 + i]) * 300, hashlib.sha256(bytes([65 + i]) * 300).hexdigest(), None, False) for i in range(6)]
    members = [op6_warc.gzip_member(r) for r in records]
    for data, unit in ((b"".join(members), members), (b"".join(records), records)):
        assert len(op6_warc.salvage(data)[0]) == 6 and not op6_warc.salvage(data)[1]
        broken = bytearray(data)
        at = len(unit[0]) + len(unit[1]) - 30
        broken[at] ^= 0xFF
        found, gaps = op6_warc.salvage(bytes(broken))
        assert [r.headers["x-page-id"] for r in found] == ["0", "2", "3", "4", "5"]
        assert [(g[0], g[1]) for g in gaps] == [(len(unit[0]), len(unit[0]) + len(unit[1]))]
        found, gaps = op6_warc.salvage(data[: -len(unit[5]) // 2] )
        assert len(found) == 5 and gaps[-1][1] == len(data[: -len(unit[5]) // 2])
        found, gaps = op6_warc.salvage(b"noise" + data)
        assert len(found) == 6 and gaps[0][:2] == (0, 5)
    assert op6_warc.salvage(b"") == ([], [])


def test_salvage_keeps_intact_records_of_a_damaged_member():
    rng = np.random.default_rng(8)
    bodies = [rng.integers(0, 256, 9000, dtype=np.uint8).tobytes() for _ in range(6)]
    records = [op6_warc.pack_record(i, f"u{i}", b, hashlib.sha256(b).hexdigest(), None, False) for i, b in enumerate(bodies)]
    many, last = op6_warc.gzip_member(b"".join(records[:5])), op6_warc.gzip_member(records[5])
    pages = lambda found: [r.headers["x-page-id"] for r in found]
    for cut in (1, 8, 9, 100):
        found, gaps = op6_warc.salvage(many[:-cut])
        assert pages(found) == (["0", "1", "2", "3", "4"] if cut < 9 else pages(found)) and len(found) >= 4
        assert len(gaps) == 1 and len(many) - 10000 < gaps[0][0] < gaps[0][1] == len(many) - cut
    wrong = bytearray(many)
    wrong[-6] ^= 0xFF  # the crc32
    found, gaps = op6_warc.salvage(bytes(wrong) + last)
    assert pages(found) == ["0", "1", "2", "3", "4", "5"]
    assert len(gaps) == 1 and len(many) - 20 < gaps[0][0] < gaps[0][1] == len(many)
    wrong = bytearray(many)
    wrong[len(many) // 2] ^= 0xFF  # in the third record
    found, gaps = op6_warc.salvage(bytes(wrong) + last)
    assert pages(found)[:2] == ["0", "1"] and pages(found)[-1] == "5" and "2" not in pages(found) and len(set(pages(found))) == len(found)
    assert len(gaps) >= 1 and gaps[0][0] > len(many) // 3


# 7

def brute_hits(texts, items):
    norm = lambda t: [w for w in __import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]
    wins = defaultdict(set)
    for item, t in items:
        w = norm(t)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins[tuple(w[i : i + k])].add("" if item is None else str(item))
    out = []
    for t in texts:
        w, hit, who = norm(t[1]), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if found := wins.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    who |= found
        names = ",".join(sorted(who))
        out.append((t[0], len(w), len(hit), len(who), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEMS = [(1, " ".join(BASE[2:18])), (2, "Short, text!"), (10, " ".join(BASE[5:20])), (3, ""), (4, None), (5, "x3 w34 x4 w35 x5 w36 x6 w37 x7 w38 x8 w39 x9 w40 x10"), (None, "MIT license")]


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_decontamination(spark, docs, monkeypatch, broadcast):
    monkeypatch.setattr(op7_decontaminate, "BROADCAST_ROWS", broadcast)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = op7_decontaminate.decontaminate_digest(docs, items)
    assert rows_of(got) == brute_hits(TEXTS, ITEMS)
    clean = op7_decontaminate.decontaminate(docs, items)
    bad = sum(r[-1] for r in brute_hits(TEXTS, ITEMS))
    assert clean.columns == docs.columns and clean.count() == len(TEXTS) - bad
    spans = {r["doc_id"]: r["text"] for r in op7_decontaminate.decontaminate(docs, items, "spans").collect()}
    assert spans[7].strip() == "" and spans[8] is not None and spans[4] is None
    assert op7_decontaminate.decontaminate_digest(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert op7_decontaminate.decontaminate_digest(docs.limit(0), items).count() == 0


# 8

def brute_rules(doc_id, text):
    text = text or ""
    w = [x.decode() for x in split(text)]
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    repeat = {p for s in seen.values() if len(s) > 1 for i in s for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if split(x)]
    chars = sum(map(len, w))
    base = (len(w), chars, sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat))
    failed = len(w) < 20 or 100 * len(repeat) > 30 * len(w)
    upper, letters = sum("A" <= c <= "Z" for c in text), sum(c.isascii() and c.isalpha() for c in text)
    other = 10 * base[2] > len(w) or 100 * base[3] > 30 * len(lines) or 100 * upper > 50 * max(letters, 1) or 100 * sum(a == b for a, b in zip(w, w[1:], strict=False)) > 25 * len(w) or chars > 20 * len(w) or chars < 2 * len(w)
    return (doc_id, *base, failed, not failed and not other)


def test_rules(spark, docs):
    want = sorted((brute_rules(t[0], t[1]) for t in TEXTS), key=repr)
    assert rows_of(op8_rules.score_rules(docs)) == want
    kept = op8_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[-1] for r in want)
    assert op8_rules.score_rules(docs.limit(0)).count() == 0


def test_rules_in_any_order_agree():
    texts = pa.array([t[1] or "" for t in TEXTS], pa.large_string())
    one = op8_rules.cascade(texts, op8_rules.RULES)
    assert (one == op8_rules.cascade(texts, op8_rules.RULES[::-1])).all()
    rules = tuple(r for r in op8_rules.RULES if r.name in ("short", "repeats", "symbols"))
    # rejected by none: 40; by short alone 25, by short and repeats 20, by repeats alone 5, by symbols alone 10
    sets = {0: 40, 1: 25, 3: 20, 2: 5, 4: 10}
    names = lambda seconds: [r.name for r in op8_rules.order_rules(dict(enumerate(seconds)), sets, rules)]
    assert names((1.0, 1.0, 1.0)) == ["short", "symbols", "repeats"]  # behind short, repeats rejects 5 and symbols 10
    assert names((9.0, 1.0, 1.0)) == ["repeats", "symbols", "short"]
    assert [r.name for r in op8_rules.order_rules({}, {}, rules)] == ["repeats", "short", "symbols"]
    got = op8_rules.measure(texts, rules).to_pylist()
    assert sum(r["n"] for r in got if r["rule"] < 0) == len(TEXTS)
    for i, rule in enumerate(rules):
        assert sum(r["n"] for r in got if r["rule"] < 0 and r["rejected"] >> i & 1) == rule.reject(op8_rules.Texts(texts)).sum()


def test_rules_are_ordered_by_a_sample(spark, docs, monkeypatch):
    monkeypatch.setattr(op8_rules, "SAMPLE_ROWS", 5)
    assert sorted(r.name for r in op8_rules.sample_order(docs)) == sorted(r.name for r in op8_rules.RULES)
    assert len(op8_rules.sample_order(docs.limit(0))) == len(op8_rules.RULES)


# 9

def test_sections(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coder = op9_sections.span_encoder(path, public_tokenizers.PATTERN)
    got = {(r["doc_id"], r["n_tokens"]): r for r in op9_sections.count_sections(docs, path, public_tokenizers.PATTERN).collect()}
    for doc_id, text, *_ in TEXTS:
        ids = coder.encoding.encode_ordinary(text or "")
        r = got[doc_id, len(ids)]
        lines = (text or "").split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        owner, at, bounds = Counter(), 0, np.cumsum([len(x.encode()) for x in lines])
        for t in ids:
            size = len(coder.encoding.decode_single_token_bytes(t))
            inside = [int(np.searchsorted(bounds, p, side="right")) for p in range(at, at + size)]
            owner[max(sorted(set(inside)), key=inside.count)] += 1
            at += size
        assert r["section_tokens"] == [owner[i] for i in range(len(lines))] and r["n_sections"] == len(lines)
    counts, crossing = op9_sections.attribute(np.array([4, 6]), np.array([3, 5, 6]))
    assert counts.tolist() == [1, 1, 0] and crossing == 2


# 10

def test_fields(spark, docs):
    """Tokens of fields that are encoded as one text, against the bytes of each token."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coder = op9_sections.span_encoder(path, public_tokenizers.PATTERN)
    rows = [(1, "A title", "the body\nin lines", "x"), (2, None, "é" * 50, None), (3, "", "", ""), (4, "no", None, "end  "), (4, "no", None, "end  "), (5, "t", LONG, "y")]
    table = spark.createDataFrame(rows, "doc_id long, title string, text string, ends string")
    got = op9_sections.count_fields(table, ["title", "text", "ends"], path, public_tokenizers.PATTERN, "")
    want = []
    for doc_id, *fields in rows:
        fields = [(f or "").encode() for f in fields]
        ids = coder.encoding.encode_ordinary(b"".join(fields).decode())
        owner = [i for i, f in enumerate(fields) for _ in f]
        counts, at, crossing = [0] * 3, 0, 0
        for t in ids:
            own = owner[at : at + len(coder.encoding.decode_single_token_bytes(t))]
            at += len(own)
            counts[max(sorted(set(own)), key=own.count)] += 1
            crossing += len(set(own)) > 1
        want.append((doc_id, len(ids), 3, crossing, counts))
    assert rows_of(got) == sorted(want, key=repr)
    assert op9_sections.count_fields(table.limit(0), ["title"], path, public_tokenizers.PATTERN).count() == 0
    assert op9_sections.count_sections(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_licenses(spark, docs):
    """Against brute force for the base scan, and against the SQL for all columns."""
    got = rows_of(op10_license.scan_licenses(docs))
    want = []
    for doc_id, text, *_ in TEXTS:
        w = op_words(text)
        places = {label: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p, label in op10_license.BASE.items()}
        every = [i for x in places.values() for i in x]
        want.append((doc_id, len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(k for k, v in places.items() if v))))
    assert sorted((r[:6] for r in got), key=repr) == sorted(want, key=repr)
    assert all(set(filter(None, r[5].split(","))) <= set(filter(None, r[6].split(","))) and 0 <= r[7] <= 1 for r in got)
    assert licenses_by_sql(TEXTS) == got
    assert op10_license.scan_licenses(docs.limit(0)).count() == 0


def licenses_by_sql(rows):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    return sorted(con.execute(oracles.LICENSES).fetchall(), key=repr)


def test_license_texts(spark):
    whole = {label: text for label, text, _ in op10_license.TEMPLATES if len(text.split()) > 40}
    filler = "plain words about nothing of note stand here again "
    more = [
        ("cc-by-nc", "Licensed under CC BY-NC 4.0."), ("bsd", "x " * 50 + "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        ("", "we met the license office and were permitted in"), ("gpl", "This work is licensed under the GNU General Public License, version 3."),
        ("", "unless required by applicable law or agreed to in writing software " + filler), ("", ""), ("", None),
        ("gpl,mit", f"{filler} {whole['mit']} {filler * 3} {whole['gpl']}"), ("mit", whole["mit"].replace("sublicense", "s").replace("merge", "blend") + " " + filler),
        ("proprietary", "All rights reserved. " * 3000),
    ]
    # "general public license" is a base phrase, whose label stays
    also = {"agpl": "agpl,gpl", "lgpl": "gpl,lgpl"}
    more += [(also.get(label, label), f"{filler * (i % 4)}{text.upper()}") for i, (label, text) in enumerate(sorted(whole.items()))]
    rows = [(i, text) for i, (_, text) in enumerate(more)] + [(100 + i, filler) for i in range(40)]
    got = rows_of(op10_license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert {r[0]: r[6] for r in got if r[0] < 100} == {i: label for i, (label, _) in enumerate(more)}
    assert got == licenses_by_sql(rows)
    assert all(r[7] == 1 for r in got if len(more) - len(whole) <= r[0] < 100)


def op_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
