"""The pipeline against a brute-force version of all its stages."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_classes, brute_hits, brute_rules, split
from tidegraph.llm.op3_tokens import default_tokenizer
from tidegraph.llm.tokenizing import WordEncoder


def brute_copies(rows):
    """Copies of each row by the mix's rule."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(split(r[1]))
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in over} if over else {s: weight[s] * level for s in free}
        left, free = left - sum(3 * sizes[s] for s in over), (free - over if over else set())
    md5 = lambda b: hashlib.md5(b).hexdigest()
    u = lambda r: int(md5(f"{r[0]}:{md5(r[1].encode())}".encode())[:12], 16)
    out = {}
    for s in names:
        whole = math.floor(min(round(target[s] / sizes[s], 9), 3)) if sizes[s] else 0
        rest, upto = target[s] - whole * sizes[s], 0
        for i in sorted((i for i, r in enumerate(rows) if r[3] == s), key=lambda i: u(rows[i])):
            size = len(split(rows[i][1]))
            upto += size
            out[i] = whole + (whole < 3 and size > 0 and rest > 0 and upto - size / 2 <= rest)
    return [out[i] for i in range(len(rows))]


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(4)
    vocabulary = [f"v{chr(97 + i % 26)}{i}" for i in range(400)]
    prose = lambda n: [vocabulary[i] for i in rng.integers(0, 400, n)]
    bench = prose(40)
    rows = []
    for i in range(60):
        words = prose(int(rng.integers(25, 200)))
        if i % 9 == 0:
            words = [*words[:40], *bench[5:25], *words[40:]]
        if i % 11 == 0:
            words = [w + "#%$" for w in words]
        rows.append((i, " ".join(words), "en", [None, "a", "b", "c", "a"][i % 5]))
    for i in range(60, 75):  # copies and near copies
        words = rows[i - 60][1].split(" ")
        if i % 2:
            words[3] = "changed"
        rows.append((i, " ".join(words), "fr", "a"))
    rows += [(80, None, None, None), (81, "", "en", "b"), (82, "too short", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(bench)), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [r for r in rows if brute_rules(r[0], r[1])[-1]]
    kept = [r for r in kept if r[0] in {c for _, c, _ in brute_classes(kept)}]
    bad = {h[0] for h in brute_hits(kept, [(0, " ".join(bench)), (1, None)]) if h[-1]}
    kept = [r for r in kept if r[0] not in bad]
    assert bad and len(kept) > 30
    tokenizer, want, start = WordEncoder(default_tokenizer(), 1).tokenizer, [], 0
    for r, n in sorted(zip(kept, brute_copies(kept), strict=True), key=lambda x: x[0][0]):
        ids = np.array([*tokenizer.encode(r[1], add_special_tokens=False).ids, 1], "<u4")
        for _ in range(n):
            want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)

    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
        stage = spark.createDataFrame(stage.collect(), docs.schema)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, ties, columns that clash, and empty tables."""
    text = " ".join(f"word{i % 23} other{i}" for i in range(60))
    rows = [
        (1, text, "en", "a", 5, "k", 1), (1, text, "en", "a", 5, "k", 1), (None, text + " x", None, None, None, None, None), (2, None, None, None, None, None, 2),
        (3, "", "en", "a", 0, "", 3), (4, " ".join(f"long{i} w{i % 613}" for i in range(30000)), "en", "b", 1, "z", 4), (5, text.upper() + " one two three", "en", "a", 1, "z", 4),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `key` string, `row` int")
    bench = spark.createDataFrame([(1, " ".join(f"long{i} w{i}" for i in range(500, 520))), (None, None), (1, "a b"), (2, "")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    bench.limit(0).write.parquet(f"{tmp_path}/none/benchmark.parquet")
    for name, f in corpus_pipeline.STAGES:
        for where in (tmp_path, tmp_path / "none"):
            got, none = f(spark, docs, str(where)), f(spark, docs.limit(0), str(where))
            assert none.count() == 0, name
            if f is corpus_pipeline.token_files:
                assert got.count() == len(rows)
                continue
            assert got.columns == docs.columns and none.columns == docs.columns
            kept = [tuple(r) for r in got.collect()]
            assert set(map(repr, kept)) <= set(map(repr, rows)), name
            if f is corpus_pipeline.near_duplicates:
                assert sorted(r[0] or -1 for r in kept) == [-1, 2, 3, 4]  # the null id sorts first, so it stands for 1 and 5
            if f is corpus_pipeline.quality_rules:
                assert sorted(r[0] or -1 for r in kept) == [-1, 1, 1, 4]
