"""Token ids of whole texts in files of range-coded blocks.

Documents are dealt by ranges of doc_id and sorted, so the files of one partition after
another hold them in ascending order. A task encodes its texts with the tokenizers library,
appends the end id to each document, cuts the ids of all documents into blocks of BLOCK ids and
closes a file whenever FILE_TOKENS ids have come together, always at the end of a document.
The coder (block_coder) turns each block into bytes and back; only one block at a time is held as ids.
Coded blocks are exchanged before they are written, and after they are read, so that a task has one
Python worker at a time, and the tasks that encode write no tables.
The rows that the write stage returns are the manifest; only files named there are read, so files
of lost attempts do no harm.

File: magic, length and crc32 of the index, the index (documents with id, ids and a null mark;
the blocks' lengths), then the blocks, each with its own crc32.

Defined results: a null text is empty and holds the end id alone; a null doc_id comes first
and is read back as null; documents of one id keep the order of their texts' hashes, rows alike
in both are interchangeable; a very long text spans blocks, its ids are never held together;
an empty table gives no file and no row; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.llm.block_coder import decode_block, encode_block
from tidegraph.llm.common import arrow_rows, materialise, read, release_memory, scratch_dir, steps
from tidegraph.llm.files import read_bytes, write_bytes
from tidegraph.llm.tokenizing import encoder

MAGIC = b"TGID0004"
END_ID = 1
#: Ids of a block, and ids after which a file is closed.
BLOCK = 1 << 15
FILE_TOKENS = BLOCK * 192
#: Bytes of text that are encoded at once; the arrays about them took 17 times as much on a text of short words.
STEP_BYTES = 1 << 19
#: Blocks that travel in one batch, and the number that marks a row with the documents of a file.
BATCH_BLOCKS = 16
DOCUMENTS = -1
#: Bytes of an Arrow batch: decoded blocks are much larger than the rows that ARROW_ROWS bounds.
BATCH_BYTES = 1 << 22
PARTS = "first long, block int, data binary"


def pack_documents(doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The documents of a file: number, ids, null marks, lengths."""
    return b"".join([struct.pack("<Q", len(doc_ids)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array(lengths, "<u8").tobytes()])


def unpack_documents(data: bytes) -> tuple[list[int | None], list[int]]:
    (n,) = struct.unpack_from("<Q", data)
    ids = np.frombuffer(data, "<i8", n, 8).tolist()
    null = np.frombuffer(data, np.uint8, n, 8 + 8 * n).tolist()
    return [None if x else d for d, x in zip(ids, null, strict=True)], np.frombuffer(data, "<u8", n, 8 + 9 * n).tolist()


def pack_file(documents: bytes, blocks: list[bytes]) -> bytes:
    """A file of packed documents and coded blocks."""
    head = struct.pack("<QQ", len(documents), len(blocks)) + documents + np.array([len(b) for b in blocks], "<u8").tobytes()
    return b"".join([MAGIC, struct.pack("<QI", len(head), zlib.crc32(head)), head, *blocks])


def unpack_file(data: bytes) -> tuple[bytes, list[bytes]]:
    """The packed documents and coded blocks of a file; ValueError where the index is damaged."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    size, crc = struct.unpack_from("<QI", data, 8)
    head = data[20 : 20 + size]
    if len(head) != size or zlib.crc32(head) != crc:
        raise ValueError("index: checksum differs")
    n, k = struct.unpack_from("<QQ", head)
    ends = 20 + size + np.cumsum(np.frombuffer(head, "<u8", k, 16 + n).astype(np.int64))
    return head[16 : 16 + n], [data[a:b] for a, b in zip([20 + size, *ends[:-1].tolist()], ends.tolist(), strict=True)] if k else []


def _arrow_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch."""
    arrow_rows(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class _Batches:
    """Rows (first, block, data) gathered into batches of some blocks."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, bytes | memoryview]] = []

    def add(self, first: int, block: int, data: bytes) -> Iterator[pa.RecordBatch]:
        self.rows.append((first, block, data))
        if len(self.rows) >= BATCH_BLOCKS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            first, block, data = zip(*self.rows, strict=True)
            self.rows = []
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(block, pa.int32()), pa.array(data, pa.binary())], names=["first", "block", "data"])


def id_blocks(docs: DataFrame, tokenizer: str, end_id: int, file_tokens: int, size: int) -> DataFrame:
    """PARTS rows, in order: the blocks of ids of each file (first: the file's number), then its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, out, seq, block = encoder(tokenizer, end_id), _Batches(), 0, 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held, n_held, n_file = [], 0, 0

        def put(ids: np.ndarray, close: bool) -> Iterator[pa.RecordBatch]:
            """Take the ids of whole documents on; a closed file ends with a shorter block."""
            nonlocal held, n_held, n_file, block, seq, doc_ids, lengths
            held.append(ids)
            n_held += len(ids)
            if n_held >= size or close:
                every = np.concatenate(held)
                stop = len(every) if close else len(every) // size * size
                for at in range(0, stop, size):
                    yield from out.add(seq, block, every[at : min(at + size, stop)].astype("<u4").tobytes())
                    block += 1
                held, n_held = [every[stop:]], len(every) - stop
            if close:
                yield from out.add(seq, DOCUMENTS, pack_documents(doc_ids, lengths))
                doc_ids, lengths, n_file, block, seq = [], [], 0, 0, seq + 1

        for batch in batches:
            for piece, texts in steps(batch, "text", STEP_BYTES):
                ids, bounds = coder.encode(texts)
                names, start = piece.column(0).to_pylist(), 0
                while start < len(names):
                    # up to the first document that fills a file
                    stop = int(np.searchsorted(bounds, bounds[start] + file_tokens - n_file, side="left"))
                    stop = min(max(stop, start + 1), len(names))
                    doc_ids += names[start:stop]
                    lengths += np.diff(bounds[start : stop + 1]).tolist()
                    n_file += int(bounds[stop] - bounds[start])
                    yield from put(ids[bounds[start] : bounds[stop]], n_file >= file_tokens)
                    start = stop
        if doc_ids:
            yield from put(np.zeros(0, np.int32), True)
        yield from out.flush()

    return docs.mapInArrow(run, PARTS)


def coded_blocks(docs: DataFrame, tokenizer: str, end_id: int, file_tokens: int, block: int) -> DataFrame:
    """PARTS rows of docs (doc_id, text) with the task that made them as part; those of a part stand together, in order, a file's documents last."""
    spark = docs.sparkSession
    _arrow_batches(spark)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    dealt = keyed.repartitionByRange("doc_id", "key", F.monotonically_increasing_id()).sortWithinPartitions("doc_id", "key").select(F.col("doc_id").cast("long"), "text")
    blocks = id_blocks(dealt, tokenizer, end_id, file_tokens, block)
    data = F.when(F.col("block") >= 0, encode_block(spark, F.col("data"))).otherwise(F.col("data")).alias("data")
    coded = blocks.select(F.spark_partition_id().alias("part"), "first", "block", data)
    return coded.repartition("part").sortWithinPartitions("part", "first", F.col("block") < 0, "block")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, file_tokens: int = FILE_TOKENS, block: int = BLOCK) -> DataFrame:
    """Write the files of docs (doc_id, text) below folder; returns the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        held = []
        for batch in batches:
            for part, seq, number, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if number >= 0:
                    held.append(data)
                    continue
                path = f"{folder}/part-{part:06d}-{seq:06d}-{uuid.uuid4().hex[:8]}.tgid"
                lengths, whole = unpack_documents(data)[1], pack_file(data, held)
                write_bytes(path, whole)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [path], "n_docs": [len(lengths)], "n_tokens": [sum(lengths)], "n_bytes": [len(whole)]})
                held = []

    coded = coded_blocks(docs, tokenizer, end_id, file_tokens, block)
    return materialise(coded.mapInArrow(run, "part int, seq int, path string, n_docs long, n_tokens long, n_bytes long"), "manifest", folder)


def file_parts(placed: DataFrame) -> DataFrame:
    """PARTS rows of files (path, first): each file's documents (first: the ids of all files before it), then its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        out = _Batches()
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                documents, blocks = unpack_file(read_bytes(path))
                yield from out.add(first, DOCUMENTS, documents)
                for i, data in enumerate(blocks):
                    yield from out.add(first, i, data)
        yield from out.flush()

    return placed.mapInArrow(run, PARTS)


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (and ids). A damaged block raises ValueError."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row a partition of the write stage
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = Window.partitionBy("part").orderBy("seq")
    placed = manifest.join(before, "part").select("path", (F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("first"))
    spark = manifest.sparkSession
    n_files = manifest.count()
    tasks = max(1, min(n_files, 100_000))
    placed = placed.repartition(tasks, "path")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    _arrow_batches(spark)
    # a file's documents, then its blocks
    each = file_parts(placed).repartition(tasks, "first").sortWithinPartitions("first", "block")
    decoded = each.select("first", "block", F.when(F.col("block") >= 0, decode_block(spark, F.col("data"))).otherwise(F.col("data")).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        at = have = crc = start = 0  # the next document, its ids so far, their crc32, and where it starts
        pieces: list[np.ndarray] = []
        for batch in batches:
            rows: list[tuple] = []
            for first, number, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if number == DOCUMENTS:
                    if at < len(doc_ids):
                        raise ValueError("a file holds fewer ids than its documents")
                    (doc_ids, lengths), at, have, crc, start = unpack_documents(data), 0, 0, 0, first
                    continue
                if data is None:
                    raise ValueError(f"block {number}: checksum differs")
                place, n = 0, len(data) // 4
                while place < n:
                    if at == len(doc_ids):
                        raise ValueError("a file holds more ids than its documents")
                    take = min(lengths[at] - have, n - place)
                    piece = data[4 * place : 4 * (place + take)]
                    crc = zlib.crc32(piece, crc)
                    if with_ids:
                        pieces.append(np.frombuffer(piece, "<u4").astype(np.int32))
                    have, place = have + take, place + take
                    if have == lengths[at]:
                        rows.append((doc_ids[at], start, have, crc, *([np.concatenate(pieces)] if with_ids else [])))
                        at, have, crc, start, pieces = at + 1, 0, 0, start + have, []
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split(" ")[0] for x in schema.split(", ")])
        if at < len(doc_ids):
            raise ValueError("a file holds fewer ids than its documents")

    return decoded.mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_digest(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write docs as token files and return the digest read back from them."""
    manifest = write_tokens(docs.select("doc_id", "text"), scratch_dir(docs.sparkSession), tokenizer or default_tokenizer(), end_id)
    return read_tokens(manifest)


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(read(spark, sf_dir, "documents", "doc_id", "text"))
