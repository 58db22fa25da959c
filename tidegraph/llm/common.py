"""What the operators share: table readers, Arrow batch helpers, and the scratch folder of the library."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.scratch import materialise, scratch_dir

__all__ = ["KEPT", "arrow_rows", "fold_of", "materialise", "read", "release_memory", "scratch_dir", "steps"]

#: Rows handed to Python at once. Texts are a few kB, long ones 100 kB and more.
ARROW_ROWS = 1000
#: Bytes of text that one vectorised step works on; a single longer text is its own step.
STEP_BYTES = 1 << 20


def arrow_rows(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


#: Clears what operators keep in a worker between tasks.
KEPT: list[Callable[[], None]] = []


def release_memory() -> None:
    """Give memory back that earlier tasks hold in this worker.

    Spark hands a worker from stage to stage, with the tokenizer that one stage has loaded and the free
    memory of its arrays; a stage that needs neither begins with this.
    """
    for clear in KEPT:
        clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def fold_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of a batch whose texts hold about `limit` bytes, with the texts (null: empty) as large_string."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    lengths = texts.cast(pa.large_binary()).buffers()[1]
    ends = np.frombuffer(lengths, dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield batch.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop
