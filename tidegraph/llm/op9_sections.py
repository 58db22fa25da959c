"""Token counts of a document's sections by offset-mapped attribution.

A whole text is encoded once with a byte-level tokenizer, whose tokens cover every byte, so the
lengths of the tokens give their character spans. Sections are character spans that cover the
text: each line with its line end, or each of several fields that are encoded as one text. Spans are joined by their bounds, and a token
that crosses one belongs to the section that holds most of its bytes, of equals to the earlier.

Defined results: a null or empty text has no sections and no tokens; a text that ends in a line
end has no empty section behind it; repeated rows are counted one by one; a very long
text is encoded as a whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import arrow_rows, read, steps

SCHEMA = "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>"


class SpanEncoder:
    """Ids of whole texts with the byte span of each token."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The byte offset behind each token."""
        ids = self.encoding.encode_to_numpy(text, disallowed_special=())
        return np.cumsum(self.length[ids])


_encoders: dict[str, SpanEncoder] = {}


def span_encoder(path: str, pattern: str) -> SpanEncoder:
    if path not in _encoders:
        _encoders[path] = SpanEncoder(path, pattern)
    return _encoders[path]


def line_sections(raw: np.ndarray) -> np.ndarray:
    """Byte offsets behind each section: lines with their line ends."""
    ends = np.flatnonzero(raw == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) or not len(raw) else np.append(ends, len(raw))


def attribute(token_ends: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens of each section, and the number of tokens that cross a bound.

    Both arrays rise and end at the length of the text.
    """
    counts = np.zeros(len(section_ends), np.int64)
    if not len(token_ends):
        return counts, 0
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    owner = first.copy()
    cross = np.flatnonzero(first != last)
    for i in cross.tolist():
        spans = range(int(first[i]), int(last[i]) + 1)
        held = [min(token_ends[i], section_ends[s]) - max(starts[i], section_ends[s - 1] if s else 0) for s in spans]
        owner[i] = spans[int(np.argmax(held))]
    return np.bincount(owner, minlength=len(section_ends)).astype(np.int64), len(cross)


def _counted(docs: DataFrame, tokenizer: str, pattern: str, sections: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    """SCHEMA rows of docs (doc_id, text, and without `sections` the array ends)."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = span_encoder(tokenizer, pattern)
        for batch in batches:
            for part, texts in steps(batch, "text"):
                given = [None] * len(texts) if sections is not None else part.column(2).to_pylist()
                counts, crossing, total = [], [], []
                for text, bounds in zip(texts.to_pylist(), given, strict=True):
                    ends = coder.ends(text)
                    found, crossed = attribute(ends, sections(np.frombuffer(text.encode(), np.uint8)) if bounds is None else np.array(bounds))
                    counts.append(found)
                    crossing.append(crossed)
                    total.append(len(ends))
                sizes = np.array([len(c) for c in counts])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(counts), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(total, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crossing, pa.int64()), lists], names=["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    return docs.mapInArrow(run, SCHEMA)


def count_sections(docs: DataFrame, tokenizer: str, pattern: str, sections: Callable[[np.ndarray], np.ndarray] = line_sections) -> DataFrame:
    """Per row of docs (doc_id, text): n_tokens, n_sections, n_crossing, section_tokens in order."""
    return _counted(docs.select("doc_id", "text"), tokenizer, pattern, sections)


def count_fields(docs: DataFrame, fields: list[str], tokenizer: str, pattern: str, separator: str = "\n") -> DataFrame:
    """The same for fields of a document, encoded as one text: each field with the separator behind it is a section.

    A null field is empty and may still hold its separator's token.
    """
    behind = [separator] * (len(fields) - 1) + [""]
    parts = [F.concat(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit(s)) for c, s in zip(fields, behind, strict=True)]
    ends = [reduce(lambda a, b: a + b, [F.octet_length(p) for p in parts[: i + 1]]).cast("long") for i in range(len(parts))]
    return _counted(docs.select("doc_id", F.concat(*parts).alias("text"), F.array(*ends).alias("ends")), tokenizer, pattern, None)


def op9_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_sections(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
