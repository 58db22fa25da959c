"""WARC archives of pages: writing with revisits, and a reader that salvages damaged files.

Each record is a gzip member of its own. Of records with equal payloads of REVISIT_BYTES and
more, the one with the smallest page_id is a response and the others are revisits of it.

The reader checks each member's crc32, its header and its block digest. After a failed check it
searches for the next offset at which a member decompresses to a version line (in a file that
is not compressed: for the next version line), goes on there, and logs the bytes between as a
quarantined gap. Of a member that is damaged or cut off, the records that came out of it and whose
block digests hold are kept. Only file parts that fail are lost. Records of other types than
response and revisit are passed over; one without a type or with a number that is none is logged
as a gap.

Defined results: a null html is an empty payload; a null url writes no target; a null page_id is
kept as null, and such a page is a response only where no page with an id has its payload;
repeated rows of the smallest page_id are all responses and, being the same record, have one
record id; a very long html is one record; an empty table writes no file; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import logging
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import arrow_rows, materialise, read, scratch_dir
from tidegraph.llm.files import read_bytes, write_bytes

REVISIT_BYTES = 100
#: A file is closed when its compressed records reach this size.
FILE_BYTES = 32 << 20
#: Parts in which a group of equal payloads is dealt.
SALT = 32
#: Bytes of a member that are decompressed at once.
PIECE_BYTES = 16 << 10
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"

RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
GAP_SCHEMA = "path string, start long, stop long, reason string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def pack_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    start: int = field(default=0, compare=False)  # the bytes of the file that it, or the member around it, takes
    stop: int = field(default=0, compare=False)

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def parse_record(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at an offset and the offset behind it; ValueError where a check fails."""
    if not _VERSION.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header has no end")
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise ValueError("no content length")
    stop = end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where it should")
    block = data[end + 4 : stop]
    digest = headers.get("warc-block-digest")
    if digest and digest != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError("block digest differs")
    return Record(headers, block), stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at an offset decompresses to, the offset behind that, and why it fails, if it does."""
    view, out, pos, unpacker = memoryview(data), [], at, zlib.decompressobj(31)
    try:
        while not unpacker.eof and pos < len(data):
            out.append(unpacker.decompress(view[pos : pos + PIECE_BYTES]))
            pos = min(pos + PIECE_BYTES, len(data))
    except zlib.error as error:
        got, broken = _unpacked(data, at, pos, min(pos + PIECE_BYTES, len(data)))
        return got, broken, str(error)
    if not unpacker.eof:
        return b"".join(out), len(data), "member is cut off"
    return b"".join(out), pos - len(unpacker.unused_data), ""


def _unpacked(data: bytes, at: int, whole: int, stop: int) -> tuple[bytes, int]:
    """What a damaged member gives byte by byte from an offset on, and where it fails."""
    view, unpacker = memoryview(data), zlib.decompressobj(31)
    out = [unpacker.decompress(view[at:whole])]
    for pos in range(whole, stop):
        try:
            out.append(unpacker.decompress(view[pos : pos + 1]))
        except zlib.error:
            return b"".join(out), pos
    return b"".join(out), stop


def _packed_bytes(data: bytes, at: int, stop: int, size: int) -> int:
    """The offset at which a member has given its first size bytes."""
    unpacker, given, view = zlib.decompressobj(31), 0, memoryview(data)
    while at < stop and given < size:
        given += len(unpacker.decompress(view[at : at + 1]))
        at += 1
    return at


def _starts_record(data: bytes, at: int) -> bool:
    try:
        return bool(_VERSION.match(zlib.decompressobj(31).decompress(memoryview(data)[at : at + 4096], 64)))
    except zlib.error:
        return False


def salvage(data: bytes) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """All records that pass their checks, and the gaps (start, stop, reason) between them."""
    records: list[Record] = []
    gaps: list[tuple[int, int, str]] = []
    at = until = 0
    kept: list[Record] = []  # of the damaged member that reaches to until
    while at < len(data):
        try:
            if data.startswith(_GZIP, at):
                inner, stop, broken = _member(data, at)
                if broken:
                    kept, intact = kept_of(inner)
                    records += placed(kept, at, stop)
                    start = _packed_bytes(data, at, stop, intact) if intact else at
                    until, at = stop, next_start(data, max(start, at + 1))
                    gaps.append((min(start, len(data) - 1), at, broken))
                    continue
                found, lost = (records_of(inner)) if inner else ([], "")
                if lost:
                    gaps.append((at, stop, lost))
                records += placed(found, at, stop)
            else:
                record, stop = parse_record(data, at)
                if at >= until or record not in kept:  # stored members show their records
                    records += placed([record], at, stop)
            at = stop
        except ValueError as error:
            stop = next_start(data, at + 1)
            gaps.append((at, stop, str(error)))
            at = stop
    return records, gaps


def placed(records: list[Record], start: int, stop: int) -> list[Record]:
    for r in records:
        r.start, r.stop = start, stop
    return records


def kept_of(inner: bytes) -> tuple[list[Record], int]:
    """The records of a damaged member whose block digests hold, and the bytes before the first that is lost."""
    found, at, intact = [], 0, None
    while at < len(inner):
        try:
            record, stop = parse_record(inner, at)
            if "warc-block-digest" not in record.headers:
                raise ValueError("no block digest")
            found.append(record)
            at = stop
        except ValueError:
            intact = at if intact is None else intact
            later = _VERSION.search(inner, at + 1)
            at = later.start() if later else len(inner)
    return found, at if intact is None else intact


def records_of(inner: bytes) -> tuple[list[Record], str]:
    """The records inside one member, and why some of it was lost, if any was."""
    found, lost, at = [], "", 0
    while at < len(inner):
        try:
            record, at = parse_record(inner, at)
            found.append(record)
        except ValueError as error:
            lost = str(error)
            later = _VERSION.search(inner, at + 1)
            at = later.start() if later else len(inner)
    return found, lost


def next_start(data: bytes, at: int) -> int:
    """The next offset at which a member or a version line begins a record; the end if none does."""
    line = _VERSION.search(data, at)
    plain = line.start() if line else len(data)
    while (found := data.find(_GZIP, at)) >= 0 and found < plain:
        if _starts_record(data, found):
            return found
        at = found + 1
    return plain


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, first (the page that a revisit refers to, else null)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = own.where(F.length("payload") >= REVISIT_BYTES)
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    dealt = groups.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    out = salted.join(dealt, ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return out.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("first"))


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives of pages (page_id, url, html) below folder; returns the manifest (path, n_records)."""
    arrow_rows(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, size
            path = f"{folder}/part-{part:06d}-{seq:06d}-{uuid.uuid4().hex[:8]}.warc.gz"
            write_bytes(path, b"".join(held))
            row = pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(held)]})
            seq, held, size = seq + 1, [], 0
            return row

        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, first = (c[i].as_py() for c in columns)
                held.append(gzip_member(pack_record(page_id, url, payload, digest, first, first is not None)))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return materialise(with_revisits(pages).mapInArrow(run, "path string, n_records long"), "manifest", folder)


def page_row(record: Record) -> tuple | None:
    """page_id, payload_bytes, payload_digest, record_type and refers_to; None for records that hold no page.

    ValueError where a header that says so is missing or is no number.
    """
    h = record.headers
    kind = h.get("warc-type")
    if kind is None:
        raise ValueError("record without a type")
    if kind not in ("response", "revisit"):
        return None
    page = int(h["x-page-id"]) if "x-page-id" in h else None
    if kind == "response":
        return page, len(record.payload), hashlib.sha256(record.payload).hexdigest(), kind, None
    missing = {"x-payload-length", "warc-payload-digest", "x-refers-to-page"} - h.keys()
    if missing:
        raise ValueError(f"revisit without {min(missing)}")
    return page, int(h["x-payload-length"]), h["warc-payload-digest"].partition(":")[2], kind, int(h["x-refers-to-page"])


def _each_file(paths: DataFrame) -> DataFrame:
    return paths.select("path").repartition(max(1, min(paths.count(), 100_000)), "path")


def salvaged(paths: DataFrame) -> DataFrame:
    """The records and the quarantined gaps of archives (path), of one pass over them; rows of gaps have a reason."""
    names = [x.split(" ")[0] for x in f"{RECORD_SCHEMA}, {GAP_SCHEMA}".split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                records, gaps = salvage(read_bytes(path))
                for r in records:
                    try:
                        row = page_row(r)
                    except ValueError as error:
                        gaps.append((r.start, r.stop, str(error)))
                        continue
                    if row is not None:
                        rows.append((*row, None, None, None, None))
                rows += [(None, None, None, None, None, path, *gap) for gap in gaps]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return _each_file(paths).mapInArrow(run, f"{RECORD_SCHEMA}, {GAP_SCHEMA}")


def records_in(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def gaps_in(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").select("path", "start", "stop", "reason")


def read_warc(paths: DataFrame) -> DataFrame:
    """The records of archives (path), with length and digest taken from the payload itself where there is one."""
    return records_in(salvaged(paths))


def read_gaps(paths: DataFrame) -> DataFrame:
    """The quarantined gaps of archives: path, start, stop, reason."""
    return gaps_in(salvaged(paths))


def read_and_log(paths: DataFrame, folder: str) -> DataFrame:
    """The records of archives; where there are gaps, they are written to folder/quarantine and a warning names it."""
    rows = materialise(salvaged(paths), "salvaged", folder)
    if not gaps_in(rows).isEmpty():
        lost = materialise(gaps_in(rows), "quarantine", folder)
        logging.getLogger(__name__).warning("%d gaps in archives, see %s/quarantine", lost.count(), folder)
    return records_in(rows)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark)
    return read_and_log(write_warc(read(spark, sf_dir, "pages", "page_id", "url", "html"), folder), folder)
