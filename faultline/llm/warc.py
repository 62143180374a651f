"""WARC archives: a writer that marks repeated payloads as revisits, and a reader that salvages.

The reader trusts nothing.  A record counts if its gzip member ends with the right checksum, its
header lines and length are whole and its payload has the digest that it names.  After a failed
check the reader looks for the next place where a member (or, in an archive that is not
compressed, a version line) begins and a whole record follows, goes on from there, and reports the
bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a written archive before the next file begins.
FILE_BYTES = 1 << 30
CHUNK = 1 << 20
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
NEXT_VERSION = re.compile(rb"\nWARC/\d+\.\d+\r?\n")
#: First look for the end of a header; a longer one is read on.
HEADER_BYTES = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(path)


# --- Writing ---------------------------------------------------------------------------------


def mark_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with record_type and refers_to.

    Of equal payloads the rows with the smallest page_id are responses (nulls come last, and rows
    that repeat it are alike), the others revisit it.  A hot payload is pre-aggregated to one row for a task, and its
    rows meet that row in a join whose large partitions Spark splits.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "_sha1", F.unhex(F.sha1(F.encode("html", "UTF-8")))
    )
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")
    first = rows.groupBy("_sha1").agg(F.min(order).alias("_first"))
    met = rows.join(first, "_sha1")
    is_first = F.col("page_id").eqNullSafe(F.col("_first.page_id"))
    return met.select(
        "page_id",
        "url",
        "html",
        F.when(is_first, "response").otherwise("revisit").alias("record_type"),
        F.when(~is_first, F.col("_first.page_id")).alias("refers_to"),
        F.when(~is_first, F.col("_first.url")).alias("refers_to_url"),
    )


def _block(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _one_line(text: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", text or "").strip()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, revisit: bool) -> bytes:
    """One record; a revisit has the HTTP header of its response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "none" if page_id is None else page_id
    fields = [
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", EPOCH),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if not revisit:
        return _block("response", fields, http + payload)
    fields += [
        ("WARC-Profile", REVISIT_PROFILE),
        ("WARC-Refers-To", f"<urn:page:{'none' if refers_to is None else refers_to}>"),
        ("WARC-Refers-To-Target-URI", _one_line(refers_url)),
    ]
    return _block("revisit", fields, http)


def _writer(folder: str, compress: bool, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, attempt = context.partitionId(), context.taskAttemptId()
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        done, out, temporary, path, size, count = [], None, "", "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                # The same task writes the same bytes again, so the last attempt to end may win.
                store.move(temporary, path)
                done.append((path.rpartition("/")[2], size, count))
                out = None

        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch[name][row].as_py() for name in batch.schema.names}
                revisit = at["record_type"] == "revisit"
                record = page_record(at["page_id"], at["url"], at["html"], at["refers_to"], at["refers_to_url"], revisit)
                if compress:
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                    record = squeeze.compress(record) + squeeze.flush()
                if out is None or size >= file_bytes:
                    close()
                    path = f"{root}/pages-{task:05d}-{len(done):05d}.warc{'.gz' if compress else ''}"
                    temporary, size, count = f"{path}.{attempt}.part", 0, 0
                    out = store.open_output_stream(temporary, compression=None)
                out.write(record)
                size, count = size + len(record), count + 1
        close()
        names, sizes, counts = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
            names=["file", "bytes", "records"],
        )

    return write


def write_warc(pages: DataFrame, folder: str, compress: bool = True, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in ``folder``, a store all executors reach.

    A record for a row; null html is an empty payload, a null url an empty one.  Returns (file,
    bytes, records).  Each record is a gzip member of its own if ``compress``.
    """
    # In order, so that a task that runs again writes the same files.
    rows = mark_revisits(pages).sortWithinPartitions("page_id", "url").withColumn("html", F.encode("html", "UTF-8"))
    schema = "file string, bytes long, records long"
    written = rows.mapInArrow(_writer(folder, compress, file_bytes), schema)
    return written.sparkSession.createDataFrame(written.collect(), schema)


# --- Reading ---------------------------------------------------------------------------------


class _Window:
    """A file as a sliding window of bytes, so memory is that of the largest record."""

    def __init__(self, stream: pa.NativeFile):
        self.stream, self.data, self.start, self.ended = stream, bytearray(), 0, False

    def reach(self, end: int) -> bool:
        """Have the bytes before ``end``; False at the end of the file."""
        while not self.ended and self.start + len(self.data) < end:
            more = self.stream.read(max(CHUNK, end - self.start - len(self.data)))
            self.data += more
            self.ended = not more
        return self.start + len(self.data) >= end

    def drop(self, before: int) -> None:
        if before - self.start >= CHUNK:
            del self.data[: before - self.start]
            self.start = before

    def get(self, at: int, end: int) -> bytes:
        self.reach(end)
        return bytes(self.data[at - self.start : end - self.start])

    def find(self, needle: bytes, at: int) -> int:
        """Place of ``needle`` from ``at`` on, or -1."""
        while True:
            self.reach(at + CHUNK)
            found = self.data.find(needle, at - self.start)
            if found >= 0:
                return self.start + found
            if self.ended:
                return -1
            at = max(at, self.start + len(self.data) - len(needle) + 1)

    def size(self) -> int:
        while not self.ended:
            more = self.stream.read(CHUNK)
            self.data += more
            self.ended = not more
        return self.start + len(self.data)


def parse_record(data: bytes) -> tuple[dict, int]:
    """The record at the start of ``data`` and its length; ValueError names the failed check."""
    line = VERSION.match(data)
    if not line:
        raise ValueError("no version line")
    head_end = data.find(b"\r\n\r\n")
    if head_end < 0:
        raise ValueError("no end of the header")
    fields = {}
    for row in data[line.end() : head_end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = row.partition(":")
        if not colon:
            raise ValueError("header line without a colon")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isascii() or not fields.get("content-length", "").isdigit():
        raise ValueError("no content length")
    start = head_end + 4
    end = start + int(fields["content-length"])
    if len(data) < end + 4:
        raise ValueError("record is cut off")
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("no record end")
    kind, payload = fields.get("warc-type", ""), data[start:end]
    length = len(payload)
    if payload.startswith(b"HTTP/"):
        http, blank, payload = payload.partition(b"\r\n\r\n")
        if not blank:
            raise ValueError("no end of the HTTP header")
        told = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        length = int(told[1]) if kind == "revisit" and told else len(payload)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind != "revisit" and digest and digest != payload_digest(payload):
        raise ValueError("wrong payload digest")
    record = {
        "record_id": fields.get("warc-record-id"),
        "record_type": kind,
        "url": fields.get("warc-target-uri"),
        "payload_digest": digest or None,
        "payload_bytes": length,
        "refers_to": fields.get("warc-refers-to"),
        "payload": None if kind == "revisit" else payload,
    }
    return record, end + 4


def _member_at(window: _Window, at: int) -> tuple[dict, int]:
    """The record in the gzip member at ``at`` and the place after it."""
    inflate, out, end = zlib.decompressobj(31), bytearray(), at
    while not inflate.eof:
        chunk = window.get(end, end + CHUNK)
        if not chunk:
            raise ValueError("member is cut off")
        try:
            out += inflate.decompress(chunk)
        except zlib.error as error:
            raise ValueError(f"bad member: {error}") from None
        end += len(chunk) - len(inflate.unused_data)
        if len(out) >= 5 and not out.startswith(b"WARC/"):
            raise ValueError("no version line")
    record, length = parse_record(bytes(out))
    if length != len(out):
        raise ValueError("bytes after the record in its member")
    return record, end


def _plain_at(window: _Window, at: int) -> tuple[dict, int]:
    size = HEADER_BYTES
    head = window.get(at, at + size)
    if not VERSION.match(head):
        raise ValueError("no version line or length")
    while (blank := head.find(b"\r\n\r\n")) < 0:
        # The header of another record begins, or the file ends, before this one's has ended.
        if NEXT_VERSION.search(head) or len(head) < size:
            raise ValueError("no end of the header")
        size *= 2
        head = window.get(at, at + size)
    told = re.search(rb"(?im)^content-length:\s*(\d{1,15})\s*$", head[:blank])
    if not told:
        raise ValueError("no version line or length")
    end = at + blank + 4 + int(told[1]) + 4
    if not window.reach(end):
        raise ValueError("record is cut off")
    record, length = parse_record(window.get(at, end))
    return record, at + length


def salvage(stream: pa.NativeFile) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", begin, end, record) and ("gap", begin, end, reason), in order, over every byte."""
    window, at = _Window(stream), 0
    packed = window.get(0, 3) == MEMBER or not (window.get(0, 5) == b"WARC/" or window.find(b"WARC/", 0) >= 0)
    read, mark = (_member_at, MEMBER) if packed else (_plain_at, b"WARC/")
    while window.reach(at + 1):
        try:
            record, end = read(window, at)
            yield "record", at, end, record
        except ValueError as error:
            reason, begin, record = str(error), at, None
            while True:
                end = window.find(mark, at + 1)
                if end < 0:
                    end = window.size()
                    break
                at = end
                try:
                    record, after = read(window, at)
                    break
                except ValueError:
                    pass
            yield "gap", begin, end, reason
            if record is not None:
                yield "record", end, after, record
                end = after
        at = end
        window.drop(at)


RECORD_SCHEMA = (
    "file string, start long, stop long, record_id string, record_type string, url string, payload_digest string, "
    "payload_bytes long, refers_to string, payload binary, gap string"
)
_NAMES = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_TYPES = [_ARROW[part.split()[1]] for part in RECORD_SCHEMA.split(", ")]


def _reader(columns: list[str]):
    places = [_NAMES.index(c) for c in columns]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array([row[i] for row in rows], _TYPES[i]) for i in places]
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                store, name = open_store(path)
                rows, size = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for kind, begin, end, found in salvage(stream):
                        record = found if kind == "record" else {}
                        row = [record.get(c) for c in _NAMES]
                        row[:3], row[-1] = [name.rpartition("/")[2], begin, end], found if kind == "gap" else None
                        rows.append(tuple(row))
                        size += len(record.get("payload") or b"") + 200
                        if size > CHUNK:
                            yield pack(rows)
                            rows, size = [], 0
                if rows:
                    yield pack(rows)

    return read


def read_warc(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Every record of the archives in ``folder``, and every gap: RECORD_SCHEMA or some of its columns.

    A row is a record (gap is null) or a quarantined range of bytes (gap says which check
    failed).  Files are read in parallel, each as a stream.  No file, or empty ones, give no rows.
    """
    columns = columns or _NAMES
    schema = ", ".join(part for part in RECORD_SCHEMA.split(", ") if part.split()[0] in columns)
    columns = [part.split()[0] for part in schema.split(", ")]
    # Spark lists the files and never loads their content.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(folder).select("path")
    files = files.repartition(max(8, spark.sparkContext.defaultParallelism * 4), "path")
    return files.mapInArrow(_reader(columns), schema)
