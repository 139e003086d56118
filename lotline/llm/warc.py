"""WARC archives: writing, and a reader that splits them.

Writing.  Pages with equal payloads of ``MIN_REVISIT`` bytes or more are one
response, that of the smallest page_id, and revisits that refer to it.  Each
task writes its rows as gzip members, one a record, into files of its own in
the shared folder; the table of finished files is written after them, so files
of lost or repeated tasks are never read.

Reading.  Files are cut into byte ranges, read by tasks of their own.  A task
looks for the gzip magic from the start of its range; a candidate is a member
if it decodes to a WARC header, and the task owns the records that start in
its range, which it follows past the end of the range.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, texts_of, written

MIN_REVISIT = 100
FILE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
TASK_BYTES = 128 << 20
CHUNK = 1 << 20
MAGIC = b"\x1f\x8b\x08"
SIGN = b"WARC/1."
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# ---------------------------------------------------------------- records
def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~-._"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> dict:
    """Fields of a decoded member; its payload is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    block = rest[: int(fields.get("content-length") or 0)]
    http, _, body = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type", "")
    size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    page = lambda x: int(x[10:-1]) if x and x.startswith("<urn:page:") and x != "<urn:page:>" else None
    full = kind != "revisit"
    return {"page_id": page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"),
            "payload_bytes": len(body) if full else size,
            "payload_digest": hashlib.sha256(body).hexdigest() if full else
            fields.get("warc-payload-digest", "").removeprefix("sha256:"),
            "record_type": kind, "refers_to": page(fields.get("warc-refers-to")), "payload": body if full else None}


# ---------------------------------------------------------------- writing
def write(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of pages (page_id, url, html); returns the written files (path, bytes, records).

    A null html is an empty payload; a null url writes no target; rows without
    a page_id are responses.  Repeated rows of a response's page are responses
    too.  An empty table writes no file.  Other columns are not looked at."""
    folder = scratch(pages.sparkSession, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                         F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    first = (pages.where((F.length("payload") >= MIN_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"))
    pages = pages.join(first, "digest", "left").withColumn(
        "refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        ctx = TaskContext.get()
        out, files, size, count, name = None, [], 0, 0, ""

        def close() -> None:
            if out is not None:
                out.close()
                files.append((f"{folder}/{name}", size, count))
        for b in batches:
            cols = [b.column(k).to_pylist() for k in (0, 1)] + [texts_of(b.column(2))] + [b.column(k).to_pylist() for k in (3, 4)]
            for row in zip(*cols):
                if out is None or size >= file_bytes:
                    close()
                    name = f"part-{ctx.partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, count = fs.open_output_stream(f"{at}/{name}", compression=None), 0, 0
                data = record(*row)
                out.write(data)
                size, count = size + len(data), count + 1
        close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*files), (pa.string(), pa.int64(), pa.int64()))],
                                             ["path", "bytes", "records"])
    rows = pages.select("page_id", "url", "payload", "digest", "refers_to")
    return written(rows.mapInArrow(run, "path string, bytes long, records long"), "archives")


# ---------------------------------------------------------------- reading
class _Window:
    """Bytes of a file from any place, read in chunks."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, start: int, n: int = CHUNK) -> bytes:
        """Up to ``n`` bytes from ``start``."""
        end = min(start + n, self.size)
        if not (self.at <= start and end <= self.at + len(self.data)):
            self.at, self.data = start, self.file.read_at(max(n, CHUNK) if start + max(n, CHUNK) <= self.size
                                                          else self.size - start, start)
        return self.data[start - self.at: end - self.at]


def _member(w: _Window, start: int) -> tuple[bytes, int] | None:
    """(content, end) of the member that starts here, if it is one with a WARC header."""
    un, out, at, head = zlib.decompressobj(31), [], start, b""
    try:
        while not un.eof:
            data = w.get(at)
            if not data:
                return None
            out.append(un.decompress(data))
            at += len(data)
            if len(head) < len(SIGN):       # the first bytes rule a candidate out; its header may be of any length
                head += out[-1][: len(SIGN) - len(head)]
                if not SIGN.startswith(head):
                    return None
    except zlib.error:
        return None
    content = b"".join(out)
    return (content, at - len(un.unused_data)) if head == SIGN and b"\r\n\r\n" in content else None


def read_range(file, size: int, start: int, end: int) -> Iterator[dict]:
    """Records that start in [start, end) of a file."""
    w, at = _Window(file, size), start
    while at < end:
        found = w.get(at, min(CHUNK, end - at + len(MAGIC) - 1)).find(MAGIC)
        if found < 0:
            at += max(1, min(CHUNK, end - at + len(MAGIC) - 1) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            break
        member = _member(w, at)
        if member is None:
            at += 1
        else:
            yield parse(member[0])
            at = member[1]


def read(files: DataFrame, range_bytes: int = RANGE_BYTES, payload: bool = False) -> DataFrame:
    """Records of archives (path, bytes): page_id, url, payload_bytes,
    payload_digest, record_type, refers_to and, if asked for, payload (binary,
    null for revisits).  Bytes that are no member are passed over."""
    ranges = files.where("bytes > 0").select("path", F.col("bytes").alias("size"), F.explode(
        F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(range_bytes))).alias("start"))
    ranges = ranges.withColumn("end", F.least("size", F.col("start") + range_bytes))
    count, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()
    tasks = max(1, min(count, max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)))
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if payload:
        names, types, schema = [*names, "payload"], [*types, pa.binary()], schema + ", payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types)], names)
        for b in batches:
            for path, size, start, end in zip(*(c.to_pylist() for c in b.columns)):
                fs, at = filesystem(path)
                rows, held = [], 0
                with fs.open_input_file(at) as file:
                    for r in read_range(file, size, start, end):
                        rows.append(r)
                        held += len(r["payload"] or b"") if payload else 200
                        if held >= 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)
    # ranges are dealt one by one: each has the same number of bytes
    return ranges.repartition(tasks).mapInArrow(run, schema)


def round_trip(pages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pages written as archives and read back; fewer or more records than were
    written are an error."""
    files = write(pages)
    rows = written(read(files, range_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    wrote, found = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], rows.count()
    if wrote != found:
        raise RuntimeError(f"{wrote} records were written and {found} read")
    return rows
