"""WARC archives: a deduplicating writer and a reader that salvages damaged files.

Every record is a gzip member of its own.  The reader checks each member (gzip checksum,
header, length, payload digest).  Where a check fails it searches byte by byte for the next
place at which a whole valid record starts, a member or a plain version line, goes on
there, and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import attempt_name, filesystem
from tidemark.workspace import materialize, new_path, ship_package

MIN_REVISIT_BYTES = 100
ROLL_BYTES = 128 << 20
MAX_HEADER = 1 << 16
STEP = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = pa.schema([
    ("path", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()),
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
])
RECORDS_DDL = (
    "path string, kind string, offset long, length long, reason string, page_id long, url string, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string"
)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:sha256:{digest}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"Payload-Length: {len(payload)}"]
    body = b"" if revisit else payload
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n") + pack.flush()


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record at ``at``; ValueError says which check failed."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
        raise ValueError("version line")
    end = data.find(b"\r\n\r\n", at, at + MAX_HEADER)
    if end < 0:
        raise ValueError("header")
    headers: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise ValueError("length")
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("length")
    payload, digest = data[start:stop], headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and digest.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != digest[7:]:
        raise ValueError("digest")
    return headers, payload, stop + 4


class Salvage:
    """Records and gaps of one archive, read through ``read_at`` so that memory holds one record."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size

    def _member(self, at: int) -> tuple[bytes, int]:
        unpack, out, pos = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof:
                piece = self.source.read_at(min(STEP, self.size - pos), pos) if pos < self.size else b""
                if not piece:
                    raise ValueError("truncated member")
                pos += len(piece)
                out.append(unpack.decompress(piece))
                if len(out) == 1 and out[0] and not out[0].startswith(b"WARC/"[: len(out[0])]):
                    raise ValueError("version line")
        except zlib.error:
            raise ValueError("gzip") from None
        return b"".join(out), pos - len(unpack.unused_data)

    def _plain(self, at: int) -> tuple[bytes, int]:
        head = self.source.read_at(min(MAX_HEADER, self.size - at), at)
        found = re.search(rb"\r\nContent-Length:[ \t]*(\d{1,15})\r\n", head, re.IGNORECASE)
        end = head.find(b"\r\n\r\n")
        if not found or end < 0 or found.start() > end:
            raise ValueError("header")
        size = end + 4 + int(found[1]) + 4
        if at + size > self.size:
            raise ValueError("truncated record")
        return self.source.read_at(size, at), at + size

    def _try(self, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int]:
        magic = self.source.read_at(min(10, self.size - at), at)
        if magic.startswith(b"\x1f\x8b\x08"):
            data, end = self._member(at)
        elif magic.startswith(b"WARC/1."):
            data, end = self._plain(at)
        else:
            raise ValueError("no record start")
        found, pos = [], 0
        while pos < len(data) or not found:
            headers, payload, pos = parse(data, pos)
            found.append((headers, payload))
        return found, end

    def _next(self, at: int) -> int:
        """The next place that looks like a record's start, or the end of the file."""
        while at < self.size:
            piece = self.source.read_at(min(STEP, self.size - at), at)
            hit = START.search(piece)
            if hit:
                return at + hit.start()
            at += len(piece) if at + len(piece) >= self.size else max(1, len(piece) - 9)
        return self.size

    def __iter__(self) -> Iterator[tuple[str, int, int, object]]:
        at, lost, why = 0, None, ""
        while at < self.size:
            try:
                found, end = self._try(at)
            except ValueError as broken:
                if lost is None:
                    lost, why = at, str(broken)
                at = self._next(at + 1)
                continue
            if lost is not None:
                yield "gap", lost, at - lost, why
                lost = None
            for headers, payload in found:
                yield "record", at, end - at, (headers, payload)
            at = end
        if lost is not None:
            yield "gap", lost, self.size - lost, why


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write all rows of (page_id, url, html) and return the manifest of the archives.

    A null html is an empty payload.  Of equal payloads of at least ``min_bytes`` bytes the
    one with the smallest page_id (rows without an id last) is a response and the others
    revisit it; if no row of the group has an id, all are responses.  Rows that repeat the
    head's id and payload are responses too.  An empty table gives an empty manifest, other
    columns are ignored.  Files of repeated tasks that the manifest does not name are void.
    """
    spark = pages.sparkSession
    ship_package(spark)
    folder = folder or new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("html", 256)))
    large = rows.filter(F.octet_length("html") >= min_bytes).select("digest", "page_id")
    heads = large.groupBy("digest").agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    marked = rows.join(materialize(heads, "heads"), "digest", "left")
    revisit = F.coalesce(F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("page_id")), F.lit(False))
    marked = marked.select("page_id", "url", "html", "digest", "head", revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, fs = TaskContext.get().partitionId(), filesystem(folder)[0]
        sink, path, count, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [count], "n_bytes": [size]})

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for page_id, url, html, digest, head, is_revisit in zip(*columns):
                if sink is None:
                    fs.create_dir(filesystem(folder)[1], recursive=True)
                    path, count, size = attempt_name(folder, "pages", part, "warc.gz"), 0, 0
                    sink = fs.open_output_stream(filesystem(path)[1], compression=None)
                member = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest.hex(), head, is_revisit)
                sink.write(member)
                count, size = count + 1, size + len(member)
                if size >= ROLL_BYTES:
                    yield done()
                    sink = None
        if sink is not None:
            yield done()

    return materialize(marked.mapInArrow(write, MANIFEST), "warc-manifest")


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """One row per record (kind ``record``) or quarantined byte range (``gap``) of the files in ``path``.

    Responses are measured on the payload read; a revisit carries its payload's digest and
    length in its header.  Empty files give no rows.
    """
    ship_package(spark)
    files = max(1, archives.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, place = filesystem(path)
                rows: list[dict] = []
                with fs.open_input_file(place) as source:
                    for kind, at, length, what in Salvage(source, source.size()):
                        row = {"path": path, "kind": kind, "offset": at, "length": length}
                        if kind == "gap":
                            row["reason"] = what
                        else:
                            headers, payload = what
                            revisit = headers.get("warc-type") == "revisit"
                            row |= {
                                "page_id": _page(headers.get("warc-record-id")), "url": headers.get("warc-target-uri"), "record_type": headers.get("warc-type"),
                                "refers_to": _page(headers.get("warc-refers-to")),
                                "payload_bytes": int(headers.get("payload-length", 0)) if revisit else len(payload),
                                "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
                            }
                        rows.append(row)
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)

    return archives.select("path").repartition(files).mapInArrow(read, RECORDS_DDL)
