"""WARC archives written by Spark, and a salvage reader that gets over damage.

Writing: every record is one row of Spark's text writer, whose line separator is the two line ends that close a
WARC record, so archives land in any store that Spark writes to, a bounded number of rows to a file.

Reading: files come through Spark's binaryFile source. A record is accepted when its version line, header, length,
closing line ends and payload digest hold. After a failed check the reader looks for the next gzip member that
opens or the next version line (what is lost may have ended within a line), goes on from there, and logs the bytes in between.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import _common

#: Bytes of payload in an archive file, about; one file is one read of the salvage reader.
FILE_BYTES = 8 << 20
SLICE_BYTES = 4 << 20
_CLOSE = b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_MEMBER = b"\x1f\x8b\x08"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public URL name space


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def build_record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    """A response record with its payload, or a revisit record that names the response with the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest(payload)}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url or 'about:blank')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"] if kind == "revisit" else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + _CLOSE + block


class Record(NamedTuple):
    offset: int
    header: dict[str, str]
    block: bytes

    def payload_length(self) -> int:
        found = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})\r$", self.block[: self.block.find(_CLOSE) + 2])
        return int(found[1]) if found else 0

    def payload(self) -> bytes:
        return self.block[self.block.find(_CLOSE) + 4 :]


class Gap(NamedTuple):
    start: int
    end: int
    reason: str


def _parse(data: bytes, at: int) -> tuple[Record, int] | str:
    """The record that begins at ``at`` and where it ends; or why there is none."""
    if not _VERSION.match(data, at):
        return "no version line"
    header: dict[str, str] = {}
    line = data.index(b"\r\n", at) + 2
    while (end := data.find(b"\r\n", line)) != line:  # as long as lines look like fields, however long they are
        if end < 0:
            return "no end of header"
        name, colon, value = data[line:end].partition(b":")
        if not colon:
            return "bad header line"
        field = name.decode("utf-8", "replace").strip().lower()
        if field in header and field != "warc-concurrent-to":  # the only field that may be repeated; two headers run together
            return "repeated header field"
        header[field] = value.decode("utf-8", "replace").strip()
        line = end + 2
    length = header.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        return "no length"
    begin = line + 2
    end = begin + int(length)
    if data[end : end + 4] != _CLOSE:
        return "cut short" if end + 4 > len(data) else "no end of record"
    record = Record(at, header, data[begin:end])
    named = header.get("warc-payload-digest", "")
    if header.get("warc-type") == "response" and named.startswith("sha1:") and named[5:] != digest(record.payload()):
        return "digest"
    return record, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What one gzip member gives, and where it ends; None if it breaks off or is damaged after what it gave."""
    inflater, out, step = zlib.decompressobj(31), [], 1 << 16
    while at < len(data) and not inflater.eof:
        part, before = data[at : at + step], inflater.copy()
        try:
            out.append(inflater.decompress(part))
        except zlib.error:
            for i in range(len(part)):  # up to the very byte that fails
                try:
                    out.append(before.decompress(part[i : i + 1]))
                except zlib.error:
                    break
            return b"".join(out), None
        at += len(part)
    return b"".join(out), at - len(inflater.unused_data) if inflater.eof else None


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records of an archive, plain or of gzip members, and the gaps that had to be given up, in order of place."""
    at, n, lost, why = 0, len(data), None, ""
    while at < n:
        if data.startswith(_MEMBER, at):
            inflated, end = _inflate(data, at)
            if end is not None and not inflated and lost is None:  # a sound member that holds nothing
                at = end
                continue
            inner = list(salvage(inflated))
            if any(isinstance(x, Record) for x in inner):
                if lost is not None:
                    yield Gap(lost, at, why)
                    lost = None
                for x in inner:
                    if isinstance(x, Record):
                        yield Record(at, x.header, x.block)
                    elif end is not None:
                        yield Gap(at, end, f"in a member: {x.reason}")
                if end is not None:
                    at = end
                    continue
            found: tuple[Record, int] | str = "damaged member" if end is None else "member without record"
        else:
            found = _parse(data, at)
        if not isinstance(found, str):
            if lost is not None:
                yield Gap(lost, at, why)
                lost = None
            yield found[0]
            at = found[1]
            continue
        if lost is None:
            lost, why = at, found
        nxt = _NEXT.search(data, at + 1)
        at = nxt.start() if nxt else n
    if lost is not None:
        yield Gap(lost, n, why)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, compression: str = "gzip") -> None:
    """Write a record for each row of ``pages`` under ``path``; a file is one gzip member, or plain with ``none``.

    Among rows with equal payloads of ``least`` bytes or more those with the largest key are responses and the
    others revisits of it; smaller payloads are all responses. Null html is an empty payload. A null key comes
    before any other. Rows repeated with the largest key are all responses. An empty table gives an empty archive.
    """
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    # only digests are grouped, and summed up before they move; a digest of very many pages is one row of ``last``
    last = rows.where(F.col("bytes") >= least).groupBy("sha", "bytes").agg(F.max("id").alias("last"))
    joined = rows.join(last, ["sha", "bytes"], "left")
    role = joined.select("id", "url", "payload", F.when(F.col("last").isNotNull() & (F.col("id").isNull() | (F.col("last") > F.col("id"))), F.col("last")).alias("refers_to"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = zip(*(part.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to")), strict=True)
                made = [build_record(i, u, p, "response" if r is None else "revisit", r, date) for i, u, p, r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    mean = rows.agg(F.avg("bytes")).first()[0] or 1.0
    role.mapInArrow(build, "value binary").select(F.col("value").cast("string")).write.option("lineSep", _CLOSE.decode()).option("maxRecordsPerFile", max(1, int(file_bytes / (mean + 500)))).option("compression", compression).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, until, record_type, page_id, refers_to, payload_bytes, payload_digest, payload, gap): a row for each record and each gap."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "at", "until", "record_type", "page_id", "refers_to", "payload_bytes", "payload_digest", "payload", "gap"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        number = lambda x: int(x) if re.fullmatch("-?[0-9]{1,19}", x or "") and -(1 << 63) <= int(x) < 1 << 63 else None
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held, file = [], 0, batch.column("path")[i].as_py()
                for x in salvage(batch.column("content")[i].as_py()):
                    if isinstance(x, Gap):
                        rows.append((file, x.start, x.end, None, None, None, None, None, None, x.reason))
                    else:
                        h, response = x.header, x.header.get("warc-type") == "response"
                        payload = x.payload() if response else None
                        rows.append((file, x.offset, None, h.get("warc-type"), number(h.get("x-page-id")), number(h.get("x-refers-to-page-id")), len(payload) if response else x.payload_length(), h.get("warc-payload-digest", "").removeprefix("sha1:"), payload, None))
                        held += len(payload or b"")
                    if held >= SLICE_BYTES or len(rows) >= 4096:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(read, "file string, at long, until long, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary, gap string")


def undamaged(found: DataFrame) -> DataFrame:
    """The rows of ``read_archives``; a gap among them fails the query, so that no record is lost unseen."""
    says = F.concat_ws(" ", F.lit("gap in an archive:"), "gap", F.lit("at"), "at", F.lit("of"), "file")
    return found.where(F.when(F.col("gap").isNull(), True).otherwise(F.raise_error(says).cast("boolean")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _common.new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return undamaged(read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
