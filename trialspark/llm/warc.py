"""WARC archives: one gzip member per record, and a sequential reader."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm._session import fresh_path, materialize, tune
from trialspark.llm._store import reader, writer

LEVEL = 1
CHUNK = 1 << 16
ARCHIVE_BYTES = 256 << 20
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """A record as one gzip member. A revisit has the response's HTTP header, whose length is the payload's, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", uri))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int
    length: int
    error: str | None = None

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        return _fields(head.split(b"\r\n")[1:]), body


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:  # a folded value goes on
            out[last] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            name, _, value = line.partition(b":")
            last = name.strip().decode("utf-8", "replace").lower()
            out[last] = value.strip().decode("utf-8", "replace")
    return out


def members(stream) -> Iterator[tuple[int, int, bytes, str | None]]:
    """Offset, stored length, content and error of each gzip member, read and inflated in chunks."""
    rest, at = b"", 0
    while True:
        if not rest:
            rest = stream.read(CHUNK)
            if not rest:
                return
        z, parts, start, error = zlib.decompressobj(31), [], at, None
        while True:
            try:
                parts.append(z.decompress(rest))
            except zlib.error as e:
                error = f"not gzip: {e}"
                break
            at += len(rest) - len(z.unused_data)
            rest = z.unused_data
            if z.eof:
                break
            rest = stream.read(CHUNK)
            if not rest:
                error = "ends inside a member"
                break
        yield start, at - start, b"".join(parts), error
        if error:
            return  # without its end the next member's start isn't known


def records(stream) -> Iterator[Record]:
    """Records of an archive in order: each member's header, then as many bytes as its Content-Length says."""
    for offset, length, content, error in members(stream):
        head, found, body = content.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        fields = _fields(lines[1:])
        if not error and (not found or not lines[0].startswith(b"WARC/")):
            error = "no WARC header"
        size = fields.get("content-length", "")
        if not error and not size.isdigit():
            error = "no Content-Length"
        n = int(size) if size.isdigit() else 0
        if not error and body[n:] != b"\r\n\r\n":
            error = "Content-Length and record differ"
        yield Record(fields, body[:n], offset, length, error)


def plan(pages: DataFrame, least: int = 100) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``: of equal payloads of ``least`` bytes or more, all but those of the smallest page refer to it.

    Only ids and digests are compared; payloads join the pages that revisit, by page.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    ids = base.where((F.length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    again = materialize(ids.distinct().join(first, "digest").where("page_id > refers_to"), "revisits")
    return base.join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def _urn(page, digest: str) -> str:
    return f"urn:page:{page}" if page is not None else f"urn:page:null:{digest}"


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``plan`` as archives in ``folder``; ``(archive, records, bytes)`` of each.

    Each attempt of a task writes files of its own name, and only what successful tasks report is listed, so a task that is
    tried again leaves no record twice.
    """
    tune(planned.sparkSession)

    def work(batches):
        out, name, n, size = None, "", 0, 0
        made = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = writer(name)
                refers = row["refers_to"]
                raw = record("response" if refers is None else "revisit", _urn(row["page_id"], row["digest"]), row["url"], row["payload"], row["digest"], None if refers is None else _urn(refers, ""))
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    made.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            made.append((name, n, size))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["archive", "records", "bytes"])

    return materialize(planned.mapInArrow(work, "archive string, records long, bytes long"), "archives")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the files named in ``archives.archive``, one task a file or more.

    ``(archive, offset, length, record_id, page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload,
    error)``; ``page_id`` and ``refers_to`` of ids this module wrote.  A response's bytes and digest are of the payload
    read, and ``error`` tells of one that its header doesn't match; a revisit's are what its headers say.  ``payload`` is
    null for revisits or without ``payloads``.  A damaged member ends its archive with a row that tells of it.
    """
    tune(archives.sparkSession)
    schema = "archive string, offset long, length long, record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]
    page = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None

    def rows(path: str):
        with reader(path) as stream:
            for r in records(stream):
                kind, told = r.headers.get("warc-type"), r.headers.get("warc-payload-digest", "").removeprefix("sha256:")
                http, body = r.http
                digest, size, error = told or None, int(http["content-length"]) if http.get("content-length", "").isdigit() else None, r.error
                if kind == "response":
                    digest = hashlib.sha256(body).hexdigest()
                    if not error and (told and digest != told or size is not None and size != len(body)):
                        error = "payload and digest or length differ"
                    size = len(body)
                yield path, r.offset, r.length, r.headers.get("warc-record-id"), page(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), kind, page(r.headers.get("warc-refers-to")), size, digest, body if payloads and kind == "response" else None, error

    def work(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                part, weight = [], 0
                for row in rows(path):
                    part.append(row)
                    weight += len(row[10] or b"") + 200
                    if weight > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), kinds, strict=True)], names)
                        part, weight = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), kinds, strict=True)], names)

    n = max(1, archives.count())
    return archives.select("archive").repartitionByRange(n, "archive").mapInArrow(work, schema)


def archive(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to archives in ``folder`` and list them.

    A null html is an empty payload and a null url leaves out the target.  Pages with a null id are responses that nothing
    refers to.  Rows with the smallest id of their payload, repeated ones too, are responses.  Empty input: no archives.
    Other columns play no part.
    """
    return write(plan(pages, least), folder)


def query(spark, sf_dir: str) -> DataFrame:
    made = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    back = read(made, payloads=False)
    # a damaged record would have an error: fail loudly rather than give a row that wasn't read
    checked = F.when(F.col("error").isNull(), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record: "), F.col("error"))).cast("string"))
    return back.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""
