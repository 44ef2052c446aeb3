"""WARC archives: written by tasks into the shared folder, read back, and assembled to one nested row per capture.

A capture is a response (or a revisit, whose payload an other capture has), a request and a metadata record; the
latter two name the first in WARC-Concurrent-To.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import local_path, shared_dir, written

#: Payloads of fewer bytes are always stored.
SMALL = 1000
#: Compressed bytes after which a task begins another file.
ROLL = 32 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan(pages: DataFrame, small: int = SMALL) -> DataFrame:
    """(page_id, url, html, record_type, refers_to): of equal payloads of at least small bytes, the largest page_id is the response."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("large", F.octet_length("html") >= small)
    groups = rows.filter("large").groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.filter("n > 1 and first is not null").select("digest", "first"), "payloads")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = rows.join(groups.withColumn("large", F.lit(True)), ["digest", "large"], "left")
    return joined.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def _record(kind: str, record: str, url: str, body: bytes, mime: str, *more: tuple[str, str]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), *more, ("Content-Type", mime), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def capture_records(page: int | None, copy: str, url: str | None, html: str, kind: str, refers: int | None) -> list[bytes]:
    """The three records of one capture. Line ends in a URL are escaped."""
    name, url = f"urn:capture:{'' if page is None else page}:{copy}", re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "")
    payload = html.encode("utf-8", "surrogatepass")
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    extra = [("WARC-Payload-Digest", digest)]
    if kind == "revisit":
        extra += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:capture:{refers}>")]
    host = url.partition("://")[2].partition("/")[0]
    to = ("WARC-Concurrent-To", f"<{name}>")
    return [
        _record(kind, name, url, http if kind == "revisit" else http + payload, "application/http; msgtype=response", *extra),
        _record("request", f"{name}:request", url, f"GET {url} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), "application/http; msgtype=request", to),
        _record("metadata", f"{name}:metadata", url, b"fetchTimeMs: 0\r\n", "application/warc-fields", to),
    ]


def write_archives(planned: DataFrame, roll: int = ROLL) -> DataFrame:
    """Writes the captures of plan(); (path, records) of the files that finished tasks have written, each record a gzip
    member of its own. A task that runs again writes other files, and only one attempt's are listed."""
    folder = local_path(shared_dir(planned.sparkSession))
    os.makedirs(folder, exist_ok=True)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem, part, row, records, out = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}", 0, 0, 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    path = f"{stem}-{part:04d}.warc.gz"
                    out, records = open(path, "wb"), 0
                for record in capture_records(r["page_id"], f"{task.partitionId()}.{row}", r["url"], r["html"], r["record_type"], r["refers_to"]):
                    out.write(gzip.compress(record, 4, mtime=0))
                    records += 1
                row += 1
                if out.tell() >= roll:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64())})
                    out, part = None, part + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64())})

    return written(planned.mapInArrow(apply, "path string, records long"), "manifest")


def parse(stream: gzip.GzipFile) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; one whose length is no number has an empty block, and what
    follows up to the next record is skipped."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        size = head.get("content-length", "")
        yield head, stream.read(int(size) if size.isdecimal() else 0)


RECORDS = "record_id string, type string, concurrent_to string, refers_to string, url string, date string, payload_bytes long, payload_digest string, payload binary"


def read_records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """RECORDS of the archives in (path): for responses and revisits the size and hex SHA-1 of the full payload.

    payloads=False leaves the payload out. Files are read as streams, a record at a time.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with gzip.open(path, "rb") as stream:
                    for head, block in parse(stream):
                        kind, size, digest, payload = head.get("warc-type"), None, None, None
                        if kind in ("response", "revisit"):
                            http, _, payload = block.partition(b"\r\n\r\n")
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                            if kind == "revisit":
                                found = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                                size, payload = int(found[1]) if found else None, None
                                digest = base64.b32decode(head.get("warc-payload-digest", "").partition(":")[2]).hex() or None
                        link = [head.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-concurrent-to", "warc-refers-to")]
                        rows.append((link[0], kind, link[1], link[2], head.get("warc-target-uri"), head.get("warc-date"), size, digest, payload if payloads else None))
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    parts = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("path").repartition(parts, "path").mapInArrow(apply, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: (capture_id, page_id, url, refers_to, response, request, metadata), the last three nested.

    Requests and metadata meet their response in the group of the identifier that they name, so that the archives are
    read and moved once. A response without them has nulls there; those which name no response that is there are no
    capture. Of several requests or metadata records the first by identifier is taken.
    """
    main = F.col("type").isin("response", "revisit")
    key = F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to"))
    fields = F.struct("record_id", "type", "refers_to", "url", "date", "payload_bytes", "payload_digest", *(["payload"] if "payload" in records.columns else []))
    side = F.struct("record_id", "url", "date")
    grouped = records.withColumn("capture_id", key).filter("capture_id is not null").groupBy("capture_id").agg(
        F.min(F.when(main, fields)).alias("response"), F.min(F.when(F.col("type") == "request", side)).alias("request"), F.min(F.when(F.col("type") == "metadata", side)).alias("metadata")
    )
    page = lambda c: F.regexp_extract(c, r"^urn:capture:(-?\d+)", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return grouped.filter("response is not null").select("capture_id", number(F.col("capture_id")).alias("page_id"), F.col("response.url").alias("url"), number(F.col("response.refers_to")).alias("refers_to"), "response", "request", "metadata")


def archive(pages: DataFrame) -> DataFrame:
    """The captures of pages, written as archives and read back: assemble() without payloads.

    The payload is html in UTF-8, null as an empty one. Payloads under 1000 bytes are always responses; where all ids of equal
    payloads are null, so are they. Repeated rows are captures of their own, a null page_id stays null, an empty table
    gives no rows, and only page_id, url and html are read.
    """
    return assemble(read_records(write_archives(plan(pages)), payloads=False).drop("payload"))
