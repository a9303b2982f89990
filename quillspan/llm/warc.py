"""WARC archives: a writer with revisit records and a salvage reader.

The reader checks every gzip member (checksum and length) and every record (version line, headers, length,
payload digest).  Where a check fails it looks for the next member, or in plain archives the next version
line, that opens a valid record, goes on there, and logs the bytes between as a quarantined gap.

Defined results: null html is an empty payload; a null url leaves the target out; a null page_id counts as the
smallest, so it revisits any other, and payloads of null ids alone are all responses, as nothing can refer to
them; an empty table gives no archives and no rows; repeated rows each get a record, and the one response of a
payload is one row with its largest page_id.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, partitions, scratch, stored

#: An archive is closed at the first record beyond so many bytes.
FILE_BYTES = 8 << 20
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
DATE = "2024-01-01T00:00:00Z"


class Record(NamedTuple):
    offset: int
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    offset: int
    length: int
    reason: str


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP headers only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def inflate(buf: memoryview, at: int) -> tuple[bytes, int]:
    """The gzip member at `at` and where it ends; raises if it is not whole."""
    d, out, i = zlib.decompressobj(31), [], at
    while not d.eof:
        if i >= len(buf):
            raise ValueError("cut off")
        piece = buf[i : i + 65536]
        out.append(d.decompress(piece))
        i += len(piece)
    return b"".join(out), i - len(d.unused_data)


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at `at`; raises if any check fails."""
    if data[at : at + 7] != VERSION:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("no end of headers")
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no length")
    start = end + 4
    stop = start + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("wrong length")
    block = data[start:stop]
    if headers.get("warc-type") == "response" and "warc-payload-digest" in headers and digest32(payload_of(block)) != headers["warc-payload-digest"].removeprefix("sha1:"):
        raise ValueError("wrong digest")
    return headers, block, stop + 4


def payload_of(block: bytes) -> bytes:
    return block[block.find(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") else block


def salvage(content: bytes) -> Iterator[Record | Gap]:
    """All records of one archive that pass their checks, and the gaps between."""
    buf, at, n = memoryview(content), 0, len(content)
    packed = content[:2] == MAGIC[:2] or (MAGIC in content and VERSION not in content[:4096])

    def take(i: int) -> tuple[Record, int]:
        if not packed:
            headers, block, end = parse(content, i)
            return Record(i, headers, block), end
        data, end = inflate(buf, i)
        headers, block, stop = parse(data)
        if stop != len(data):
            raise ValueError("more than a record")
        return Record(i, headers, block), end

    while at < n:
        try:
            found, end = take(at)
        except (ValueError, zlib.error, UnicodeDecodeError) as problem:
            mark, reason, i = MAGIC if packed else VERSION, str(problem)[:80], at
            while True:
                i = content.find(mark, i + 1)
                if i < 0:
                    yield Gap(at, n - at, reason)
                    return
                try:
                    found, end = take(i)
                    break
                except (ValueError, zlib.error, UnicodeDecodeError):
                    continue
            yield Gap(at, i - at, reason)
        yield found
        at = end


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes gzip archives into the shared folder; gives the manifest: path, n_records, n_bytes."""
    rows = numbered(pages, "_quillspan_row")
    rows = rows.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"), F.col("_quillspan_row").alias("row"))
    # copies are found over digests alone; only (row, of) of the revisits meets the payloads again
    keys = rows.select("page_id", "row", F.sha1("payload").alias("sha"), F.length("payload").alias("n")).filter(F.col("n") >= min_revisit_bytes)
    first = keys.groupBy("sha", "n").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("sha", "n", "first")
    links = keys.join(first, ["sha", "n"]).filter("first.row != row").select("row", F.col("first.page_id").alias("of"))
    rows = rows.join(links, "row", "left")
    root = scratch(pages.sparkSession) + "/warc"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, n = [], [], 0
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base)

        def close() -> None:
            nonlocal held, n
            if held:
                path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                with store.open_output_stream(path, compression=None) as f:
                    for x in held:
                        f.write(x)
                out.append((path, len(held), n))
                held, n = [], 0

        for b in batches:
            for i in range(b.num_rows):
                key, link, payload, of = (b.column(j)[i].as_py() for j in range(4))
                held.append(member(record(key, link, payload, of)))
                n += len(held[-1])
                if n >= FILE_BYTES:
                    close()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))], ["path", "n_records", "n_bytes"])

    manifest = stored(rows.select("page_id", "url", "payload", "of").mapInArrow(write, "path string, n_records long, n_bytes long"))
    return manifest.withColumn("root", F.lit(root))


READ = "path string, offset long, kind string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, gap_bytes long, reason string"
_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def _row(path: str, x: Record | Gap) -> tuple:
    if isinstance(x, Gap):
        return (path, x.offset, "gap", None, None, None, None, None, None, x.length, x.reason)
    h = x.headers
    kind = h.get("warc-type")
    of = lambda name: int(m[1]) if (m := _PAGE.search(h.get(name, ""))) else None
    size = len(payload_of(x.block)) if kind == "response" else int(m[1]) if (m := re.search(rb"\r\nContent-Length: (\d+)", x.block)) else None
    return (path, x.offset, "record", of("warc-record-id"), h.get("warc-target-uri"), size, h.get("warc-payload-digest", "").removeprefix("sha1:"), kind, of("warc-refers-to"), None, None)


def read_archives(paths: DataFrame) -> DataFrame:
    """paths: path, root.  One row per record (kind 'record') and per quarantined gap (kind 'gap')."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, root in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, _ = fs.FileSystem.from_uri(root)
                with store.open_input_stream(path, compression=None) as f:
                    content = f.read()
                rows = [_row(path, x) for x in salvage(content)]
                types = [pa.int64() if k.endswith(" long") else pa.string() for k in READ.split(", ")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [k.split()[0] for k in READ.split(", ")])

    return paths.select("path", "root").repartition(partitions(paths.sparkSession), "path").mapInArrow(load, READ)


def archive(pages: DataFrame) -> DataFrame:
    """Write, then read back; quarantined gaps are kept in the shared folder, and their number is logged."""
    found = stored(read_archives(write_archives(pages)))
    if gaps := found.filter("kind = 'gap'").count():
        logging.getLogger(__name__).warning("%d quarantined gaps; rows of kind 'gap' in %s", gaps, found._quillspan_path)
    return found.filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
