"""Legacy archives to WARC, and WARC back to rows.

An ARC record is one header line and as many bytes as the line's last field
declares.  Which fields the line has is said by the version block at the start
of an ARC file; two versions are in use.  The converter reads the line by its
version, takes the declared length, and synthesises what WARC has and ARC has
not: a record identifier, an ISO timestamp, the record type, block and payload
digests, and ``revisit`` records for payloads already stored.

Records are written by Spark's text writer with the WARC record end
``\\r\\n\\r\\n`` as line separator, so tasks write to any file system that Spark
reaches and every file is a valid gzip-compressed WARC file.  They are read
with the same separator; the reader joins the pieces again and goes by the
declared lengths, so payloads may hold any separator.  Memory per task is
bounded by the largest record.

Equal payloads are found by digest: counts per digest are partial aggregates,
and only digests that occur twice or more come back to the rows (broadcast
while few, else a join that adaptive execution splits on a hot digest).

Defined cases: a null html is the empty payload; a null or blank url becomes
``urn:unknown``; white space in urls is percent-encoded; payloads under 100
bytes never become revisits; rows that repeat a page_id and its payload are
responses alike; a null page_id stays null; an empty table writes archives
without response records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoich.llm.common import bounded_batches, materialise
from stoich.llm.words import text_chunks
from stoich.session import ensure_checkpoint_dir

END = b"\r\n\r\n"
LEAST_BYTES = 100
BROADCAST_ROWS = 200_000
RECORDS_PER_FILE = 20_000
# Field names of the ARC header line by version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- ARC ------------------------------------------------------------------------

def http_block(payload: bytes) -> bytes:
    return (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
            % len(payload)) + payload


def arc_record(version: int, url: str, date: str, block: bytes) -> bytes:
    """One ARC record; fields that are not known are ``-``."""
    known = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html",
             "Result-code": "200", "Offset": "0", "Archive-length": str(len(block))}
    line = " ".join(known.get(f, "-") for f in ARC_FIELDS[version])
    return line.encode("utf-8") + b"\n" + block + b"\n"


def arc_version_block(version: int, name: str = "pages.arc") -> bytes:
    body = f"{version} 0 stoich\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    return f"filedesc://{name} 0.0.0.0 19960101000000 text/plain {len(body)}\n".encode() + body + b"\n"


def parse_arc_line(line: bytes, fields: list[str]) -> dict[str, str]:
    """Header fields of a record; the url is what remains on the left, so a
    stray blank in it does no harm."""
    parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(fields) - 1)
    if len(parts) != len(fields) or not parts[-1].isdigit():
        raise ValueError(f"not an ARC header line of {len(fields)} fields: {line[:80]!r}")
    return dict(zip(fields, parts))


def parse_arc_record(data: bytes, version: int) -> tuple[dict[str, str], bytes]:
    line, _, rest = data.partition(b"\n")
    head = parse_arc_line(line, ARC_FIELDS[version])
    size = int(head["Archive-length"])
    if len(rest) < size:
        raise ValueError("the record is shorter than its declared length")
    return head, rest[:size]


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a whole ARC file (plain or gzip members), by the version
    block's own field list."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, fields = 0, ARC_FIELDS[1]
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at:end if end >= 0 else len(data)]
        if not line.strip():
            at += len(line) + 1
            continue
        head = parse_arc_line(line, ARC_FIELDS[1] if line.startswith(b"filedesc:") else fields)
        size = int(head["Archive-length"])
        block = data[end + 1:end + 1 + size]
        at = end + 1 + size
        if line.startswith(b"filedesc:"):
            told = block.split(b"\n")
            fields = told[1].decode().split() if len(told) > 1 and told[1] else ARC_FIELDS[int(told[0].split()[0])]
        else:
            yield head, block


# -- WARC ----------------------------------------------------------------------------

def _stamp(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _record_id(page: str, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, page + ' ' + url)}>"


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """A record without its end, which the writer adds."""
    sha1 = base64.b32encode(hashlib.sha1(block).digest()).decode()
    head = {"WARC-Type": kind, **fields, "WARC-Block-Digest": f"sha1:{sha1}", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in head.items()).encode("utf-8") + END + block


def convert(head: dict[str, str], block: bytes, page: str, first: str | None) -> bytes:
    """The WARC record for an ARC record; ``first`` is the page whose response
    holds the same payload, if this one is to revisit it."""
    intro, _, payload = block.partition(END)
    fields = {
        "WARC-Record-ID": _record_id(page, head["URL"]), "WARC-Date": _stamp(head["Archive-date"]),
        "WARC-Target-URI": head["URL"], "WARC-IP-Address": head["IP-address"],
        "WARC-Payload-Digest": "sha256:" + hashlib.sha256(payload).hexdigest(),
        "X-Page": page, "Content-Type": "application/http;msgtype=response"}
    if first is None:
        return warc_record("response", fields, block)
    fields |= {"WARC-Profile": PROFILE, "X-Refers-To-Page": first}
    return warc_record("revisit", fields, intro + END)


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a stream of byte chunks, by declared lengths."""
    held = bytearray()
    need: int | None = None
    head: dict[str, str] = {}
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                start = held.find(b"WARC/")
                end = held.find(END, max(start, 0))
                if start < 0 or end < 0:
                    break
                lines = bytes(held[start:end]).decode("utf-8").split("\r\n")
                head = dict(x.split(": ", 1) for x in lines[1:])
                need = int(head["Content-Length"])
                del held[:end + len(END)]
            if len(held) < need + len(END):
                break
            yield head, bytes(held[:need])
            del held[:need + len(END)]
            need = None


# -- Spark ------------------------------------------------------------------------------

def clean_url(url: str | None) -> str:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", (url or "").strip())
    return url or "urn:unknown"


def arc_date(page_id: int | None) -> str:
    """A capture time per page: the pages carry none, so it counts seconds."""
    return (datetime(2000, 1, 1) + timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y%m%d%H%M%S")


def as_arc(pages: DataFrame) -> DataFrame:
    """(page_id, version, digest, record): every page as a gzip-compressed ARC
    record; even pages in version 1, odd ones in version 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "html"):
                ids, versions, digests, records = [], [], [], []
                for page, url, html in zip(*(c.to_pylist() for c in part.columns)):
                    payload = (html or "").encode("utf-8")
                    version = 1 + (page or 0) % 2
                    ids.append(page)
                    versions.append(version)
                    digests.append(hashlib.sha256(payload).digest())
                    records.append(gzip.compress(arc_record(version, clean_url(url), arc_date(page),
                                                            http_block(payload)), 1, mtime=0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(records, pa.binary())], names=["page_id", "version", "digest", "record"])

    return _pages(pages).mapInArrow(run, "page_id long, version long, digest binary, record binary")


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))


def repeated_payloads(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(digest, first): payloads of at least ``least`` bytes on several pages."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return (_pages(pages).where(F.octet_length(html) >= least)
            .groupBy(F.unhex(F.sha2(F.encode(html, "UTF-8"), 256)).alias("digest"))
            .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))


def write_archives(pages: DataFrame, folder: str) -> None:
    """Convert every page's ARC record and write gzip-compressed WARC files."""
    bounded_batches(pages.sparkSession)
    again = materialise(repeated_payloads(pages))
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = as_arc(pages).join(F.broadcast(again) if few else again, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"software: stoich\r\nformat: WARC File Format 1.1\r\n"
        yield pa.RecordBatch.from_arrays([pa.array([warc_record("warcinfo", {
            "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'warcinfo')}>",
            "WARC-Date": "2000-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, info).decode()])],
            names=["value"])
        for batch in batches:
            out, size = [], 0
            for page, version, record, first in zip(*(c.to_pylist() for c in batch.columns)):
                head, block = parse_arc_record(gzip.decompress(record), version)
                again = first is not None and first != page
                out.append(convert(head, block, "-" if page is None else str(page), str(first) if again else None))
                size += len(out[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r.decode() for r in out])], names=["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r.decode() for r in out])], names=["value"])

    (joined.select("page_id", "version", "record", "first").mapInArrow(run, "value string")
     .write.option("lineSep", END.decode()).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per response and revisit record: page_id, url, captured,
    payload_bytes, payload_digest, record_type, refers_to and payload (null for
    revisits).  Digests of stored payloads are computed from what was read."""
    schema = ("page_id long, url string, captured string, payload_bytes long, payload_digest string, "
              "record_type string, refers_to long, payload binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[bytes]:
            for batch in batches:
                for value in batch.column(0):
                    yield value.as_buffer().to_pybytes() + END

        rows, size = [], 0
        for head, block in parse_records(chunks()):
            kind = head["WARC-Type"]
            if kind not in ("response", "revisit"):
                continue
            intro, _, payload = block.partition(END)
            told = head["WARC-Payload-Digest"].removeprefix("sha256:")
            n = int(re.search(rb"Content-Length: (\d+)", intro)[1])
            if kind == "response":
                digest = hashlib.sha256(payload).hexdigest()
                if digest != told or n != len(payload):
                    raise ValueError(f"damaged record {head['WARC-Record-ID']}")
            page, first = head["X-Page"], head.get("X-Refers-To-Page")
            rows.append((None if page == "-" else int(page), head["WARC-Target-URI"], head["WARC-Date"], n, told,
                         kind, None if first is None else int(first), payload if kind == "response" else None))
            size += len(payload)
            if size > 4 << 20:
                yield _records(rows)
                rows, size = [], 0
        if rows:
            yield _records(rows)

    return (spark.read.option("lineSep", END.decode()).schema("value string").text(folder)
            .mapInArrow(run, schema))


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "captured", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_arc_files(spark: SparkSession, folder: str) -> DataFrame:
    """(url, captured, payload) of every record of legacy ARC files, plain or
    gzip-compressed; one file at a time is held by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [(h["URL"], _stamp(h["Archive-date"]), b.partition(END)[2]) for h, b in read_arc(content.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))],
                        names=["url", "captured", "payload"])

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(
        run, "url string, captured string, payload binary")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/archives/{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return read_archives(spark, folder)
