"""WARC archives, written index first and read back by byte ranges.

Writing: every record is a gzip member of its own (WARC/1.1); each task appends records to files in the
folder all executors share and returns one index row a record: file, offset, length, URL, payload digest.
The index is a Parquet table; a repeated task attempt writes new files, and only the index rows of the attempt
that counts point anywhere, so lost executors leave unreferenced bytes and nothing else.
Reading: index rows are selected first, dealt by ranges of (file, offset) and sorted; each task joins
neighbouring ranges into one read of bounded size.

Equal payloads are found by SHA-1 with a partial aggregate; only groups of two or more are joined back, by a
join that adaptive execution broadcasts if small and splits where one payload is hot.

Defined results: null html is an empty payload; null url omits the target URI; among rows of one payload those
with the largest page_id are responses (repeated rows with that id are all responses), a null page_id is the
smallest; an empty table gives an empty archive; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, shared_dir, stored, table

FILE_BYTES = 1 << 30
#: A read spans at most so many bytes, and skips at most so many unwanted ones inside.
SPAN_BYTES, GAP_BYTES = 4 << 20, 128 << 10
#: Of the bytes that two records share, how many they must have at least to be stored once.
MIN_REVISIT_BYTES = 0
#: The time of capture where the caller gives none; the pages carry none.
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(column):
    """Upper-case base32 of 40 hex digits: five digits are four characters."""
    quads = [F.lpad(F.conv(F.substring(column, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and a path in it, for any store that pyarrow knows."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def record_id(page_id, url) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def one_line(url: str) -> str:
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, payload: bytes, digest: str, refers_to, refers_url=None, date: str = DATE) -> bytes:
    """One WARC record as a gzip member; a revisit names the record, address and date of the response it refers to."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + one_line(url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers_to}"]
        if refers_url is not None:
            head.append("WARC-Refers-To-Target-URI: " + one_line(refers_url))
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> dict:
    """A record back from its gzip member; the payload's length and digest are verified."""
    raw = zlib.decompress(member, 31)
    cut = raw.index(b"\r\n\r\n")
    lines = raw[:cut].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = raw[cut + 4 : cut + 4 + int(head["Content-Length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    url, page, refers = head.get("WARC-Target-URI"), head.get("X-Page-Id"), head.get("X-Refers-To-Page")
    out = {"page_id": page and int(page), "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "payload": payload, "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": refers and int(refers)}
    if out["record_type"] == "response" and (len(payload) != out["payload_bytes"] or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record of page {page} is damaged")
    return out


def planned(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages with payload digest, and for a row that repeats another's payload the page it refers to."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", base32_of_hex(F.sha1("html")))
    shared = rows.filter(F.octet_length("html") >= min_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("top")).filter("n > 1 AND top IS NOT NULL").select("payload_digest", F.col("top.page_id").alias("last"), F.col("top.url").alias("last_url"))
    shared = stored(shared, "warc-shared")
    rows = rows.join(shared, "payload_digest", "left")
    return rows.select("page_id", "url", "html", "payload_digest", F.expr("CASE WHEN page_id = last THEN NULL ELSE last END").alias("refers_to"), F.col("last_url").alias("refers_url"))


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES, date: str = DATE) -> DataFrame:
    """The archives of pages, written to folder with date as the time of capture; returns their index, stored."""

    def run(batches):
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        sink, name, at = None, "", 0
        try:
            for b in chunks(batches, "html"):
                rows = []
                for r in b.to_pylist():
                    if sink is None:
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                    payload = r["html"].encode()
                    member = record(r["page_id"], r["url"], payload, r["payload_digest"], r["refers_to"], r["refers_url"], date)
                    sink.write(member)
                    rows.append({"page_id": r["page_id"], "url": r["url"], "file": name, "offset": at, "length": len(member), "payload_bytes": len(payload), "payload_digest": r["payload_digest"], "record_type": "response" if r["refers_to"] is None else "revisit", "refers_to": r["refers_to"]})
                    at += len(member)
                    if at >= FILE_BYTES:
                        sink.close()
                        sink = None
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
        finally:
            if sink is not None:
                sink.close()

    return stored(planned(pages, min_bytes).mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that rows of an index name, read by coalesced byte ranges in file order."""

    def run(batches):
        fs, root = opened(folder)
        source, name, span = None, None, []

        def fetched():
            start = span[0][0]
            source.seek(start)
            data = source.read(span[-1][0] + span[-1][1] - start)
            return pa.RecordBatch.from_pylist([parsed(data[o - start : o - start + n]) for o, n in span], schema=_RECORD)

        for b in batches:
            for file, offset, length in zip(*(b.column(k).to_pylist() for k in ("file", "offset", "length")), strict=True):
                if span and (file != name or offset + length - span[0][0] > SPAN_BYTES or offset - (span[-1][0] + span[-1][1]) > GAP_BYTES):
                    yield fetched()
                    span = []
                if file != name:
                    if source is not None:
                        source.close()
                    source, name = fs.open_input_file(f"{root}/{file}"), file
                span.append((offset, length))
        if span:
            yield fetched()
        if source is not None:
            source.close()

    wanted = index.select("file", "offset", "length")
    return wanted.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, hex,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(1 + (('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5))::BIGINT >> (5 * (3 - i % 4))) % 32 AS INT), 1)
      FOR i IN range(32)], '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hex) AS last
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d
"""
