"""WARC archives whose records are Zstandard frames with a shared dictionary.

An archive begins with a skippable frame that holds its dictionary, built from its own records; each record
is one more frame. Pages whose payload has at least ``MIN_REVISIT`` bytes and equals another page's are
revisits of the one with the smallest page_id. Archives are bounded in size and written as rows of binary
content to the shared folder, so a lost executor's archives are made again by others.

A null html counts as empty, a null url gives no target header. A null page_id is kept: such a page never is
what others refer to while an id is there. Rows that repeat the smallest id with the same payload are all
responses. An empty table gives no archives; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from .common import small_batches, table

MIN_REVISIT = 100
#: Raw bytes of an archive, of its dictionary, and of the records that the dictionary is built from.
ARCHIVE, DICTIONARY, SAMPLE = 4 << 20, 32 << 10, 1 << 20
LEVEL = 3
# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f%<>]")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit record without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_UNSAFE.sub(lambda m: quote(m[0], safe=''), url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> bytes:
    """A dictionary from evenly spaced records; from their raw content where there are too few to train on."""
    total = sum(map(len, records))
    every = max(1, total // SAMPLE)
    sample = records[::every]
    try:
        return zstandard.train_dictionary(DICTIONARY, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(sample)[:DICTIONARY]


def write_archive(records: list[bytes]) -> bytes:
    dictionary = train(records)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary + b"".join(map(compressor.compress, records))


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    magic, n = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + n]))
    raw = reader.stream_reader(content[8 + n :], read_across_frames=True).read()
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError("not a record")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        yield headers, raw[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _page(uri: str) -> int | None:
    name = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name else None


def with_roles(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest`` and ``refers_to``, null for what stays a response."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    # Written, so that its size is known when the join is planned: it is broadcast only where it is small.
    return rows.join(scratch.written(firsts, "warc-firsts"), "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def archives(pages: DataFrame) -> DataFrame:
    """``records, content``: archives of all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([write_archive(held)], pa.binary())], names=["records", "content"])

        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "digest")), strict=True):
                held.append(record(*row))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    return with_roles(pages).mapInArrow(run, "records long, content binary")


def read_archives(written: DataFrame) -> DataFrame:
    """The records of archives; a response whose payload doesn't have its digest raises ValueError."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                out: list[tuple] = []
                for h, block in read_archive(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, kind = h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"digest of {h['WARC-Record-ID']}")
                    refers = h.get("WARC-Refers-To")
                    out.append((_page(h["WARC-Record-ID"]), unquote(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else None, kind, _page(refers) if refers else None, int(re.search(rb"Content-Length: (\d+)", http)[1]), digest, payload if kind == "response" else None))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    return written.mapInArrow(run, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back and list their records."""
    small_batches(spark)
    return read_archives(scratch.written(archives(table(spark, sf_dir, "pages")), "warc")).drop("url", "payload")


ORACLE = {
    "op5_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND first <> page_id THEN first END AS refers_to
FROM f"""
}
