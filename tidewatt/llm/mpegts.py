"""MPEG transport streams: payloads are cut into access units, packed into elementary packets with time
stamps and random-access points, and multiplexed with program tables, which are repeated before each access unit
so that a reader can enter there. The reader parses the tables, checks the continuity counters of all streams and
tables, drops the one duplicate that a packet may have, and reassembles the elementary packets. A unit ends where the
next begins: one with a lost packet is cut short and named as damaged, and the others are read whole.

A null payload counts as empty, an empty one gives a stream of tables only. Equal payloads give equal
streams. Rows are handled one by one, so repeated rows, ties and empty tables need no care; existing columns
with an output's name are replaced, all others are kept.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, small_batches, table

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, NULL_PTS = 188, 0x47, (1 << 33) - 1
PRIVATE_DATA, PRIVATE_STREAM_1 = 0x06, 0xBD
# Values of our own streams.
PROGRAM, PMT_PID, DATA_PID = 1, 0x1000, 0x0100
#: Bytes of an access unit, and the 90 kHz ticks from one to the next.
UNIT, TICKS = 16_384, 3_003


@functools.lru_cache(1024)
def crc32_mpeg(data: bytes) -> int:
    """The sections' checksum: polynomial 0x04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x104C11DB7 if crc & 0x80000000 else 0)
    return crc


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    """A pointer field and a section that is current, the first and the last of its table."""
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    return b"\x00" + head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | counter]) + section).ljust(PACKET, b"\xff")


@functools.cache
def _tables(counter: int) -> bytes:
    pat = PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")
    pmt = (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    return _table_packet(0, counter, _section(0, 1, pat)) + _table_packet(PMT_PID, counter, _section(2, PROGRAM, pmt))


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """A transport stream that carries ``payload``; each access unit is a random-access point after the tables."""
    out, counter = [], 0
    for i, at in enumerate(range(0, len(payload), UNIT)):
        out.append(_tables(i & 15))
        unit, pts = payload[at : at + UNIT], (i * TICKS) & NULL_PTS
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(pts) + unit
        # The first packet has the clock and the random-access flag, the last is stuffed in its adaptation field.
        clock = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
        first = max(0, PACKET - 5 - len(clock) - len(pes))
        head = 183 - len(clock) - first
        out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | counter, len(clock) + first]) + clock + b"\xff" * first + pes[:head])
        counter = (counter + 1) & 15
        full, rest = divmod(len(pes) - head, 184) if len(pes) > head else (0, 0)
        if full:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, :3] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            packets[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            packets[:, 4:] = np.frombuffer(pes, np.uint8, full * 184, head).reshape(full, 184)
            out.append(packets.tobytes())
            counter = (counter + full) & 15
        if rest:
            field = 183 - rest
            stuffing = bytes([field]) + (b"\x00" + b"\xff" * (field - 1) if field else b"")
            out.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | counter]) + stuffing + pes[len(pes) - rest :])
            counter = (counter + 1) & 15
    return b"".join(out) or _tables(0)


@functools.lru_cache(1024)
def _parse_section(content: bytes) -> tuple[int, bytes]:
    """Table id and body of the section that begins in a packet's payload."""
    start = 1 + content[0]
    n = int.from_bytes(content[start + 1 : start + 3], "big") & 0xFFF
    section = content[start : start + 3 + n]
    if len(section) < n + 3 or crc32_mpeg(section[:-4]) != int.from_bytes(section[-4:], "big"):
        raise ValueError("checksum of a program table")
    return section[0], section[8:-4]


class Stream:
    """The packets of one packet identifier that carry something, each once."""

    def __init__(self, packets: np.ndarray, pid: np.ndarray, wanted: int):
        rows = np.flatnonzero(pid == wanted)
        q = packets[rows]
        adapted = (q[:, 3] & 0x20) > 0
        flags = np.where(adapted & (q[:, 4] > 0), q[:, 5], 0)
        self.access = rows[flags & 0x40 > 0].tolist()
        has = (q[:, 3] & 0x10) > 0
        q, rows, adapted, flags = q[has], rows[has], adapted[has], flags[has]
        step = np.diff(q[:, 3] & 15, prepend=(q[:1, 3] - 1) & 15) & 15
        # A packet may come twice in a row; what differs under the same counter is a loss of 16.
        again = np.zeros(len(q), bool)
        again[1:] = (step[1:] == 0) & (q[1:, 12:] == q[:-1, 12:]).all(1) & (q[1:, :4] == q[:-1, :4]).all(1)
        again[1:] &= ~again[:-1]
        lost = (step != 1) & ~again & (flags & 0x80 == 0)
        self.errors = int(lost.sum())
        q, adapted, self.lost = q[~again], adapted[~again], lost[~again]
        self.first = (q[:, 1] & 0x40) > 0
        start = np.where(adapted, 5 + q[:, 4].astype(np.int64), 4)
        self.content = q[np.arange(PACKET) >= start[:, None]].tobytes()
        self.ends = np.cumsum(PACKET - start)
        self.begins = self.ends - (PACKET - start)

    def units(self) -> list[tuple[bytes, bool]]:
        """The content from each start to the next, and whether a packet is missing in it."""
        heads = np.flatnonzero(self.first)
        tails = np.append(heads[1:], len(self.first))
        return [(self.content[self.begins[h] : self.ends[t - 1]], bool(self.lost[h + 1 : t].any())) for h, t in zip(heads.tolist(), tails.tolist(), strict=False)]


def demux(media: bytes) -> dict:
    """payload, and what the stream says: programs, packets, continuity errors, time stamps, the packet numbers of
    random-access points, and the numbers of the units that lost packets. Raises ValueError for what is no transport
    stream."""
    if len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("sync byte")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    programs: dict[int, int] = {}
    streams: dict[int, int] = {}
    tables = Stream(p, pid, 0)
    errors = tables.errors
    for content, _ in tables.units():
        _, body = _parse_section(content)
        programs |= {int.from_bytes(body[i : i + 2], "big"): int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(body), 4)}
    for table_pid in sorted({n for number, n in programs.items() if number}):  # program 0 is the network's
        tables = Stream(p, pid, table_pid)
        errors += tables.errors
        for content, _ in tables.units():
            _, body = _parse_section(content)
            at = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
            while at < len(body):
                streams[int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF] = body[at]
                at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0xFFF)
    payload, stamps, access, damaged = [], [], [], []
    for wanted in streams:
        stream = Stream(p, pid, wanted)
        errors += stream.errors
        access += stream.access
        for unit, lost in stream.units():
            if unit[:3] != b"\x00\x00\x01" or len(unit) < 9:
                raise ValueError("start code of an elementary packet")
            length, flags, head = int.from_bytes(unit[4:6], "big"), unit[7], unit[8]
            if flags & 0x80:
                t = unit[9:14]
                stamps.append((t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1)
            if lost or length and len(unit) < 6 + length:
                damaged.append(len(payload))
            payload.append(unit[9 + head : 6 + length if length else len(unit)])
    return {
        "payload": b"".join(payload), "programs": programs, "streams": streams, "packets": len(p), "continuity_errors": errors, "pts": stamps,
        "random_access": access, "damaged": damaged,
    }


def to_transport_stream(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Add the stream that carries a binary column."""
    return map_batches(df, lambda b: [[mux(x or b"") for x in b.column(payload).to_pylist()]], [(media, T.BinaryType())])


def from_transport_stream(df: DataFrame, media: str = "media") -> DataFrame:
    """Add what a stream holds: payload_read, packets, continuity_errors, pts, random_access, damaged and stream_types."""
    numbers = T.ArrayType(T.LongType())
    fields = [("payload_read", T.BinaryType()), ("packets", T.LongType()), ("continuity_errors", T.LongType()), ("pts", numbers), ("random_access", numbers), ("damaged", numbers), ("stream_types", T.StringType())]

    def read(b: pa.RecordBatch) -> list:
        found = [demux(x or b"") for x in b.column(media).to_pylist()]
        return [[x[k] for x in found] for k in ("payload", "packets", "continuity_errors", "pts", "random_access", "damaged")] + [[json.dumps(x["streams"], sort_keys=True) for x in found]]

    return map_batches(df, read, fields)


def padded(text: str = "text") -> "F.Column":
    """UTF-8 bytes of a text, with zeros up to a positive multiple of 64."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), (F.greatest(F.ceil(F.octet_length(raw) / 64), F.lit(1)) * 64 - F.octet_length(raw)).cast("int"))))


def op3_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store each text of documents as a transport stream, read it back and describe it."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), padded().alias("payload"))
    read = from_transport_stream(to_transport_stream(docs).drop("payload"))
    back = F.col("payload_read")
    return read.select(
        "doc_id", "n_bytes", F.octet_length(back).cast("long").alias("payload_bytes"), F.sha2(back, 256).alias("payload_sha256"),
        F.crc32(F.substring(back, -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.to_json(F.struct("packets", "continuity_errors", "damaged", "stream_types", F.size("pts").alias("units"), F.element_at("pts", 1).alias("first_pts"), F.element_at("pts", -1).alias("last_pts"), "random_access")).alias("feature"),
    )
