"""Ogg media columns: pages with checksums, lacing, two interleaved logical streams, granule times.

A payload of 8-bit samples is cut into frames of ``FRAME`` samples; frames go in turn to two logical
streams, each with its own serial number.  A granule position is the sample count up to the end of
the last packet that ends on the page.  Reading verifies every page's checksum, joins packets from
lacing values (255 means that the packet goes on, also over pages), separates the streams, derives
each frame's time from granule positions and merges the frames by time.

Null text is an empty payload (192 spaces); repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import slices

BLOCK = 192
FRAME = 4 * BLOCK
RATE = 8000
SERIALS = (0x4C55, 0x4345)
#: Packets of one stream that share a page.
PAGE_PACKETS = 16
_MIRROR = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
_IDENT = struct.Struct("<8sBBIQQ")  # magic, version, streams, rate, samples, unpadded bytes


def page_crc(data: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, not mirrored, starting and ending with 0, by way of zlib's mirrored one."""
    mirrored = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def lacing(packets: list[bytes]) -> tuple[bytes, bytes]:
    """Lacing values and body of whole packets."""
    values = bytearray()
    for p in packets:
        full, rest = divmod(len(p), 255)
        values += b"\xff" * full + bytes([rest])
    return bytes(values), b"".join(packets)


def page(kind: int, granule: int, serial: int, number: int, values: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(values)) + values
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream; packets are (data, granule at its end).  Long packets go on over pages."""
    pages, number, at = [], 0, 0
    groups = [packets[:1]] + [packets[i : i + PAGE_PACKETS] for i in range(1, len(packets), PAGE_PACKETS)]
    for g, group in enumerate(groups):
        values, body = lacing([p for p, _ in group])
        ends = [i for i, v in enumerate(values) if v < 255]
        granules = dict(zip(ends, (x for _, x in group), strict=True))
        at = offset = 0
        while at < len(values):
            part = values[at : at + 255]
            size = sum(part)
            done = [granules[i] for i in range(at, at + len(part)) if i in granules]
            goes_on = at > 0 and values[at - 1] == 255
            last = g == len(groups) - 1 and at + 255 >= len(values)
            kind = goes_on | 2 * (number == 0) | 4 * last
            pages.append(page(kind, done[-1] if done else -1, serial, number, part, body[offset : offset + size]))
            at, offset, number = at + len(part), offset + size, number + 1
    return pages


def encode(payload: bytes, unpadded: int) -> bytes:
    """The stored form of a payload."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    streams: list[list[tuple[bytes, int]]] = [[(_IDENT.pack(b"PCMU8\0\0\0", 1, len(SERIALS), RATE, len(payload), unpadded), 0)] for _ in SERIALS]
    for i, frame in enumerate(frames):
        streams[i % len(SERIALS)].append((frame, min((i + 1) * FRAME, len(payload))))
    laid = [stream_pages(s, p) for s, p in zip(SERIALS, streams, strict=True)]
    longest = max(map(len, laid))
    return b"".join(x[i] for i in range(longest) for x in laid if i < len(x))


@dataclass
class Logical:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    partial: bytearray = field(default_factory=bytearray)
    open: bool = False
    pages: int = 0
    ended: bool = False


@dataclass
class Decoded:
    payload: bytes
    unpadded: int
    pages: int
    frames: int
    seconds: float


def demultiplex(data: bytes) -> dict[int, Logical]:
    """Logical streams by serial number; ValueError on a bad checksum, a lost page or a packet without end."""
    streams: dict[int, Logical] = {}
    at = 0
    while at < len(data):
        magic, version, kind, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        values = data[at + _HEAD.size : at + _HEAD.size + n]
        body = at + _HEAD.size + n
        end = body + sum(values)
        if end > len(data) or page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"bad checksum at byte {at}")
        s = streams.setdefault(serial, Logical())
        if number != s.pages or bool(kind & 1) != s.open or bool(kind & 2) != (number == 0):
            raise ValueError(f"page out of order at byte {at}")
        s.pages += 1
        s.ended |= bool(kind & 4)
        first = len(s.packets)
        for v in values:
            s.partial += data[body : body + v]
            body += v
            s.open = v == 255
            if not s.open:
                s.packets.append(bytes(s.partial))
                s.partial.clear()
        s.granules += [-1] * (len(s.packets) - first)
        if len(s.packets) > first:
            s.granules[-1] = granule
        at = end
    if any(s.open or not s.ended for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def decode(data: bytes) -> Decoded:
    """Read the stored form back: frames of all streams, merged by the times that granules give them."""
    streams = demultiplex(data)
    timed: list[tuple[int, int, bytes]] = []
    rate = samples = unpadded = pages = 0
    for serial, s in streams.items():
        magic, version, count, rate, samples, unpadded = _IDENT.unpack(s.packets[0])
        if magic != b"PCMU8\0\0\0" or version != 1:
            raise ValueError("unknown codec")
        pages += s.pages
        step = count * FRAME
        granules = s.granules[1:]
        for i in range(len(granules) - 1, -1, -1):  # packets before a page's last end one frame of each stream earlier
            if granules[i] < 0:
                granules[i] = (granules[i + 1] if granules[i + 1] % FRAME == 0 else -(-granules[i + 1] // FRAME) * FRAME) - step
        timed += [(g - len(p), serial, p) for g, p in zip(granules, s.packets[1:], strict=True)]
    timed.sort(key=lambda x: x[0])
    at = 0
    for start, _, p in timed:
        if start != at:
            raise ValueError(f"a frame starts at sample {start}, not {at}")
        at += len(p)
    if at != samples:
        raise ValueError("samples are missing")
    return Decoded(b"".join(p for _, _, p in timed), unpadded, pages, len(timed), samples / rate)


def describe(d: Decoded) -> str:
    """Features of the samples read back: duration, pages, frames, level, peak and zero crossings."""
    x = np.frombuffer(d.payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(x >= 0)))
    return f"seconds={d.seconds:.6f};pages={d.pages};frames={d.frames};mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};peak={int(np.abs(x).max())};crossings={crossings}"


def media_columns(documents: DataFrame) -> DataFrame:
    """Store every text as Ogg, read the bytes back and describe them (doc_id, media, payload, n_bytes, feature)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text in b.column("text").to_pylist():
                raw = (text or "").encode("utf-8")
                size = max(BLOCK, -(-len(raw) // BLOCK) * BLOCK)
                media = encode(raw.ljust(size, b" "), len(raw))
                back = decode(media)
                rows.append((back.unpadded, len(back.payload), hashlib.sha256(back.payload).hexdigest(), zlib.crc32(back.payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(back)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_files(documents: DataFrame) -> DataFrame:
    """doc_id and the stored Ogg bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            media = []
            for text in b.column("text").to_pylist():
                raw = (text or "").encode("utf-8")
                media.append(encode(raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b" "), len(raw)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")
