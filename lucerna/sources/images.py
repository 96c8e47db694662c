"""Image files as rows of segments, and EXIF blocks as structs.

The helpers walk one file's segments with bounds on every step; what a segment means and whether it
stays is decided by DataFrame operators.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.sources.packages import BATCH_ROWS
from lucerna.sources.shared import in_slices, lean, sent_together, sliced

SEGMENTS = "doc_id long, format string, ord int, kind string, segment binary, payload binary, error string"
_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.string()]
EXIF_HEADER = b"Exif\0\0"


_CODED_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)


def _end_mark(b: bytes, at: int) -> int:
    """Behind the end mark of the scans that start at ``at``; the end of the file without one."""
    while m := _CODED_END.search(b, at):
        if b[m.start() + 1] == 0xD9:
            return m.end()
        at = m.end() + int.from_bytes(b[m.end() : m.end() + 2], "big") if m.end() + 2 <= len(b) else len(b)
    return len(b)


def jpeg_segments(b: bytes) -> Iterator[tuple[str, bytes, bytes]]:
    """(marker, whole segment, payload); the scans up to the end mark are one piece, what follows it the last."""
    yield "SOI", b[:2], b""
    at = 2
    while at < len(b):
        if at + 2 > len(b) or b[at] != 0xFF:
            raise ValueError("bad marker")
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker in (0xDA, 0xD9):
            end = _end_mark(b, at)
            yield "SCAN", b[at:end], b""
            if end < len(b):
                yield "TAIL", b[end:], b""
            return
        elif marker == 1 or 0xD0 <= marker <= 0xD7:
            yield f"{marker:02X}", b[at : at + 2], b""
            at += 2
        else:
            size = int.from_bytes(b[at + 2 : at + 4], "big")
            if size < 2 or at + 2 + size > len(b):
                raise ValueError("segment beyond the end")
            yield f"{marker:02X}", b[at : at + 2 + size], b[at + 4 : at + 2 + size]
            at += 2 + size


def png_segments(b: bytes) -> Iterator[tuple[str, bytes, bytes]]:
    yield "SIGNATURE", b[:8], b""
    at = 8
    while at + 12 <= len(b):
        size = int.from_bytes(b[at : at + 4], "big")
        if at + 12 + size > len(b):
            raise ValueError("chunk beyond the end")
        kind = b[at + 4 : at + 8].decode("latin-1")
        yield kind, b[at : at + 12 + size], b[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == "IEND":
            if at < len(b):
                yield "TAIL", b[at:], b""
            return


def webp_segments(b: bytes) -> Iterator[tuple[str, bytes, bytes]]:
    yield "RIFF", b[:12], b""
    at, whole = 12, b
    b = whole[: 8 + int.from_bytes(whole[4:8], "little")]
    while at + 8 <= len(b):
        size = int.from_bytes(b[at + 4 : at + 8], "little")
        end = at + 8 + size + size % 2
        if at + 8 + size > len(b):
            raise ValueError("chunk beyond the end")
        yield b[at : at + 4].decode("latin-1"), b[at:end].ljust(8 + size + size % 2, b"\0"), b[at + 8 : at + 8 + size]
        at = end
    if len(b) < len(whole):
        yield "TAIL", whole[len(b) :], b""


WALKS = {"jpeg": jpeg_segments, "png": png_segments, "webp": webp_segments}


def read_segments(files: DataFrame) -> DataFrame:
    """Segments of ``files`` (doc_id, format, content) of a known format; a broken file is one row with ``error``."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
        for b in sliced(batches, BATCH_ROWS):
            for doc, fmt, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = content.as_py()
                try:
                    rows = [(doc, fmt, i, *s, None) for i, s in enumerate(WALKS[fmt](raw))]
                except (ValueError, IndexError) as x:
                    rows = [(doc, fmt, None, None, None, None, str(x))]
                yield 2 * len(raw), rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sent_together(read(batches), _TYPES, [x.split()[0] for x in SEGMENTS.split(", ")])

    return files.filter(F.col("format").isin(*WALKS)).select(F.col("doc_id").cast("long").alias("doc_id"), "format", "content").mapInArrow(lean(run), SEGMENTS)


_FIELD = pa.struct([("dir", pa.string()), ("tag", pa.int32()), ("value", pa.string())])
_EXIF = pa.struct([("more", pa.list_(_FIELD)), ("latitude", pa.float64()), ("longitude", pa.float64()), ("fields", pa.list_(pa.struct([("tag", pa.int32()), ("value", pa.string())]))), ("gps", pa.list_(pa.int32())), ("thumbnail", pa.bool_()), ("orientation", pa.int32()), ("width", pa.int32()), ("height", pa.int32())])
EXIF = "struct<more:array<struct<dir:string,tag:int,value:string>>,latitude:double,longitude:double,fields:array<struct<tag:int,value:string>>,gps:array<int>,thumbnail:boolean,orientation:int,width:int,height:int>"


#: Fields that lead to other directories.
SUBDIRECTORIES = {0x8769: "Exif", 0x8825: "GPS", 0xA005: "Interop"}


def degrees(value: str | None, side: str | None, below: str) -> float | None:
    """Degrees, minutes and seconds as fractions ("41/1, 24/1, 1234/100"), signed by their side; None where they make no number."""
    try:
        parts = [int(a) / int(b) for a, b in (x.split("/") for x in (value or "").split(", "))]
    except (ValueError, ZeroDivisionError):
        return None
    found = sum(x / 60**k for k, x in enumerate(parts[:3]))
    return -found if (side or "").startswith(below) else found


def parse_exif(b: bytes | None) -> dict | None:
    """Fields of the first directory and tags of the GPS directory; None where there is no TIFF header.

    ``more`` has the fields of all directories that the first leads to (camera, GPS, interoperability, those of following
    pictures), each read once even if they lead in a circle; coordinates are degrees, south and west below zero.
    """
    if b and b.startswith(EXIF_HEADER):
        b = b[6:]
    if not b or len(b) < 8 or b[:4] not in (b"II*\0", b"MM\0*"):
        return None
    order = "<" if b[:2] == b"II" else ">"

    def directory(at: int) -> tuple[list[tuple[int, str | None]], int]:
        if at < 8 or at + 2 > len(b):
            return [], 0
        (n,) = struct.unpack_from(order + "H", b, at)
        out = []
        for k in range(n):
            p = at + 2 + 12 * k
            if p + 12 > len(b):
                return out, 0
            tag, kind, count = struct.unpack_from(order + "HHI", b, p)
            width = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 9: 4, 10: 8}.get(kind)
            if not width:
                out.append((tag, None))
                continue
            size = width * count
            q = p + 8 if size <= 4 else struct.unpack_from(order + "I", b, p + 8)[0]
            if q + size > len(b):
                out.append((tag, None))
            elif kind == 2:
                out.append((tag, b[q : q + size].split(b"\0")[0].decode("latin-1").strip()))
            elif kind in (5, 10):
                code = order + ("II" if kind == 5 else "ii")
                out.append((tag, ", ".join("%d/%d" % struct.unpack_from(code, b, q + 8 * i) for i in range(min(count, 8)))))
            else:
                code = order + {1: "B", 3: "H", 4: "I", 9: "i"}[kind]
                out.append((tag, ", ".join(str(struct.unpack_from(code, b, q + width * i)[0]) for i in range(min(count, 8)))))
        end = at + 2 + 12 * n
        return out, struct.unpack_from(order + "I", b, end)[0] if end + 4 <= len(b) else 0

    fields, following = directory(struct.unpack_from(order + "I", b, 4)[0])
    known = dict(fields)
    number = lambda t: int(known[t]) if (known.get(t) or "").isdigit() else 0
    gps = [t for t, _ in directory(number(0x8825))[0]] if number(0x8825) else []
    more, seen = [], {struct.unpack_from(order + "I", b, 4)[0]}
    ahead = [(name, number(tag)) for tag, name in SUBDIRECTORIES.items() if number(tag)] + ([("IFD1", following)] if following else [])
    while ahead:
        name, at = ahead.pop(0)
        if at in seen:
            continue
        seen.add(at)
        found, then = directory(at)
        more += [(name, t, v) for t, v in found]
        ahead += [(SUBDIRECTORIES[t], int(v)) for t, v in found if t in SUBDIRECTORIES and (v or "").isdigit()] + ([(name, then)] if then else [])
    place = {t: v for name, t, v in more if name == "GPS"}
    return {"more": [{"dir": d, "tag": t, "value": v} for d, t, v in more], "latitude": degrees(place.get(2), place.get(1), "S"), "longitude": degrees(place.get(4), place.get(3), "W"), "fields": [{"tag": t, "value": v} for t, v in fields], "gps": gps, "thumbnail": 8 <= following < len(b), "orientation": number(0x0112), "width": number(0xA002), "height": number(0xA003)}


def exif(payload: Column) -> Column:
    def parse(blocks: pa.Array) -> pa.Array:
        return pa.array([parse_exif(x) for x in blocks.to_pylist()], _EXIF)

    return in_slices(parse, EXIF)(payload)


def tiff_block(orientation: Column, width: Column, height: Column) -> Column:
    """A big-endian EXIF block that holds the orientation and, where known, the size: no other field."""
    field = lambda tag, kind, value: F.concat(F.unhex(F.lit(f"{tag:04X}{kind:04X}00000001")), value)
    wide = lambda c, n: F.unhex(F.lpad(F.hex(c.cast("long")), n, "0"))
    none = F.unhex(F.lit(""))
    sized = lambda tag, c: F.when(c > 0, field(tag, 4, wide(c, 8))).otherwise(none)
    count = F.lit(1) + (width > 0).cast("int") + (height > 0).cast("int")
    return F.concat(F.unhex(F.lit("4D4D002A00000008")), wide(count, 4), field(0x0112, 3, F.concat(wide(orientation, 4), F.unhex(F.lit("0000")))), sized(0xA002, width), sized(0xA003, height), F.unhex(F.lit("00000000")))
