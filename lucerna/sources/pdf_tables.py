"""Objects and cross-reference tables of PDF files as rows; a table is the chain of sections from the last ``startxref`` on."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.sources.packages import BATCH_ROWS, MOST_PART
from lucerna.sources.pdf_objects import HIGHEST, START, body_end, objects_of, stream_of, undo_predictor
from lucerna.sources.pdf_tokens import filters, integer, name_of, own, structure, tokens
from lucerna.sources.shared import lean, sliced

_FIRST = re.compile(r"startxref\s+([0-9]{1,12})")
_COUNT = re.compile(r"\s*([0-9]{1,10})\s+([0-9]{1,10})\b")
_ENTRY = re.compile(r"\s*([0-9]{10})\s([0-9]{5})\s([nf])")
_TRAILER = re.compile(r"\s*trailer\b")
_SPACE = re.compile(r"\s*")

#: A section: its dictionary, and rows of number, kind (1 in the file, 2 in an object stream), place, generation or index.
Section = tuple[str, np.ndarray]


def _number(dictionary: dict[str, str], key: str) -> int | None:
    return integer(dictionary.get(key))


def _numbers(dictionary: dict[str, str], key: str) -> list[int] | None:
    value = dictionary.get(key, "")
    found = [integer(value[a:b]) for kind, a, b in tokens(value) if kind == "word"]
    return found if value.startswith("[") and None not in found else None


def _dictionary_end(t: str, at: int) -> int:
    """Behind the dictionary that starts at or after ``at``; ``at`` without one."""
    depth = 0
    for kind, start, end in tokens(t, at):
        depth += {"<<": 1, ">>": -1}.get(kind, 0)
        if depth <= 0:
            return end if kind == ">>" else at
    return at


def _listed(t: str, at: int) -> Section | None:
    if not t.startswith("xref", at):
        return None
    rows, at = [], at + 4
    while m := _COUNT.match(t, at):
        first, at = int(m[1]), m.end()
        for num in range(first, first + int(m[2])):
            if not (e := _ENTRY.match(t, at)):
                break
            at = e.end()
            if e[3] == "n":
                rows.append((num, 1, int(e[1]), int(e[2])))
    m = _TRAILER.match(t, at)
    return t[m.end() : _dictionary_end(t, m.end())].strip() if m else "", np.array(rows, np.int64).reshape(-1, 4)


def _streamed(content: bytes, t: str, at: int) -> Section | None:
    m = START.match(t, _SPACE.match(t, at).end())
    if not m:
        return None
    end, at, has_stream = body_end(t, m.end())
    value = t[m.end() : end].strip()
    held = own(value)
    width = _numbers(held, "W")
    if not has_stream or name_of(held.get("Type", "")) != "XRef" or not width:
        return None
    data, _ = stream_of(content, t, value, at, lambda _: None)
    if len(width) != 3 or not 0 < sum(width) <= 24 or max(width) > 8:
        return None
    data = stream_data(value, data)
    if data is None:
        return None
    table = np.frombuffer(data[: len(data) // sum(width) * sum(width)], np.uint8).reshape(-1, sum(width))
    fields, left = [], 0
    for n in width:
        x = np.zeros(len(table), np.uint64)
        for k in range(left, left + n):
            x = x << np.uint64(8) | table[:, k]
        fields.append(x.astype(np.int64))
        left += n
    kind = fields[0] if width[0] else np.ones(len(table), np.int64)
    bounds = _numbers(held, "Index") or [0, _number(held, "Size") or 0]
    numbers, room = [], len(table)
    for first, n in zip(bounds[::2], bounds[1::2], strict=False):
        numbers.append(np.arange(min(n, room), dtype=np.int64) + min(first, 2**40))
        room -= len(numbers[-1])
    num = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    rows = np.stack([num, *(x[: len(num)] for x in (kind, *fields[1:]))], 1)
    return value, rows[(rows[:, 1] == 1) | (rows[:, 1] == 2)]


def sections_of(content: bytes) -> list[Section]:
    """Sections newest first: what a table names in a stream beside it comes before what it names as earlier."""
    t = content.decode("latin-1")
    begin = t.rfind("startxref")
    m = _FIRST.match(t, begin) if begin >= 0 else None
    ahead, seen, out = [int(m[1])] if m else [], set(), []
    while ahead:
        at = ahead.pop()
        if at in seen or at >= len(t):
            continue
        seen.add(at)
        if section := _listed(t, at) or _streamed(content, t, at):
            out.append(section)
            held = own(section[0])
            ahead += [x for key in ("Prev", "XRefStm") if (x := _number(held, key)) is not None]
    return out


def table_of(content: bytes) -> tuple[str | None, dict[int, tuple[int, int, int]]]:
    """(trailer, (kind, place, generation or index) by number), the newest entry of each; nothing if no table can be used."""
    sections = sections_of(content)
    trailer = next((d for d, _ in sections if "Root" in own(d)), None)
    if not trailer or sum(len(rows) for _, rows in sections) > HIGHEST:
        return None, {}
    found: dict[int, tuple[int, int, int]] = {}
    for _, rows in reversed(sections):
        found |= {num: (kind, a, b) for num, kind, a, b in rows[::-1].tolist()}
    return (trailer, found) if found else (None, {})


def last_trailer(t: str) -> str | None:
    """The last dictionary behind the word ``trailer`` in a file."""
    at = len(t)
    while (at := t.rfind("trailer", 0, at)) >= 0:
        end = _dictionary_end(t, at + 7)
        if end > at + 7:
            return t[at + 7 : end].strip()
    return None


READ = "doc_id long, ord int, told boolean, num long, gen int, dict string, type string, refs array<long>, stream_at long, stream_bytes long, stream_sha binary, data binary, unread boolean, holder long, place long, trailer string, listed string"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
#: Objects whose streams are read; those of all others are only copied.
READ_STREAMS = ("ObjStm", "Metadata")
#: Rows are sent on together until there are so many, or a file of so many bytes is among them.
MANY_ROWS, LARGE_FILE = 2_000, 1 << 20


def stream_data(value: str, stream: bytes) -> bytes | None:
    """What a stream holds, its predictor undone; None where another filter is used, or it is damaged or too large."""
    flate, other, columns = filters(value)
    if other or not flate:
        return None if other else stream
    try:
        d = zlib.decompressobj()
        got = d.decompress(stream, MOST_PART)
        got = undo_predictor(got, columns) if columns else got
        return None if d.unconsumed_tail else got
    except (zlib.error, ValueError):
        return None


def _object_row(doc: int, i: int, told: bool, num: int, gen: int, value: str, at: int, stream: bytes | None) -> dict:
    found, refs = structure(value)
    kind = next((value[s:e] for depth, key, _, s, e in found if depth == 1 and key == "Type"), "")
    kind = name_of(kind) if kind.startswith("/") else None
    row = {"doc_id": doc, "ord": i, "told": told, "num": num, "gen": gen, "dict": value, "type": kind, "refs": list(dict.fromkeys(refs)), "unread": False}
    if stream is not None:
        row |= {"stream_at": at, "stream_bytes": len(stream), "stream_sha": hashlib.sha256(stream).digest()}
        if kind in READ_STREAMS:
            row["data"] = stream_data(value, stream)
            row["unread"] = row["data"] is None
    return row


def read_rows(files: DataFrame) -> DataFrame:
    """Everything that one pass over each file tells.

    A row for each object that stands in the file, repeated numbers included (``dict`` is there; ``told``: it stands
    where the file's table says; its stream by place, length and digest); a row for each number that the table puts
    into an object stream (``holder``, ``place``); and one row for the file with the trailer of its table and the last
    one in the file (``num`` is null).
    """
    names = [x.split()[0] for x in READ.split(", ")]
    schema = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in READ.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in sliced(batches, BATCH_ROWS):
            for doc, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = content.as_py() or b""
                trailer, found = table_of(raw)
                rows.append({"doc_id": doc, "trailer": trailer, "listed": last_trailer(raw.decode("latin-1"))})
                rows += [{"doc_id": doc, "num": num, "holder": a, "place": i} for num, (kind, a, i) in found.items() if kind == 2]
                for i, (at, num, gen, value, begin, stream) in enumerate(objects_of(raw)):
                    rows.append(_object_row(doc, i, found.get(num, ())[:2] == (1, at), num, gen, value, begin, stream))
                if len(rows) >= MANY_ROWS or len(raw) >= LARGE_FILE:
                    yield pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names}, schema)
                    rows = []
        yield pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names}, schema)

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(lean(run), READ)


def read_objects(files: DataFrame) -> DataFrame:
    """Every object that stands in a file, with its stream; ``told``: it stands where the file's table says."""
    rows = read_rows(files).filter("dict IS NOT NULL").select("doc_id", "ord", "told", "num", "gen", "dict", "stream_at", "stream_bytes")
    stream = F.when(F.col("stream_at").isNotNull(), F.substr("content", (F.col("stream_at") + 1).cast("int"), F.col("stream_bytes").cast("int")))
    return rows.join(files.select(F.col("doc_id").cast("long").alias("doc_id"), "content"), "doc_id").select("doc_id", "ord", "told", "num", "gen", "dict", stream.alias("stream"))
