"""ZIP packages and their XML parts as rows, and rows as packages again.

The Python helpers see one package or one part at a time and only split or join bytes; what the
parts mean is told by DataFrame operators.  Inflating is bounded, document type declarations are
refused, and a package that cannot be read becomes one row with an ``error``.
"""

from __future__ import annotations

import functools
import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.sources.shared import lean, sliced

#: A part may inflate to at most so many bytes, and a package to so many in all.
MOST_PART, MOST_PACKAGE = 64 << 20, 256 << 20
#: What every written entry carries as time, date and name flag.
WRITTEN_STAMP = (1980, 1, 1, 0, 0, 0)
#: Packages and parts that become Python objects at once; they can be megabytes each.
BATCH_ROWS = 16
#: Parts are sent on together until there are so many, or so many bytes in them.
MANY_ROWS, MANY_BYTES = 2_000, 1 << 20
XML_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\r\n'
PARTS = "doc_id long, ord int, name string, data binary, time int, date int, is_dir boolean, crc_ok boolean, error string"

#: Namespaces of office formats and the short names used for them here.
NAMESPACES = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "w14": "http://schemas.microsoft.com/office/word/2010/wordml",
    "w15": "http://schemas.microsoft.com/office/word/2012/wordml",
    "p": "http://schemas.openxmlformats.org/presentationml/2006/main",
    "ss": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
    "cp": "http://schemas.openxmlformats.org/package/2006/metadata/core-properties",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "ep": "http://schemas.openxmlformats.org/officeDocument/2006/extended-properties",
    "op": "http://schemas.openxmlformats.org/officeDocument/2006/custom-properties",
    "ct": "http://schemas.openxmlformats.org/package/2006/content-types",
    "rel": "http://schemas.openxmlformats.org/package/2006/relationships",
    "tc": "http://schemas.microsoft.com/office/spreadsheetml/2018/threadedcomments",
}
#: The same formats in their strict form.
STRICT = {
    "http://purl.oclc.org/ooxml/wordprocessingml/main": "w",
    "http://purl.oclc.org/ooxml/presentationml/main": "p",
    "http://purl.oclc.org/ooxml/spreadsheetml/main": "ss",
    "http://purl.oclc.org/ooxml/officeDocument/extendedProperties": "ep",
    "http://purl.oclc.org/ooxml/officeDocument/customProperties": "op",
}
_SHORT = {v: k for k, v in NAMESPACES.items()} | STRICT


def inflate(data: bytes, most: int = MOST_PART, wbits: int = -15) -> bytes:
    """Inflated bytes; ValueError beyond ``most``."""
    d = zlib.decompressobj(wbits)
    out = d.decompress(data, most)
    if d.unconsumed_tail:
        raise ValueError("inflates beyond the limit")
    return out + d.flush()


#: The head of an entry, an entry of the directory, and its end.
_LOCAL, _LISTED, _END = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")


def _directory(content: bytes) -> list[tuple[str, int, int, int, int, int, int, int]] | None:
    """(name, method, time, date, checksum, packed size, size, offset) of each entry, as the directory of a plain package lists it.

    None for any other, and for whatever looks unusual: comments, extra fields, names beyond ASCII, long sizes, other
    bytes around.  Those are left to :mod:`zipfile`, which reads a plain package the same way, more slowly.
    """
    at = len(content) - _END.size
    if at < 0 or content[at : at + 4] != b"PK\5\6" or content[max(at - 20, 0) : max(at - 20, 0) + 4] == b"PK\6\7":
        return None
    _, disk, first, here, n, size, place, comment = _END.unpack_from(content, at)
    if disk or first or comment or here != n or place + size != at:
        return None
    out = []
    while place + _LISTED.size <= at:
        mark, _, needed, _, method, time, date, crc, packed, whole, name, extra, told, _, _, _, offset = _LISTED.unpack_from(content, place)
        raw = content[place + _LISTED.size : place + _LISTED.size + name]
        place += _LISTED.size + name
        if mark != b"PK\1\2" or extra or told or needed & 0xFF > 20 or place > at or max(packed, whole, offset) == 0xFFFFFFFF or not raw.isascii() or b"\0" in raw:
            return None
        out.append((raw.decode(), method, time, date, crc, packed, whole, offset))
    return out if place == at and len(out) == n else None


def _listed(content: bytes) -> list[tuple[str, int, int, int, int, int, int, int]]:
    """What :func:`_directory` tells, of any package."""
    if (plain := _directory(content)) is not None:
        return plain
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        times = [(i, *i.date_time) for i in z.infolist()]
        return [(i.filename, i.compress_type, h << 11 | mi << 5 | s // 2, (y - 1980) << 9 | mo << 5 | d, i.CRC, i.compress_size, i.file_size, i.header_offset) for i, y, mo, d, h, mi, s in times]


def entries(content: bytes, wanted: Callable[[str], object] = lambda name: True) -> list[tuple[str, bytes, int, int, bool, bool]]:
    """(name, data, time, date, is_dir, crc_ok) of each entry that is wanted, in the order of the directory; no other is inflated."""
    out, total = [], 0
    for name, method, time, date, crc, packed, size, offset in _listed(content):
        if not wanted(name):
            continue
        if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"method {method} of {name}")
        head = content[offset : offset + 30]
        if head[:4] != b"PK\3\4":
            raise ValueError(f"no local header of {name}")
        at = offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
        raw = content[at : at + packed]
        data = inflate(raw) if method else raw
        if len(data) != size:
            raise ValueError(f"size of {name}")
        total += len(data)
        if total > MOST_PACKAGE:
            raise ValueError("inflates beyond the limit")
        out.append((name, data, time, date, name.endswith("/"), zlib.crc32(data) == crc))
    return out


def joined_rows(batches: Iterator[pa.RecordBatch], read: Callable[[int, bytes], list[tuple]], types: list[pa.DataType], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """What ``read`` makes of each file (doc_id, content): rows of a slice of files go on together, before they hold much.

    The fourth value of a row is a part's bytes, or how many there are.
    """
    for b in sliced(batches, BATCH_ROWS):
        rows: list[tuple] = []
        held = 0
        for doc, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = read(doc, content.as_py() or b"")
            rows += own
            held += sum(r[3] if isinstance(r[3], int) else len(r[3] or b"") for r in own)
            if rows and (held >= MANY_BYTES or len(rows) >= MANY_ROWS):
                yield _batch(rows, types, columns)
                rows, held = [], 0
        if rows:
            yield _batch(rows, types, columns)


def _batch(rows: list[tuple], types: list[pa.DataType], columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], columns)


def read_packages(files: DataFrame) -> DataFrame:
    """Parts of every package of ``files`` (doc_id, content); an unreadable one is a row with ``error`` alone."""
    def read(doc: int, content: bytes) -> list[tuple]:
        try:
            return [(doc, i, *e[:5], e[5], None) for i, e in enumerate(entries(content))]
        except (ValueError, zipfile.BadZipFile, zlib.error, OSError, NotImplementedError, UnicodeDecodeError) as x:
            return [(doc, None, None, None, None, None, None, None, f"{type(x).__name__}: {x}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return joined_rows(batches, read, _PART_TYPES, _PART_NAMES)

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(lean(run), PARTS)


def list_packages(files: DataFrame) -> DataFrame:
    """doc_id, ord, name and error: what the directories of packages list.  Nothing is inflated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, BATCH_ROWS):
            for doc, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        names, error = z.namelist(), [None] * len(z.namelist())
                except (ValueError, zipfile.BadZipFile, OSError, NotImplementedError, UnicodeDecodeError) as x:
                    names, error = [None], [f"{type(x).__name__}: {x}"]
                order = [i if name is not None else None for i, name in enumerate(names)]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(names), pa.int64()), pa.array(order, pa.int32()), pa.array(names, pa.string()), pa.array(error, pa.string())], ["doc_id", "ord", "name", "error"])

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(lean(run), "doc_id long, ord int, name string, error string")


class PackageParts:
    """Table function of SQL: the parts of a package whose names match a pattern, others are never inflated."""

    def eval(self, content: bytes, pattern: str) -> Iterator[tuple]:
        import re

        try:
            wanted = re.compile(pattern or "").search
            for i, (name, data, *_, crc_ok) in enumerate(entries(bytes(content or b""), wanted)):
                yield i, name, data, crc_ok, None
        except (ValueError, zipfile.BadZipFile, zlib.error, OSError, NotImplementedError, UnicodeDecodeError, re.error) as x:
            yield None, None, None, None, f"{type(x).__name__}: {x}"


class PackageNodes:
    """Table function of SQL: the elements of the XML parts of a package whose names match a pattern."""

    def eval(self, content: bytes, pattern: str) -> Iterator[tuple]:
        for _, name, data, _, error in PackageParts().eval(content, pattern):
            try:
                found = parse_nodes(data) if error is None and name.endswith((".xml", ".rels")) else []
            except (ValueError, expat.ExpatError) as x:
                found, error = [], f"{type(x).__name__}: {x}"
            if error is not None:
                yield name, None, None, None, None, None, error
            for node, parent, tag, text, attrs in found:
                yield name, node, parent, tag, text, attrs, None


def register(spark: SparkSession) -> None:
    """Make ``package_parts(content, pattern)`` and ``package_nodes(content, pattern)`` known to SQL, for lateral joins."""
    spark.udtf.register("package_parts", F.udtf(PackageParts, returnType="ord: int, name: string, data: binary, crc_ok: boolean, error: string"))
    spark.udtf.register("package_nodes", F.udtf(PackageNodes, returnType="part: string, node: int, parent: int, tag: string, text: string, attrs: map<string,string>, error: string"))


_PART_NAMES = [x.split()[0] for x in PARTS.split(", ")]
_PART_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]


def packed(parts: list[tuple[str, bytes]]) -> bytes:
    """A package of deflated entries with one fixed stamp: equal parts give equal bytes.

    Plain ones are written here, byte by byte as :mod:`zipfile` writes them, the others there.
    """
    if len(parts) >= 0xFFFF or sum(len(d) for _, d in parts) > MOST_PACKAGE or not all(x.isascii() and "\0" not in x and len(x) < 0x8000 for x, _ in parts):
        return _packed_by_zipfile(parts)
    body, listed, at = [], [], 0
    for name, data in parts:
        d = zlib.compressobj(-1, zlib.DEFLATED, -15)
        deflated, called = d.compress(data) + d.flush(), name.encode()
        common = (0, zipfile.ZIP_DEFLATED, 0, 0x21, zlib.crc32(data), len(deflated), len(data), len(called), 0)
        body += [_LOCAL.pack(b"PK\3\4", 20, *common), called, deflated]
        listed += [_LISTED.pack(b"PK\1\2", 0x0314, 20, *common, 0, 0, 0, 0o600 << 16, at), called]
        at += _LOCAL.size + len(called) + len(deflated)
    directory = b"".join(listed)
    return b"".join([*body, directory, _END.pack(b"PK\5\6", 0, 0, len(parts), len(parts), len(directory), at, 0)])


def _packed_by_zipfile(parts: list[tuple[str, bytes]]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts:
            i = zipfile.ZipInfo(name, WRITTEN_STAMP)
            i.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(i, data)
    return held.getvalue()


def write_packages(parts: DataFrame) -> DataFrame:
    """doc_id and content of packages made of parts (doc_id, ord, name, data).  A package is one row, whole."""
    return pack_rows(parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "name", "data"))).alias("parts")))


def pack_rows(listed: DataFrame) -> DataFrame:
    """doc_id and content of packages whose parts stand in one row: doc_id, parts (an array of name and data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, BATCH_ROWS):
            parts, bounds = b.column(1).flatten(), b.column(1).offsets.to_pylist()
            names, data = parts.field("name").to_pylist(), parts.field("data").to_pylist()
            at = [x - bounds[0] for x in bounds]
            made = [packed([(x, d or b"") for x, d in zip(names[i:j], data[i:j], strict=True)]) for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["doc_id", "content"])

    return listed.mapInArrow(lean(run), "doc_id long, content binary")


@functools.lru_cache(4096)
def short(name: str) -> str:
    """``prefix:local`` with this project's prefixes; names without namespace are bare."""
    ns, _, local = name.rpartition(" ")
    return f"{_SHORT.get(ns, 'other')}:{local}" if ns else local


def _refuse(*_: object) -> None:
    raise ValueError("document type declaration")


def check_xml(data: bytes) -> None:
    """The errors of :func:`parse_nodes`, without the elements."""
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.StartDoctypeDeclHandler = _refuse
    parser.Parse(data, True)


def parse_nodes(data: bytes) -> list[tuple[int, int, str, str, dict[str, str]]]:
    """(node, parent, tag, text, attributes) of each element; text is that of its own and all inner elements."""
    return [tuple(n) for n in _parsed(data, None)[0]]


def _parsed(data: bytes, told: frozenset[str] | None) -> tuple[list[list], str]:
    """(elements as :func:`parse_nodes` tells them, all text); with ``told`` only elements of those tags have their texts."""
    parser = expat.ParserCreate(namespace_separator=" ")
    nodes: list[list] = []
    stack: list[int] = []
    # All pieces of text; an element's own are those between its start and its end.
    pieces: list[str] = []
    begun: list[int] = []

    def start(name: str, attrs: dict[str, str]) -> None:
        n = len(nodes)
        nodes.append([n, stack[-1] if stack else -1, short(name), "", {short(k): v for k, v in attrs.items()} if attrs else attrs])
        stack.append(n)
        begun.append(len(pieces))

    def end(_: str) -> None:
        node, at = nodes[stack.pop()], begun.pop()
        if at < len(pieces) and (told is None or node[2] in told):
            node[3] = "".join(pieces[at:])

    parser.StartDoctypeDeclHandler, parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = _refuse, start, end, pieces.append
    parser.Parse(data, True)
    return nodes, "".join(pieces)


NODE = "struct<node:int,parent:int,tag:string,text:string,attrs:map<string,string>>"
NODES = pa.list_(pa.struct([("node", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("text", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))]))
INSPECTED = f"doc_id long, ord int, name string, size long, time int, date int, is_dir boolean, crc_ok boolean, nodes array<{NODE}>, error string"

#: Elements outside the property parts whose text is shown or compared.
TEXT_OF = frozenset(["ss:author", "ss:definedName"])


def kept_nodes(name: str, data: bytes) -> list[dict]:
    """Elements with attributes or a text that is needed, and those next to the root.  Texts are kept whole."""
    return kept_nodes_and_text(name, data)[0]


def kept_nodes_and_text(name: str, data: bytes) -> tuple[list[dict], str]:
    """:func:`kept_nodes` and all text of the part, from one reading."""
    nodes, whole = _parsed(data, None if name.startswith("docProps/") else TEXT_OF)
    kept = [{"node": n, "parent": up, "tag": tag, "text": text, "attrs": list(attrs.items())} for n, up, tag, text, attrs in nodes if attrs or up < 1 or text.strip()]
    return kept, whole


def inspect_packages(files: DataFrame, *, told: bool = True) -> DataFrame:
    """Parts of every package with the nodes of XML parts in place of their bytes, for inspection in one pass.

    Without ``told`` parts are read, but nodes are left out: names, sizes, stamps and errors.  A part that is no well-formed XML has an ``error`` and no nodes; a package that cannot be read is
    a row with ``error`` alone.
    """
    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), NODES, pa.string()]
    columns = ["doc_id", "ord", "name", "size", "time", "date", "is_dir", "crc_ok", "nodes", "error"]

    def one(doc: int, i: int, e: tuple[str, bytes, int, int, bool, bool]) -> tuple:
        name, data, time, date, is_dir, crc_ok = e
        nodes, error = None, None
        if name.endswith((".xml", ".rels")):
            try:
                nodes = kept_nodes(name, data) if told else check_xml(data)
            except (ValueError, expat.ExpatError) as x:
                error = f"{type(x).__name__}: {x}"
        return doc, i, name, len(data), time, date, is_dir, crc_ok, nodes, error

    def read(doc: int, content: bytes) -> list[tuple]:
        try:
            return [one(doc, i, e) for i, e in enumerate(entries(content))]
        except (ValueError, zipfile.BadZipFile, zlib.error, OSError, NotImplementedError, UnicodeDecodeError) as x:
            return [(doc, *[None] * 8, f"{type(x).__name__}: {x}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return joined_rows(batches, read, types, columns)

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(lean(run), INSPECTED)


def nodes_of(inspected: DataFrame) -> DataFrame:
    """doc_id, part and the columns of a node, from :func:`inspect_packages`."""
    return inspected.select("doc_id", F.col("name").alias("part"), F.explode("nodes").alias("n")).select("doc_id", "part", "n.*")
