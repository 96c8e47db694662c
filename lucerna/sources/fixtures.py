"""Packages, images and PDF files made from a table of texts, for tests and registered queries.

Each document becomes a file that carries its own columns as metadata, so that what inspection finds
in it can be told from the table alone.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions.text import escape_markup
from lucerna.sources.packages import NAMESPACES, XML_HEAD, pack_rows
from lucerna.sources.shared import in_slices


def _ns(*prefixes: str) -> str:
    return " ".join(f'xmlns:{p}="{NAMESPACES[p]}"' for p in prefixes)


def xml_text(text: Column) -> Column:
    """A text as XML character data: markup escaped, characters that XML does not allow left out."""
    return F.regexp_replace(escape_markup(F.coalesce(text, F.lit(""))), r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "")


def _xml(*pieces: Column | str) -> Column:
    return F.concat(F.lit(XML_HEAD), *(F.lit(p) if isinstance(p, str) else p for p in pieces)).cast("binary")


def _office_rows(documents: DataFrame) -> DataFrame:
    """doc_id and parts (name, data) of one package for each document: Word, Excel or PowerPoint by its id."""
    i, source, lang = F.col("doc_id"), xml_text(F.col("source")), xml_text(F.col("lang"))
    number = i.cast("string")
    core = _xml('<cp:coreProperties xmlns:cp="', NAMESPACES["cp"], '" ', _ns("dc", "dcterms"), "><dc:title>Documento ", number, "</dc:title><dc:creator>", source, "</dc:creator><cp:lastModifiedBy>", lang, "</cp:lastModifiedBy></cp:coreProperties>")
    app = _xml('<Properties xmlns="', NAMESPACES["ep"], '"><Company>Empresa ', lang, "</Company><TotalTime>", (i % 100).cast("string"), "</TotalTime></Properties>")
    # The body: the whole text, one inserted and one deleted run, a session id on the paragraph.
    body = _xml(
        "<w:document ", _ns("w", "w14"), '><w:body><w:p w:rsidR="00A1B2C3" w14:paraId="1F"><w:r><w:t xml:space="preserve">', xml_text(F.col("text")), "</w:t></w:r></w:p>",
        '<w:p><w:ins w:id="1" w:author="', source, '" w:date="2024-01-02T03:04:05Z"><w:r><w:t>nuevo</w:t></w:r></w:ins><w:del w:id="2" w:author="', lang, '" w:date="2024-01-01T00:00:00Z"><w:r><w:delText>viejo</w:delText></w:r></w:del>',
        '<w:commentRangeStart w:id="0"/><w:r><w:commentReference w:id="0"/></w:r></w:p></w:body></w:document>',
    )
    comments = _xml("<w:comments ", _ns("w"), '><w:comment w:id="0" w:author="', source, '" w:initials="x" w:date="2024-01-03T00:00:00Z"><w:p><w:r><w:t>nota</w:t></w:r></w:p></w:comment></w:comments>')
    people = _xml("<w15:people ", _ns("w15"), '><w15:person w15:author="', source, '"><w15:presenceInfo w15:providerId="AD" w15:userId="', number, '"/></w15:person></w15:people>')
    settings = _xml("<w:settings ", _ns("w"), '><w:trackRevisions/><w:rsids><w:rsidRoot w:val="00A1B2C3"/><w:rsid w:val="00A1B2C3"/></w:rsids></w:settings>')
    hidden = F.when(i % 2 == 0, F.lit(' state="hidden"')).otherwise("")
    defined = F.when(i % 5 == 0, F.lit('<definedNames><definedName name="Fuera">[1]Hoja!$A$1</definedName></definedNames>')).otherwise("")
    book = _xml('<workbook xmlns="', NAMESPACES["ss"], '"><sheets><sheet name="A" sheetId="1"/><sheet name="B" sheetId="2"', hidden, "/></sheets>", defined, "</workbook>")
    connections = _xml('<connections xmlns="', NAMESPACES["ss"], '"><connection id="1" name="db"><dbPr connection="Server=', source, ';Password=secreto" command="SELECT 1"/></connection></connections>')
    link = _xml('<Relationships xmlns="', NAMESPACES["rel"], '"><Relationship Id="rId1" Type="x" Target="C:\\datos\\', number, '.xlsx" TargetMode="External"/></Relationships>')
    authors = _xml("<p:cmAuthorLst ", _ns("p"), '><p:cmAuthor id="0" name="', source, '" initials="x"/></p:cmAuthorLst>')
    notes = _xml("<p:notes ", _ns("p"), ' xmlns:a="urn:a"><a:t>', xml_text(F.col("text")), "</a:t></p:notes>")
    slides = _xml("<p:presentation ", _ns("p"), "/>")
    raw = F.unhex(F.lit("FFD8FFD9"))
    kinds: list[tuple[Column, str, Column]] = [
        (i % 3 == 0, "word/document.xml", body), (i % 3 == 0, "word/comments.xml", comments), (i % 3 == 0, "word/people.xml", people), (i % 3 == 0, "word/settings.xml", settings),
        ((i % 3 == 0) & (i % 7 == 0), "word/vbaProject.bin", raw), (i % 3 == 1, "xl/workbook.xml", book), ((i % 3 == 1) & (i % 4 == 1), "xl/connections.xml", connections),
        ((i % 3 == 1) & (i % 6 == 1), "xl/externalLinks/_rels/externalLink1.xml.rels", link), ((i % 3 == 1) & (i % 6 == 1), "xl/printerSettings/printerSettings1.bin", raw),
        (i % 3 == 2, "ppt/presentation.xml", slides), (i % 3 == 2, "ppt/commentAuthors.xml", authors), (i % 3 == 2, "ppt/notesSlides/notesSlide1.xml", notes),
        (i >= 0, "docProps/core.xml", core), (i >= 0, "docProps/app.xml", app), (i % 3 == 0, "docProps/thumbnail.jpeg", raw),
    ]
    listed = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("name"), d.alias("data"))) for c, n, d in kinds)))
    have = documents.select("doc_id", listed.alias("p"))
    override = F.transform("p", lambda x: F.concat(F.lit('<Override PartName="/'), x["name"], F.lit('" ContentType="x"/>')))
    relation = F.transform("p", lambda x: F.concat(F.lit('<Relationship Id="r" Type="x" Target="'), x["name"], F.lit('"/>')))
    types = _xml('<Types xmlns="', NAMESPACES["ct"], '">', F.array_join(override, ""), "</Types>")
    rels = _xml('<Relationships xmlns="', NAMESPACES["rel"], '">', F.array_join(relation, ""), "</Relationships>")
    head = F.array(F.struct(F.lit("[Content_Types].xml").alias("name"), types.alias("data")), F.struct(F.lit("_rels/.rels").alias("name"), rels.alias("data")))
    return have.select("doc_id", F.concat(head, F.col("p")).alias("parts"))


def office_parts(documents: DataFrame) -> DataFrame:
    """doc_id, ord, name, data of the parts of :func:`office_files`."""
    return _office_rows(documents).select("doc_id", F.posexplode("parts").alias("ord", "x")).select("doc_id", "ord", "x.name", "x.data")


def respelled(parts: DataFrame) -> DataFrame:
    """The same parts with other prefixes and single quotes: valid XML that says the same."""
    x = F.col("data").cast("string")
    for old, new in (("w", "q"), ("w14", "n1"), ("w15", "n2"), ("cp", "props"), ("p", "slides")):
        x = F.regexp_replace(F.regexp_replace(x, rf"(</?){old}:", f"$1{new}:"), rf"( xmlns:|\s){old}(=|:[A-Za-z0-9]+=)", f"$1{new}$2")
    quoted = F.regexp_replace(x, r"""([A-Za-z0-9:]+=)"([^"'<>]*)\"""", "$1'$2'")
    return parts.withColumn("data", F.when(F.col("name").endswith(".xml") | F.col("name").endswith(".rels"), quoted.cast("binary")).otherwise(F.col("data")))


def office_files(documents: DataFrame) -> DataFrame:
    """doc_id and content of :func:`office_parts` as packages."""
    return pack_rows(_office_rows(documents))


def _hex(text: str) -> Column:
    return F.unhex(F.lit(text.replace(" ", "")))


def _number(n: Column, digits: int, *, little: bool = False) -> Column:
    hexed = F.lpad(F.hex(n.cast("long")), digits, "0")
    if little:
        hexed = F.concat(*(F.substring(hexed, digits - 1 - k, 2) for k in range(0, digits, 2)))
    return F.unhex(hexed)


def _camera(maker: Column) -> Column:
    """A TIFF block with maker, orientation 6 and one GPS field; the maker has at least four characters."""
    m = F.concat(maker.cast("binary"), _hex("00"))
    size = F.octet_length(m)
    return F.concat(
        _hex("4D4D002A 00000008 0003 010F 0002"), _number(size, 8), _hex("00000032 0112 0003 00000001 00060000 8825 0004 00000001"), _number(size + 50, 8), _hex("00000000"),
        m, _hex("0001 0001 0002 00000002 4E000000 00000000"),
    )


def image_files(documents: DataFrame) -> DataFrame:
    """doc_id and content of a JPEG, PNG or WebP (by id) that carries the text as its picture data."""
    i, data = F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary")
    tiff, lang = _camera(F.col("source")), F.col("lang").cast("binary")
    xmp = F.concat(F.lit("<x:xmpmeta><xmp:CreatorTool>"), F.col("lang"), F.lit("</xmp:CreatorTool></x:xmpmeta>")).cast("binary")

    def app(marker: str, payload: Column) -> Column:
        return F.concat(_hex(f"FF{marker}"), _number(F.octet_length(payload) + 2, 4), payload)

    def chunk(kind: bytes, payload: Column) -> Column:
        named = F.concat(F.lit(kind), payload)
        return F.concat(_number(F.octet_length(payload), 8), named, _number(F.crc32(named), 8))

    def riff(kind: bytes, payload: Column) -> Column:
        pad = F.when(F.octet_length(payload) % 2 == 1, _hex("00")).otherwise(_hex(""))
        return F.concat(F.lit(kind), _number(F.octet_length(payload), 8, little=True), payload, pad)

    jpeg = F.concat(_hex("FFD8"), app("E0", F.lit(b"JFIF\0\1\1\0\0\1\0\1\0\0")), app("E1", F.concat(F.lit(b"Exif\0\0"), tiff)), app("E1", F.concat(F.lit(b"http://ns.adobe.com/xap/1.0/\0"), xmp)), app("FE", lang), _hex("FFDA 0002"), data, _hex("FFD9"))
    png = F.concat(_hex("89504E470D0A1A0A"), chunk(b"IHDR", _hex("00000001 00000001 08 00 00 00 00")), chunk(b"tEXt", F.concat(F.lit(b"Author "), lang)), chunk(b"eXIf", tiff), chunk(b"IDAT", data), chunk(b"IEND", _hex("")))
    body = F.concat(F.lit(b"WEBP"), riff(b"VP8X", _hex("0C000000 000000 000000")), riff(b"VP8 ", data), riff(b"EXIF", tiff), riff(b"XMP ", xmp))
    webp = F.concat(F.lit(b"RIFF"), _number(F.octet_length(body), 8, little=True), body)
    return documents.select("doc_id", F.when(i % 3 == 0, jpeg).when(i % 3 == 1, png).otherwise(webp).alias("content"))


def tiff_files(documents: DataFrame) -> DataFrame:
    """doc_id and content of a TIFF with the camera's fields and the text behind them."""
    return documents.select("doc_id", F.concat(_camera(F.col("source")), F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("content"))


def heic_files(documents: DataFrame) -> DataFrame:
    """doc_id and content of a file with the mark of a HEIC picture."""
    return documents.select("doc_id", F.concat(_hex("00000018"), F.lit(b"ftypheic"), _hex("00000000"), F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("content"))


def pdf_files(documents: DataFrame) -> DataFrame:
    """doc_id and content of a PDF whose page holds the text; by id with actions, attachments, an update or encryption."""
    i, size = F.col("doc_id"), F.octet_length("text").cast("string")
    when = lambda c, text: F.when(c, F.lit(text)).otherwise("")
    catalog = F.concat(F.lit("<< /Type /Catalog /Pages 2 0 R /Metadata 6 0 R"), when(i % 3 == 0, " /OpenAction << /S /JavaScript /JS (app.alert\\(1\\)) >>"), when(i % 4 == 0, " /Names << /EmbeddedFiles << /Names [(a) 7 0 R] >> >>"), F.lit(" >>"))
    xmp = F.concat(F.lit("<x:xmpmeta><xmp:CreatorTool>"), F.col("source"), F.lit("</xmp:CreatorTool></x:xmpmeta>"))
    objects = [
        catalog, F.lit("<< /Type /Pages /Kids [3 0 R] /Count 1 >>"), F.lit("<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"),
        F.concat(F.lit("<< /Length "), size, F.lit(" >>\nstream\n"), F.col("text"), F.lit("\nendstream")), F.concat(F.lit("<< /Author ("), F.col("source"), F.lit(") /Title <FEFF0041> >>")),
        F.concat(F.lit("<< /Type /Metadata /Length "), F.length(xmp).cast("string"), F.lit(" >>\nstream\n"), xmp, F.lit("\nendstream")), F.lit("<< /Type /Filespec /F (a.txt) >>"),
    ]
    numbered = [F.concat(F.lit(f"{n + 1} 0 obj\n"), o, F.lit("\nendobj\n")) for n, o in enumerate(objects)]
    end = F.concat(F.lit("trailer\n<< /Size 8 /Root 1 0 R /Info 5 0 R /ID [<00> <00>]"), when(i % 11 == 0, " /Encrypt 9 0 R"), F.lit(" >>\nstartxref\n0\n%%EOF\n"))
    update = F.when(i % 5 == 0, F.concat(F.lit("5 0 obj\n<< /Author ("), F.col("lang"), F.lit(") >>\nendobj\n"), end)).otherwise("")
    return documents.select("doc_id", F.concat(F.lit("%PDF-1.4\n"), *numbered, end, update).cast("binary").alias("content"))


def pdf_tree_files(documents: DataFrame) -> DataFrame:
    """doc_id and content of a PDF with scripts and attachments in name trees, behind references for even ids; every third page has an action.

    A string and a comment hold what looks like references.
    """
    i, size = F.col("doc_id"), F.octet_length("text").cast("string")
    names = F.when(i % 2 == 0, F.lit("5 0 R")).otherwise("<< /JavaScript 6 0 R /EmbeddedFiles 8 0 R >>")
    action = F.when(i % 3 == 0, F.lit(" /AA << /O << /S /JavaScript /JS (page) >> >>")).otherwise("")
    objects = [
        F.concat(F.lit("<< /Type /Catalog /Pages 2 0 R /Lang (see 99 0 R now) % and 98 0 R\n /Names "), names, F.lit(" >>")), F.lit("<< /Type /Pages /Kids [3 0 R] /Count 1 >>"),
        F.concat(F.lit("<< /Type /Page /Parent 2 0 R /Contents 4 0 R"), action, F.lit(" >>")), F.concat(F.lit("<< /Length "), size, F.lit(" >>\nstream\n"), F.col("text"), F.lit("\nendstream")),
        F.lit("<< /JavaScript 6 0 R /EmbeddedFiles 8 0 R >>"), F.lit("<< /Kids [7 0 R] >>"), F.lit("<< /Limits [(first) (second)] /Kids [6 0 R] /Names [(first) 9 0 R (second) << /S /JavaScript /JS (two) >>] >>"),
        F.concat(F.lit("<< /Names [("), F.col("source"), F.lit(") 10 0 R] >>")), F.lit("<< /S /JavaScript /JS (one \\) 97 0 R) >>"), F.lit("<< /Type /Filespec /F (a.txt) >>"),
    ]
    numbered = [F.concat(F.lit(f"{n + 1} 0 obj\n"), o, F.lit("\nendobj\n")) for n, o in enumerate(objects)]
    return documents.select("doc_id", F.concat(F.lit("%PDF-1.4\n"), *numbered, F.lit("trailer\n<< /Size 11 /Root 1 0 R >>\nstartxref\n0\n%%EOF\n")).cast("binary").alias("content"))


def camera_files(documents: DataFrame) -> DataFrame:
    """doc_id and content of a TIFF whose camera directory has a serial number, and whose GPS directory has a place in degrees, minutes and seconds by id."""
    i = F.col("doc_id")
    serial = F.concat(F.col("source").cast("binary"), _hex("00"))
    three = lambda turn: F.concat(*(F.concat(_number(n, 8), _number(F.lit(d), 8)) for n, d in ((i % turn, 1), (i % 60, 1), (i % 6000, 100))))
    block = F.concat(
        _hex("4D4D002A 00000008 0003 0112 0003 00000001 00060000 8769 0004 00000001 00000032 8825 0004 00000001 00000044 00000000"),
        _hex("0001 A431 0002"), _number(F.octet_length(serial), 8), _hex("000000AA 00000000"),
        _hex("0004 0001 0002 00000002 4E000000 0002 0005 00000003 0000007A 0003 0002 00000002 57000000 0004 0005 00000003 00000092 00000000"),
        three(90), three(180), serial,
    )
    return documents.select("doc_id", block.alias("content"))


def extra_packages(documents: DataFrame) -> DataFrame:
    """doc_id and content of packages with custom properties (all), a pivot table of an external source (Excel) and linked accounts of Excel and PowerPoint."""
    i, source = F.col("doc_id"), xml_text(F.col("source"))
    number = i.cast("string")
    custom = _xml('<Properties xmlns="', NAMESPACES["op"], '" xmlns:vt="urn:vt"><property fmtid="x" pid="2" name="Cliente"><vt:lpwstr>', source, "</vt:lpwstr></property></Properties>")
    pivot = _xml('<pivotCacheDefinition xmlns="', NAMESPACES["ss"], '"><cacheSource type="external"><worksheetSource name="Fuente ', number, '"/></cacheSource></pivotCacheDefinition>')
    persons = _xml('<personList xmlns="urn:persons"><person displayName="', source, '" id="{1}" userId="', number, '" providerId="AD"/></personList>')
    kinds: list[tuple[Column, str, Column]] = [
        (i % 3 == 0, "word/document.xml", _xml("<w:document ", _ns("w"), "/>")), (i % 3 == 1, "xl/workbook.xml", _xml('<workbook xmlns="', NAMESPACES["ss"], '"/>')), (i % 3 == 1, "xl/pivotCache/pivotCacheDefinition1.xml", pivot),
        (i % 3 == 1, "xl/persons/person.xml", persons), (i % 3 == 2, "ppt/presentation.xml", _xml("<p:presentation ", _ns("p"), "/>")), (i % 3 == 2, "ppt/persons/person.xml", persons), (i >= 0, "docProps/custom.xml", custom),
    ]
    listed = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("name"), d.alias("data"))) for c, n, d in kinds)))
    return pack_rows(documents.select("doc_id", listed.alias("parts")))


def profiled_pictures(documents: DataFrame) -> DataFrame:
    """doc_id and content of a JPEG with a colour profile and an IPTC block that names its author."""
    segment = lambda mark, body: F.concat(_hex("FF" + mark), _number(F.octet_length(body) + 2, 4), body)
    source = F.col("source").cast("binary")
    profile = F.concat(F.lit(b"ICC_PROFILE\0\1\1"), source)
    iptc = F.concat(F.lit(b"Photoshop 3.0\x008BIM\x04\x04\0\0\0\0"), _hex("1C0250"), _number(F.octet_length(source), 4), source)
    return documents.select("doc_id", F.concat(_hex("FFD8"), segment("E2", profile), segment("ED", iptc), _hex("FFDA0002"), F.coalesce(F.col("text"), F.lit("")).cast("binary"), _hex("FFD9")).alias("content"))


def ole_files(documents: DataFrame) -> DataFrame:
    """doc_id and content with the mark of an old Office file and, for even ids, the name of its summary stream."""
    name = F.when(F.col("doc_id") % 2 == 0, F.lit("\x05SummaryInformation".encode("utf-16-le"))).otherwise(F.lit(b""))
    return documents.select("doc_id", F.concat(_hex("D0CF11E0A1B11AE1"), F.coalesce(F.col("text"), F.lit("")).cast("binary"), name).alias("content"))


def _chained(text: bytes, author: bytes) -> bytes:
    """An old page and its newer version in a compressed object stream, found through a predicted cross-reference stream and an earlier table; a stray catalogue follows."""
    out, at = bytearray(b"%PDF-1.5\n"), {}

    def put(num: int, body: bytes) -> None:
        at[num] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (num, body))

    put(1, b"<< /Type /Catalog /Pages 2 0 R >>")
    put(2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>")
    put(3, b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Old true >>")
    put(4, b"<< /Length %d >>\nstream\n%s\nendstream" % (len(text), text))
    table = len(out)
    rows = b"".join(b"%010d 00000 n \n" % at[n] for n in (1, 2, 3, 4))
    out += b"xref\n0 5\n0000000000 65535 f \n" + rows + b"trailer\n<< /Size 5 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % table
    page, info = b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /New true /Annots [<< /Subtype /Highlight >>] >>", b"<< /Author (%s) >>" % author
    head = b"3 0 7 %d " % (len(page) + 1)
    packed = zlib.compress(head + page + b" " + info)
    put(5, b"<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(head), len(packed), packed))
    entries = [bytes([k]) + a.to_bytes(4, "big") + bytes([g]) for k, a, g in ((2, 5, 0), (1, at[5], 0), (1, len(out), 0), (2, 5, 1))]
    lines = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(e, entries[k - 1] if k else bytes(6), strict=True)) for k, e in enumerate(entries))
    stream, begin = zlib.compress(lines), len(out)
    put(6, b"<< /Type /XRef /Size 8 /Index [3 1 5 3] /W [1 4 1] /Root 1 0 R /Info 7 0 R /Prev %d /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 6 >> /Length %d >>\nstream\n%s\nendstream" % (table, len(stream), stream))
    return bytes(out) + b"1 0 obj\n<< /Type /Catalog /Stray true >>\nendobj\nstartxref\n%d\n%%%%EOF\n" % begin


def chained_pdf_files(documents: DataFrame) -> DataFrame:
    """doc_id and content of PDF files whose newest objects only a chain of cross-reference sections tells."""

    def made(texts: pa.Array, sources: pa.Array) -> pa.Array:
        return pa.array([_chained((t or "").encode(), (s or "").encode()) for t, s in zip(texts.to_pylist(), sources.to_pylist(), strict=True)], pa.binary())

    return documents.select("doc_id", in_slices(made, "binary")("text", "source").alias("content"))


def annotated_pdf_files(documents: DataFrame) -> DataFrame:
    """doc_id and content of PDF files whose page has as many highlights as its id tells, and a link, which is no comment."""
    marks = F.concat(F.lit("<< /Subtype /Link >>"), F.repeat(F.lit(" << /Type /Annot /Subtype /Highlight >>"), (F.col("doc_id") % 4).cast("int")))
    objects = [F.lit("<< /Type /Catalog /Pages 2 0 R >>"), F.lit("<< /Type /Pages /Kids [3 0 R] /Count 1 >>"), F.concat(F.lit("<< /Type /Page /Parent 2 0 R /Annots ["), marks, F.lit("] >>"))]
    numbered = [F.concat(F.lit(f"{n + 1} 0 obj\n"), o, F.lit("\nendobj\n")) for n, o in enumerate(objects)]
    return documents.select("doc_id", F.concat(F.lit("%PDF-1.4\n"), *numbered, F.lit("trailer\n<< /Size 4 /Root 1 0 R >>\nstartxref\n0\n%%EOF\n")).cast("binary").alias("content"))
