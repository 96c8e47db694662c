"""A second opinion on metadata: marks looked up in raw bytes, by the name's extension, apart from the parsers of the other operators.

``files`` has doc_id, name and content.  A mark is a row (doc_id, ord, present, text); a file whose extension has no
scanner, or that cannot be read, is one row without ``present``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.operators.images import exif_blocks
from lucerna.sources.images import exif, read_segments
from lucerna.sources.packages import read_packages

# Extensions of each scanner, names of properties and fields, texts of marks.
SCANNED = {"office": "xlsx xlsm docx docm pptx pptm", "image": "jpg jpeg png tif tiff webp", "pdf": "pdf", "ole": "doc xls"}
CORE = ["dc:title", "dc:subject", "dc:creator", "cp:keywords", "dc:description", "cp:lastModifiedBy", "cp:revision", "dcterms:created", "dcterms:modified", "cp:category"]
TEXTS = ["docProps/core.xml", "docProps/app.xml", "xl/connections.xml", "xl/workbook.xml", "ppt/commentAuthors.xml"]
APP = ["Template", "TotalTime", "Company", "Manager"]
INFO = ["Author", "Creator", "Producer", "Title", "Subject", "Keywords", "CreationDate", "ModDate"]
FIELDS = [
    (0x010F, "fabricante (Make)"), (0x0110, "modelo (Model)"), (0x0131, "software (Software)"), (0x0132, "fecha (DateTime)"), (0x9003, "fecha de captura (DateTimeOriginal)"), (0x013B, "autor (Artist)"), (0x8298, "copyright (Copyright)"),
    (0xA435, "número de serie del objetivo (LensSerialNumber)"), (0xA431, "serie del cuerpo (BodySerialNumber)"), (0x013C, "equipo (HostComputer)"), (0xA420, "identificador único de imagen (ImageUniqueID)"),
]
GPS = {1: "latitud", 2: "longitud", 3: "altitud", 5: "altitud", 29: "fecha GPS"}
PDF = [("<x:xmpmeta", "XMP incrustado"), ("/AcroForm", "formulario (puede llevar valores previos)"), ("%%EOF", "actualizaciones incrementales (texto anterior recuperable)"), ("/Annots", "anotaciones/comentarios"), ("/EmbeddedFiles", "archivos adjuntos incrustados")]
OLE = [("\x05SummaryInformation", "flujo SummaryInformation (autor, plantilla, fechas)"), ("\x05DocumentSummaryInformation", "flujo DocumentSummaryInformation (empresa, propiedades)")]
PRESENT, ABSENT = "  [x] ", "  [ ] "


def _mark(present: Column | None, text: Column | str) -> Column:
    told = F.lit(None).cast("boolean") if present is None else F.coalesce(present, F.lit(False))
    return F.struct(told.alias("present"), (F.lit(text) if isinstance(text, str) else text).alias("text"))


def _rows(marked: DataFrame) -> DataFrame:
    """One row for each mark of the array ``m``."""
    return marked.select("doc_id", F.posexplode("m").alias("ord", "x")).select("doc_id", "ord", "x.present", "x.text")


def scanner(name: Column) -> Column:
    extension = F.lower(F.regexp_extract(name, r"([^.]*)$", 1))
    out = F.lit(None).cast("string")
    for kind, known in SCANNED.items():
        out = F.when(extension.isin(*known.split()), F.lit(kind)).otherwise(out)
    return out


def _office(files: DataFrame) -> DataFrame:
    """Packages by the names of their parts and patterns over the text of five of them."""
    name = F.col("name")
    # Bodies and pictures are not looked into, so they go before parts are sorted and sent.
    shown = F.when(name.isin(*TEXTS), F.make_valid_utf8(F.col("data").cast("string"))).alias("shown")
    parts = read_packages(files).select("doc_id", "error", "name", shown)
    text = lambda of: F.max(F.when(name == of, F.col("shown")))
    listed = lambda pattern: F.array_sort(F.collect_set(F.when(name.rlike(pattern), name)))
    count = lambda pattern: F.count_if(name.rlike(pattern))
    per = parts.groupBy("doc_id").agg(
        F.max("error").alias("error"), F.count("name").alias("n"), count("^xl/").alias("xl"), count("^ppt/").alias("ppt"), text("docProps/core.xml").alias("core"), text("docProps/app.xml").alias("app"), count(r"^docProps/custom\.xml$").alias("custom"),
        listed(r"(?i)persons?/person|person\.xml").alias("persons"), count(r"^xl/externalLinks/.*\.rels$").alias("links"), text("xl/connections.xml").alias("connections"), text("xl/workbook.xml").alias("book"), count("^xl/printerSettings/").alias("printers"),
        text("ppt/commentAuthors.xml").alias("authors"), listed("(?i)revision").alias("revisions"), listed("(?i)comment").alias("comments"),
    )
    c = F.col
    kind = F.when(c("xl") > 0, "xlsx").when(c("ppt") > 0, "pptx").otherwise("docx")

    def element(text: Column, tag: str, shown: str) -> Column:
        value = F.regexp_extract(text, f"<{tag}(?: [^>]*)?>([^<]*)</{tag}>", 1)
        return F.when(text.isNotNull(), _mark(F.trim(value) != "", F.concat(F.lit(f"{shown} {tag} = "), value)))

    some = lambda array, text, most: _mark(F.size(array) > 0, F.concat(F.lit(text), F.array_join(F.slice(array, 1, most), ", ")))
    counted = lambda n, text: _mark(c(n) > 0, F.concat(F.lit(f"{text} ("), c(n).cast("string"), F.lit(")")))
    excel, power = lambda m: F.when(kind == "xlsx", m), lambda m: F.when(kind == "pptx", m)
    defined = F.regexp_extract_all(F.coalesce("book", F.lit("")), F.lit('<definedName name="([^"]+)"'))
    secrets = F.regexp_extract_all(F.coalesce("connections", F.lit("")), F.lit('(?:connectionString|connection|DBPassword|command)="([^"]{0,120})"'))
    marks = F.array(
        _mark(None, F.concat(F.lit("contenedor ZIP/"), kind, F.lit(" con "), c("n").cast("string"), F.lit(" partes"))),
        *(element(c("core"), t, "core.xml") for t in CORE), *(element(c("app"), t, "app.xml") for t in APP),
        _mark(c("custom") > 0, "docProps/custom.xml (propiedades personalizadas)"), some(c("persons"), "persons/person.xml (lista de personas con cuenta): ", 4),
        excel(counted("links", "enlaces externos a otros archivos")), excel(_mark(c("connections").isNotNull(), F.concat(F.lit("xl/connections.xml (cadenas de conexión a bases de datos): "), F.array_join(secrets, ", ")))),
        excel(F.when(c("book").isNotNull(), some(defined, "nombres definidos: ", 5))), excel(counted("printers", "configuración de impresora")),
        power(_mark(c("authors").isNotNull(), F.concat(F.lit("ppt/commentAuthors.xml (autores de comentarios): "), F.array_join(F.regexp_extract_all(F.coalesce("authors", F.lit("")), F.lit(' name="([^"]+)"')), ", ")))),
        some(c("revisions"), "registros de revisión: ", 3), some(c("comments"), "partes de comentarios: ", 4),
    )
    broken = F.array(_mark(None, F.concat(F.lit("error: "), c("error"))))
    return _rows(per.select("doc_id", F.when(c("error").isNotNull(), broken).otherwise(F.array_compact(marks)).alias("m")))


def _image(files: DataFrame) -> DataFrame:
    """Pictures by marks anywhere in the file, and by the fields of their first EXIF block."""
    head = lambda n: F.hex(F.substring("content", 1, n))
    fmt = F.when(head(2) == "FFD8", "jpeg").when(head(8) == "89504E470D0A1A0A", "png").when(F.substring("content", 9, 4) == F.lit(b"WEBP"), "webp").when(head(4).isin("49492A00", "4D4D002A"), "tiff")
    known = files.withColumn("format", fmt)
    blocks = exif_blocks(read_segments(known)).unionByName(known.filter("format = 'tiff'").select("doc_id", exif(F.col("content")).alias("x")))
    holds = lambda *marks: reduce(Column.__or__, (F.contains("content", F.lit(m)) for m in marks))
    of = lambda f, m: F.when(F.col("format") == f, m)
    told = lambda tag: F.array_join(F.transform(F.filter("x.fields", lambda f: f["tag"] == tag), lambda f: F.left(F.coalesce(f["value"], F.lit("")), F.lit(60))), "")
    has = lambda tag: F.exists("x.fields", lambda f: f["tag"] == tag)
    fields = [F.when(has(tag), _mark(F.lit(True), F.concat(F.lit(f"{text} = "), told(tag)))) for tag, text in FIELDS]
    gps = F.array_join(F.array_distinct(F.transform("x.gps", lambda k: reduce(lambda o, kv: F.when(k == kv[0], F.lit(kv[1])).otherwise(o), GPS.items(), k.cast("string")))), ", ")
    found = F.coalesce(F.size("x.gps") > 0, F.lit(False))
    # What the bytes tell is told before the join, so no picture is sent.
    seen = F.array(
        _mark(None, F.concat(F.octet_length("content").cast("string"), F.lit(" bytes"))),
        of("jpeg", _mark(holds(b"ns.adobe.com/xap"), "XMP (Adobe)")), of("jpeg", _mark(holds(b"Photoshop 3.0", b"8BIM"), "IPTC / Photoshop (autor, copyright)")), of("jpeg", _mark(holds(b"\xff\xfe"), "segmento COM (comentario JPEG)")),
        of("png", _mark(holds(b"tEXt", b"iTXt"), "chunks de texto PNG")), of("png", _mark(holds(b"eXIf"), "chunk eXIf (EXIF dentro de PNG)")),
        F.when(F.col("format").isNull(), _mark(F.lit(False), "no se pudo abrir")),
    )
    told_of = F.array(
        *fields,
        _mark(found, F.when(found, F.concat(F.lit("GPS presente: "), gps, F.lit(" (coordenadas omitidas)"))).otherwise("GPS")), _mark(F.col("x.thumbnail"), "miniatura incrustada"),
    )
    both = known.select("doc_id", F.array_compact(seen).alias("seen")).join(blocks, "doc_id", "left")
    return _rows(both.select("doc_id", F.concat("seen", F.array_compact(told_of)).alias("m")))


def _pdf(files: DataFrame) -> DataFrame:
    t = F.decode("content", "ISO-8859-1")
    pages = F.regexp_count(t, F.lit(r"/Type\s*/Page(?![A-Za-z])"))
    value = lambda key: F.regexp_extract(t, rf"/{key}\s*[(<]([^)>]{{0,120}})", 1)
    marks = [_mark(None, F.concat(pages.cast("string"), F.lit(" páginas"))), *(_mark(t.rlike(rf"/{k}\s*[(<](?!<)"), F.concat(F.lit(f"/{k} = "), value(k))) for k in INFO), *(_mark(F.contains("content", F.lit(m.encode())), text) for m, text in PDF)]
    return _rows(files.select("doc_id", F.array(*marks).alias("m")))


def _ole(files: DataFrame) -> DataFrame:
    marks = [_mark(F.hex(F.substring("content", 1, 8)) == "D0CF11E0A1B11AE1", "contenedor OLE2"), *(_mark(F.contains("content", F.lit(s.encode("utf-16-le"))), text) for s, text in OLE)]
    return _rows(files.select("doc_id", F.array(*marks).alias("m")))


def raw_marks(files: DataFrame) -> DataFrame:
    """doc_id, ord, present, text: every mark of every file, found or not, in the order of its scanner."""
    known = files.select(F.col("doc_id").cast("long").alias("doc_id"), "name", F.coalesce("content", F.lit(b"")).alias("content")).withColumn("scanner", scanner(F.col("name")))
    of = lambda kind: known.filter(F.col("scanner") == kind).select("doc_id", "content")
    none = known.filter("scanner IS NULL").select("doc_id", F.array(_mark(None, F.concat(F.lit("sin analizador para ."), F.coalesce(F.lower(F.regexp_extract("name", r"([^.]*)$", 1)), F.lit(""))))).alias("m"))
    return reduce(DataFrame.unionByName, [_office(of("office")), _image(of("image")), _pdf(of("pdf")), _ole(of("ole")), _rows(none)])


def mark_line(present: Column, text: Column) -> Column:
    """A mark as it is printed."""
    return F.concat(F.when(present, PRESENT).when(~present, ABSENT).otherwise("  "), text)
