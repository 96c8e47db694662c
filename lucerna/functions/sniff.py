"""Kinds of files by their first bytes, as column expressions; never by their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A PDF mark may start anywhere below this offset.
PDF_MARK, PDF_WITHIN = "%PDF-", 1024
#: Fixed value: mark of a legacy compound file, and stream names that tell its kind (UTF-16LE).
OLE_MARK = "D0CF11E0A1B11AE1"
OLE_STREAMS = {"doc": "WordDocument", "xls": "Workbook", "ppt": "PowerPoint Document"}
ZIP_MARK = "504B0304"


def _bytes(content: Column, start: int, length: int) -> Column:
    return F.hex(F.substring(content, start, length))


def _latin(content: Column) -> Column:
    """Bytes as text of one character each: substring search then never stumbles over invalid UTF-8."""
    return F.decode(content, "ISO-8859-1")


def sniff_pdf(content: Column) -> Column:
    """Whether the mark starts in the first bytes."""
    at = F.instr(_latin(F.substring(content, 1, PDF_WITHIN + 4)), PDF_MARK)
    return F.coalesce(at.between(1, PDF_WITHIN), F.lit(False))


def sniff_image(content: Column) -> Column:
    """jpeg, png, webp, tiff, heic, avif or null.  A TIFF needs its whole mark, not only the byte order."""
    brand = F.lower(F.decode(F.substring(content, 9, 4), "ISO-8859-1"))
    media = _bytes(content, 5, 4) == "66747970"
    return (
        F.when(_bytes(content, 1, 2) == "FFD8", "jpeg")
        .when(_bytes(content, 1, 8) == "89504E470D0A1A0A", "png")
        .when((_bytes(content, 1, 4) == "52494646") & (_bytes(content, 9, 4) == "57454250"), "webp")
        .when(_bytes(content, 1, 4).isin("49492A00", "4D4D002A"), "tiff")
        .when(media & brand.isin("avif", "avis"), "avif")
        .when(media & brand.isin("heic", "heix", "hevc", "hevx", "mif1", "msf1"), "heic")
    )


def sniff_ole(content: Column) -> Column:
    """doc, xls, ppt or ole for a legacy compound file, else null."""
    out = F.lit("ole")
    for kind, name in OLE_STREAMS.items():
        out = F.when(F.contains(_latin(content), F.lit(name.encode("utf-16-le").decode("latin-1"))), F.lit(kind)).otherwise(out)
    return F.when(_bytes(content, 1, 8) == OLE_MARK, out)


def file_kind(content: Column) -> Column:
    """pdf, image, office (any ZIP package), ole or null, in this order."""
    return F.when(sniff_pdf(content), "pdf").when(sniff_image(content).isNotNull(), "image").when(_bytes(content, 1, 4) == ZIP_MARK, "office").when(sniff_ole(content).isNotNull(), "ole")


def package_format(names: Column) -> Column:
    """word, excel or powerpoint by the first part name, in package order, below a known folder."""
    known = F.filter(names, lambda n: n.rlike(r"^(word|xl|ppt)/"))
    folder = F.regexp_extract(F.get(known, F.lit(0)), r"^(word|xl|ppt)/", 1)
    return F.when(folder == "word", "word").when(folder == "xl", "excel").when(folder == "ppt", "powerpoint")


def kind_label(kind: Column, fmt: Column) -> Column:
    labels = F.when(fmt == "word", "Word").when(fmt == "excel", "Excel").when(fmt == "powerpoint", "PowerPoint")
    return F.when(kind == "pdf", "PDF").when(kind == "image", F.upper(fmt)).when(kind == "office", labels)


#: Extensions by kind, for dispatch by name where no bytes are at hand.
EXTENSIONS = {"office": "docx docm dotx dotm xlsx xlsm xltx xltm pptx pptm potx potm", "pdf": "pdf", "image": "jpg jpeg png webp tif tiff", "ole": "doc xls ppt"}


def kind_by_name(name: Column) -> Column:
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, known in EXTENSIONS.items():
        out = F.when(extension.isin(*known.split()), F.lit(kind)).otherwise(out)
    return out
