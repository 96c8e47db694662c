"""One sentence for each file: what was detected in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions import sniff
from lucerna.operators import images, office, pdf
from lucerna.plans.products import Inspected
from lucerna.sources.images import WALKS

# Sentences, and what they list, by kind and in order.
ONLY_REPORT = "Detectamos una imagen {}, pero este formato todavía no se puede reescribir sin recodificar, así que solo mostramos el informe."
ENCRYPTED = "Detectamos un PDF cifrado: se puede ver el informe, pero no limpiarlo sin la contraseña."
NOUN = {"image": "una imagen", "pdf": "un", "office": "un archivo de"}
BITS = {
    "pdf": [("incremental", "{} versión(es) anteriores dentro del archivo"), ("packets", "XMP incrustado"), ("ids", "identificador del archivo")],
    "image": [("gps", "coordenadas GPS"), ("exif", "datos EXIF"), ("xmp", "XMP"), ("icc", "perfil de color (que se conserva)"), ("orientation", "orientación {} (que se conserva)")],
    "office": [
        ("changes", "{} marcas de control de cambios"), ("authors", "{} autores distintos"), ("technical", "{} identificadores técnicos"), ("people", "cuentas vinculadas"), ("custom", "propiedades personalizadas"),
        ("connections", "conexiones a bases de datos"), ("thumbnails", "miniatura incrustada"), ("macros", "macros"),
    ],
}


def _counts(seen: Inspected) -> list[DataFrame]:
    """doc_id and the numbers that sentences speak of: one small aggregate for each table of the inspection."""
    rule, name, role = F.col("rule"), F.col("name"), F.col("role")
    marked = office.marks(seen.nodes).groupBy("doc_id").agg(
        F.sum(F.when(rule == "revision", F.col("w"))).alias("changes"), F.countDistinct(F.when(rule == "authors", F.col("key"))).alias("authors"),
        F.sum(F.when(rule.isin("rsid", "para", "docid"), F.col("w"))).alias("technical"), F.count_if(rule == "person").alias("people"),
    )
    patterns = {"custom": r"^docProps/custom\.xml$", "connections": r"^xl/connections\.xml$", "thumbnails": office.THUMBNAIL, "macros": office.MACROS}
    parts = seen.parts.groupBy("doc_id").agg(*(F.count_if(name.rlike(p)).alias(k) for k, p in patterns.items()))
    roles = images.role(seen.segments).groupBy("doc_id").agg(F.count_if(role == "XMP").alias("xmp"), F.count_if(role == "ICC").alias("icc"))
    blocks = images.exif_blocks(seen.segments).select("doc_id", F.lit(1).alias("exif"), F.size("x.gps").alias("gps"), F.col("x.orientation").alias("orientation"))
    versions = seen.of("pdf").select("doc_id", (F.regexp_count(pdf.latin(F.col("content")), F.lit("%%EOF")) - 1).alias("incremental"))
    packets = seen.objects.groupBy("doc_id").agg(F.count_if(F.col("dict").rlike(r"/Type\s*/Metadata(?![A-Za-z])")).alias("packets"))
    ids = seen.trailers.select("doc_id", F.col("trailer").rlike(r"/ID\s*\[").cast("int").alias("ids"))
    return [marked, parts, roles, blocks, versions, packets, ids]


def _sentence(kind: Column, label: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, told in BITS.items():
        listed = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.replace(F.lit(text), F.lit("{}"), F.col(c).cast("string"))) for c, text in told)))
        some = F.concat(F.lit(f"Detectamos {NOUN[k]} "), label, F.lit(" con "), F.array_join(listed, ", "), F.lit("."))
        out = F.when(kind == k, F.when(F.size(listed) > 0, some).otherwise(F.concat(label, F.lit(" sin metadatos personales detectados.")))).otherwise(out)
    return out


def summaries(files: DataFrame) -> DataFrame:
    """doc_id, kind and summary of every file of (doc_id, content); a file of no known kind, or a broken one, has none."""
    seen = Inspected(files)
    rows = seen.status().join(seen.files.select("doc_id", "format"), "doc_id").join(office.formats(seen.parts).select("doc_id", F.col("format").alias("package")), "doc_id", "left")
    for counted in _counts(seen):
        rows = rows.join(counted, "doc_id", "left")
    kind, fmt = F.col("kind"), F.upper("format")
    label = F.when(kind == "office", F.col("package")).when(kind == "image", fmt).otherwise("PDF")
    told = (
        F.when(F.col("error").isNull(), _sentence(kind, label))
        .when((kind == "image") & ~F.col("format").isin(*WALKS), F.replace(F.lit(ONLY_REPORT), F.lit("{}"), fmt))
        .when((kind == "pdf") & (F.col("error") == "encrypted"), ENCRYPTED)
    )
    return rows.select("doc_id", "kind", told.alias("summary"))
