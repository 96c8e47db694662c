"""The three products over a table of files or texts: scan, clean, secrets.

``files`` has doc_id and content.  Kinds are told by first bytes; each kind goes its own branch, and a
file that fails is a row with an error, never a failed job.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions import sniff
from lucerna.functions.names import output_name, safe_name
from lucerna.functions.text import strict_text
from lucerna.operators import image_check, images, office, pdf, pdf_check, secrets, verdict
from lucerna.operators.relations import number_names, shared_table
from lucerna.sources import packages
from lucerna.sources.images import WALKS, read_segments
from lucerna.sources.shared import passing, write_shared

FINDINGS = ["doc_id", "kind", "grp", "label", "value", "sev", "keep"]


class Inspected:
    """What inspection needs of a table of files, by kind: each small table is written once, file contents never.

    ``parts``, ``segments`` and ``objects`` hold names, nodes, metadata and dictionaries; cleaning reads
    the contents from ``files`` again.  ``told`` tells whether findings are asked for; without them parts have no nodes.
    """

    def __init__(self, files: DataFrame, *, told: bool = True):
        self.files = files.select(F.col("doc_id").cast("long").alias("doc_id"), "content").withColumn("kind", sniff.file_kind(F.col("content"))).withColumn("format", sniff.sniff_image(F.col("content")))
        self.parts = shared_table(packages.inspect_packages(self.of("office"), told=told), "parts")
        self.nodes = packages.nodes_of(self.parts)
        self.segments = shared_table(images.metadata_only(read_segments(self.of("image"))), "segments")
        objects, trailers = pdf.read(self.of("pdf"))
        self.objects, self.trailers = shared_table(objects, "objects"), shared_table(trailers, "trailers")

    def of(self, kind: str) -> DataFrame:
        return self.files.filter(F.col("kind") == kind)

    def findings(self) -> DataFrame:
        kinds = {
            "office": office.office_findings(self.parts, self.nodes),
            "image": images.image_findings(self.segments).unionByName(images.file_findings(self.of("image"))).unionByName(images.directory_findings(images.exif_blocks(self.segments))),
            "pdf": pdf.pdf_findings(self.of("pdf"), self.objects, self.trailers),
        }
        out = None
        for kind, found in kinds.items():
            one = found.withColumn("kind", F.lit(kind)).select(*FINDINGS)
            out = one if out is None else out.unionByName(one)
        return out

    def status(self) -> DataFrame:
        """doc_id, kind, error: why a file can be neither scored nor cleaned, else null."""
        broken = (
            self.parts.filter("error IS NOT NULL").select("doc_id", "error")
            .unionByName(self.segments.filter("error IS NOT NULL").select("doc_id", "error"))
            .unionByName(office.formats(self.parts).filter("format IS NULL").select("doc_id", F.lit("not an office document").alias("error")))
            .unionByName(pdf.unread(self.objects))
            .unionByName(self.trailers.filter(~pdf.supported(F.col("trailer"))).select("doc_id", F.when(F.col("trailer").isNull(), "no trailer").otherwise("encrypted").alias("error")))
        )
        errors = broken.groupBy("doc_id").agg(F.min("error").alias("error"))
        other = F.when(F.col("kind").isNull() | (F.col("kind") == "ole"), "unsupported format").when((F.col("kind") == "image") & ~F.coalesce(F.col("format").isin(*WALKS), F.lit(False)), F.concat(F.lit("unsupported format "), F.col("format")))
        return self.files.select("doc_id", "kind", other.alias("other")).join(errors, "doc_id", "left").select("doc_id", "kind", F.coalesce("other", "error").alias("error"))


def scan(files: DataFrame) -> DataFrame:
    """doc_id, riesgo, puntuacion, hallazgos, recomendacion of every file; an unreadable one is ``desconocido``."""
    seen = Inspected(files)
    signals = verdict.signals_of_findings(seen.findings())
    status = seen.status()
    out = verdict.verdicts(status, signals, supported=F.col("error").isNull())
    listed = verdict.with_signals(verdict.with_recommendation(out), signals)
    empty = F.array().cast("array<struct<nivel:string,titulo:string,detalle:string>>")
    return listed.select("doc_id", "riesgo", "puntuacion", F.when(F.col("riesgo") == "desconocido", empty).otherwise(F.col("hallazgos")).alias("hallazgos"), "recomendacion")


def _image_stats(segments: DataFrame) -> DataFrame:
    """doc_id and stats: what cleaning takes out of images."""
    s = images.role(segments.filter(F.col("kind").isNotNull()))
    named = {"EXIF": "exif", "XMP": "xmp", "IPTC": "iptc", "COM": "comments", "DUCKY": "vendor", "TEXT": "pngText", "ICC": "icc"}
    per = s.filter(F.col("role").isin(*named)).groupBy("doc_id").agg(*(F.count_if(F.col("role") == k).cast("int").alias(v) for k, v in named.items()))
    blocks = images.exif_blocks(segments).select("doc_id", F.size("x.fields").alias("exifFields"), F.size("x.gps").alias("gps"), F.col("x.thumbnail").cast("int").alias("thumbnails"), F.col("x.orientation").alias("orientation"))
    every = per.join(blocks, "doc_id", "left")
    return every.select("doc_id", F.map_filter(F.create_map(*(x for c in every.columns if c != "doc_id" for x in (F.lit(c), F.coalesce(c, F.lit(0))))), lambda k, v: v > 0).alias("stats"))


def _refusals(violations: DataFrame) -> DataFrame:
    return violations.groupBy("doc_id").agg(F.min(F.concat(F.lit("check failed: "), F.col("problem"))).alias("refused"))


def _cleaned(seen: Inspected, status: DataFrame, *, icc: str, orientation: str, attachments: bool, deep: bool, options: dict[str, object]) -> DataFrame:
    """doc_id, cleaned, stats and refused of every file that can be cleaned; a file that fails its own check is refused.

    Of each kind the cleaned files and what is told of them stay; what they were made from goes before the next kind.
    """
    spark = status.sparkSession
    # Of office files and pictures few are refused here, and contents need no shuffle to leave a few out.
    bad = write_shared(status.filter("error IS NOT NULL AND kind IN ('office', 'image')").select("doc_id"), "refused")[0]
    with passing(spark) as keep:
        parts = shared_table(packages.read_packages(seen.of("office").join(bad, "doc_id", "left_anti")), "office-parts")
        kept = shared_table(office.clean_parts(parts, **options), "clean-parts")
        counted = kept.select("doc_id", F.explode("stats")).groupBy("doc_id", "key").agg(F.sum("value").cast("int").alias("n"))
        stats = counted.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "n")))).alias("stats"))
        unread = kept.filter("error IS NOT NULL").select("doc_id", F.col("name").alias("part"), F.col("error").alias("problem"))
        wrong = unread.unionByName(office.violations(parts, kept.drop("stats", "error"), **options))
        wrong = wrong.groupBy("doc_id").agg(F.min(F.concat(F.lit("check failed: "), F.col("part"), F.lit(": "), F.col("problem"))).alias("refused"))
        told = keep(stats.join(wrong, "doc_id", "full_outer"), "office-told")
        made = keep(packages.write_packages(kept), "clean-office").join(told, "doc_id", "left").select("doc_id", "content", "stats", "refused")
    images_in = seen.of("image").join(bad, "doc_id", "left_anti")
    with passing(spark) as keep:
        segments = shared_table(read_segments(images_in), "image-segments")
        pictures = keep(images.assemble(images.clean_segments(segments, icc=icc, orientation=orientation)), "clean-images")
        wrong = _refusals(image_check.picture_violations(images_in, pictures, icc=icc, orientation=orientation))
        told = keep(_image_stats(segments).join(wrong, "doc_id", "full_outer"), "image-told")
        pictures = pictures.join(told, "doc_id", "left").select("doc_id", "content", "stats", "refused")
    with passing(spark) as keep:
        papers = keep(pdf.clean_pdf(seen.of("pdf").select("doc_id", "content"), attachments=attachments, deep=deep, known=(seen.objects, seen.trailers)), "clean-pdf")
        told = keep(_refusals(pdf_check.pdf_violations(pdf_check.stream_digests(seen.objects), papers.filter("content IS NOT NULL"), attachments=attachments, deep=deep)), "pdf-told")
        papers = papers.join(told, "doc_id", "left").select("doc_id", "content", "stats", F.coalesce("error", "refused").alias("refused"))
    every = made.unionByName(pictures).unionByName(papers)
    return every.select("doc_id", F.when(F.col("refused").isNull(), F.col("content")).alias("cleaned"), "stats", "refused")


def clean(files: DataFrame, *, icc: str = "keep", orientation: str = "keep", attachments: bool = False, deep: bool = False, seen: Inspected | None = None, **options: object) -> DataFrame:
    """doc_id, kind, content, bytes_in, bytes_out, sha256_in, sha256_out, stats, error of every file.

    Every cleaned file has passed the checks of its kind, made by readers of their own; one that has not is an
    ``error`` without content.  ``deep`` takes actions and metadata from all objects of a PDF file, not from its
    catalogue alone.  ``seen`` is what inspection has already read of the same files.
    """
    seen = seen or Inspected(files, told=False)
    status = write_shared(seen.status(), "status")[0]
    cleaned = _cleaned(seen, status, icc=icc, orientation=orientation, attachments=attachments, deep=deep, options=options)
    joined = seen.files.select("doc_id", F.octet_length("content").cast("long").alias("bytes_in"), F.sha2("content", 256).alias("sha256_in")).join(status, "doc_id").join(cleaned, "doc_id", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    return joined.select("doc_id", "kind", F.col("cleaned").alias("content"), "bytes_in", F.octet_length("cleaned").cast("long").alias("bytes_out"), "sha256_in", F.sha2("cleaned", 256).alias("sha256_out"), F.when(F.col("cleaned").isNotNull(), F.coalesce("stats", none)).alias("stats"), F.coalesce("error", "refused").alias("error"))


# What a report says was removed, by kind and counter.
REMOVED = {
    "office": [
        ("ins", "{} inserción(es) resueltas"), ("del", "{} borrado(s) resueltos"), ("format", "{} cambio(s) de formato resueltos"), ("accounts", "{} nombres o cuentas de la lista de personas"),
        ("authors", "{} campos de autor anonimizados"), ("dates", "{} fechas borradas"), ("comments", "{} autor(es) de comentarios sin nombre ni fecha"),
        ("rsid", "{} identificadores de sesión de edición (rsid)"), ("paraId", "{} identificadores de párrafo o texto"), ("docId", "{} identificadores persistentes del documento"), ("settings", "{} ajuste(s) de plantilla o de control de cambios"),
    ],
    "image": [
        ("exifFields", "EXIF: {} campos eliminados (cámara, objetivos, fechas, software, autor)"), ("gps", "Coordenadas GPS eliminadas ({} campos)"), ("thumbnails", "Miniatura incrustada eliminada"), ("xmp", "XMP eliminado (autor, derechos, lugar)"),
        ("iptc", "Bloque IPTC de Photoshop eliminado (autor, crédito, pie de foto)"), ("comments", "Comentario guardado en el archivo, eliminado"), ("vendor", "Datos de cámara antiguos (APP12) eliminados"),
        ("pngText", "{} chunks de texto del PNG eliminados (autor, descripción, fecha)"), ("orientation", "Orientación {} conservada para que la foto no salga girada"),
    ],
    "pdf": [("history", "{} actualización(es) incremental(es) descartadas"), ("dropped", "{} objeto(s) descartados: metadatos, estructura y restos de versiones anteriores")],
}
ALWAYS = {
    "office": ["Título, autor, última persona que guardó, empresa, plantilla, revisión y fechas del archivo", "Fechas internas del paquete ZIP normalizadas"],
    "image": ["La imagen NO se recodifica: los píxeles son idénticos al original"],
    "pdf": ["/Info fuera: autor, título, asunto, palabras clave, programas y fechas", "Los flujos de contenido se copian sin recomprimir: la imagen no cambia"],
}


def removed(kind: Column, stats: Column) -> Column:
    """Ordered notes of what cleaning took out, from its counters."""
    out = F.array().cast("array<string>")
    for k, told in REMOVED.items():
        said = [F.when(F.coalesce(stats[c], F.lit(0)) > 0, F.replace(F.lit(text), F.lit("{}"), stats[c].cast("string"))) for c, text in told]
        out = F.when(kind == k, F.array_compact(F.array(*said, *map(F.lit, ALWAYS[k])))).otherwise(out)
    return out


def clean_report(files: DataFrame, *, icc: str = "keep", orientation: str = "keep", attachments: bool = False, deep: bool = False, **options: object) -> DataFrame:
    """The report of a cleaning, one row for each file of (doc_id, name, content).

    doc_id, name, output_name, kind, format, bytes_in, bytes_out, sha256_in, sha256_out, options (JSON), removed,
    stats, findings (of the file as it came) and error.  A refused file has an error, no output and no stats.
    """
    chosen = office.checked(options) | {"icc": icc, "orientation": orientation, "attachments": attachments, "deep": deep}
    seen = Inspected(files)
    found = seen.findings()
    of = ["grp", "label", "value", "sev", "keep"]
    listed = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*of))).alias("findings"))
    formats = office.formats(seen.parts).select("doc_id", F.col("format").alias("package_format"))
    told = files.select(F.col("doc_id").cast("long").alias("doc_id"), safe_name(F.col("name")).alias("name"), sniff.sniff_image(F.col("content")).alias("image_format"))
    done = clean(files, icc=icc, orientation=orientation, attachments=attachments, deep=deep, seen=seen, **options).drop("content")
    shown = F.when(F.col("kind") == "office", F.col("package_format")).when(F.col("kind") == "image", F.upper("image_format")).when(F.col("kind") == "pdf", "PDF")
    r = told.join(done, "doc_id").join(formats, "doc_id", "left").join(listed, "doc_id", "left")
    ok = F.col("error").isNull()
    empty = F.array().cast("array<struct<grp:string,label:string,value:string,sev:string,keep:boolean>>")
    return r.select(
        "doc_id", "name", F.when(ok, output_name(F.col("name"))).alias("output_name"), "kind", shown.alias("format"), "bytes_in", "bytes_out", "sha256_in", "sha256_out",
        F.lit(json.dumps(chosen, sort_keys=True)).alias("options"), F.when(ok, removed(F.col("kind"), F.col("stats"))).alias("removed"), "stats", F.coalesce("findings", empty).alias("findings"), "error",
    )


def scan_text(texts: DataFrame) -> DataFrame:
    """The secrets product over (doc_id, content): invalid UTF-8 is refused as ``desconocido``, never replaced."""
    read = texts.select("doc_id", strict_text(F.col("content")).alias("text"))
    signals = secrets.secret_signals(secrets.secret_hits(read.filter("text IS NOT NULL")))
    out = verdict.verdicts(read, signals, supported=F.col("text").isNotNull())
    return verdict.with_signals(verdict.with_recommendation(out), signals).select("doc_id", "riesgo", "puntuacion", "hallazgos", "recomendacion")


def bundle(files: DataFrame) -> DataFrame:
    """One package for each request of (request, ord, name, content): names are numbered where they repeat."""
    named = number_names(files.withColumn("key", F.concat_ws("/", F.col("request").cast("string"), "name")), "key", "ord")
    inside = F.expr("substring(unique_name, length(cast(request AS string)) + 2)")
    return packages.write_packages(named.select(F.col("request").alias("doc_id"), "ord", inside.alias("name"), F.col("content").alias("data"))).withColumnRenamed("doc_id", "request")
