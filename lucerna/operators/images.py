"""Images: findings from segments, cleaning by leaving segments out, and a check of what stays.

All work is on the ``segments`` table of :mod:`lucerna.sources.images`; the compressed picture is
copied, never decoded.  Of a JPEG's application segments only those that a picture needs stay (JFIF, the
colour profile if asked for, Adobe's colour transform); what follows the end mark of a picture is reported
and goes as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions.binary import joined
from lucerna.functions.text import printable
from lucerna.operators.office import findings_of, rule
from lucerna.sources.images import WALKS, exif, tiff_block

# Labels and severities of EXIF fields, labels of GPS fields, headers of segments.
EXIF_FIELDS = [
    (0x010F, "Fabricante de la cámara", "personal"), (0x0110, "Modelo de cámara", "personal"), (0x0131, "Software", "media"), (0x0132, "Fecha de modificación", "media"),
    (0x013B, "Autor (Artist)", "personal"), (0x8298, "Copyright", "personal"), (0x9003, "Fecha de captura", "media"), (0x9004, "Fecha original digitalizada", "media"),
    (0x9286, "Comentario de usuario", "media"), (0xA002, "Ancho", "baja"), (0xA003, "Alto", "baja"), (0xA420, "Identificador único de imagen", "personal"),
    (0xA430, "Propietario de la cámara", "personal"), (0xA431, "Número de serie del cuerpo", "personal"), (0xA433, "Fabricante del objetivo", "personal"), (0xA434, "Modelo del objetivo", "personal"),
    (0xA435, "Número de serie del objetivo", "personal"), (0xC62F, "Persona fotografiada", "personal"),
]
GPS_FIELDS = {1: "latitud", 2: "longitud", 3: "referencia de altitud", 4: "altitud", 5: "referencia de altitud", 6: "altitud", 7: "hora GPS", 29: "fecha GPS", 18: "datum", 27: "dirección de la imagen"}
HEADERS = {"EXIF": b"Exif\0\0", "XMP": b"http://ns.adobe.com/xap/1.0/\0", "ICC": b"ICC_PROFILE\0", "IPTC": b"Photoshop 3.0\0", "DUCKY": b"Ducky"}
MARKERS = {"EXIF": "E1", "XMP": "E1", "ICC": "E2", "IPTC": "ED", "DUCKY": "EC"}
#: Further packets of XMP, and application segments that belong to the picture.
MORE_XMP, BELONGS = b"http://ns.adobe.com/xmp/extension/\0", (("E0", b"JFIF\0"), ("E0", b"JFXX\0"), ("EE", b"Adobe"))
LABELS = {"jpeg": "JPEG", "png": "PNG", "webp": "WebP", "tiff": "TIFF", "heic": "HEIC", "avif": "AVIF"}
PNG_TEXT = ("tEXt", "zTXt", "iTXt", "tIME")
# What XMP packets tell.
XMP = [
    (r"<dc:creator>[\s\S]{0,300}?<rdf:li[^>]*>([^<]{1,80})<", "Autor declarado en XMP", "personal"),
    (r"<xmp:CreatorTool>([^<]{1,80})<", "Herramienta que creó el archivo", "media"),
    (r"<photoshop:(?:City|Country)>([^<]{1,60})<", "Lugar declarado en XMP", "personal"),
    (r"<dc:rights>[\s\S]{0,200}?<rdf:li[^>]*>([^<]{1,80})<", "Derechos declarados", "media"),
]
#: Data sets of an IPTC block by the standard's numbers: byline, credit, copyright notice, caption.
IPTC = ((0x50, "Autor (byline)", "personal"), (0x6E, "Crédito", "personal"), (0x74, "Copyright", "media"), (0x78, "Pie de foto", "media"))


def role(segments: DataFrame) -> DataFrame:
    """Add ``role``: EXIF, XMP, ICC, IPTC, DUCKY, COM, TEXT, ANIMATION, OTHER, TAIL or null for what belongs to the picture.

    OTHER is any other application segment of a JPEG, TAIL what follows a picture's end mark.
    """
    starts = lambda h: F.hex(F.substring("payload", 1, len(h))) == h.hex().upper()
    belongs = reduce(lambda o, kh: o | ((F.col("kind") == kh[0]) & starts(kh[1])), BELONGS, F.lit(False))
    out = F.when((F.col("format") == "jpeg") & F.col("kind").rlike("^E[0-9A-F]$") & ~belongs, "OTHER")
    out = F.when((F.col("format") == "jpeg") & (F.col("kind") == "E1") & starts(MORE_XMP), "XMP").otherwise(out)
    for name, header in HEADERS.items():
        out = F.when((F.col("format") == "jpeg") & (F.col("kind") == MARKERS[name]) & starts(header), F.lit(name)).otherwise(out)
    out = F.when((F.col("format") == "jpeg") & (F.col("kind") == "FE"), "COM").otherwise(out)
    png = F.when(F.col("kind").isin(*PNG_TEXT), "TEXT").when(F.col("kind") == "eXIf", "EXIF").when(F.col("kind") == "iCCP", "ICC").when(F.col("kind") == "acTL", "ANIMATION")
    webp = F.when(F.col("kind") == "EXIF", "EXIF").when(F.col("kind") == "XMP ", "XMP").when(F.col("kind") == "ICCP", "ICC").when(F.col("kind") == "ANIM", "ANIMATION")
    out = F.when(F.col("kind") == "TAIL", "TAIL").otherwise(out)
    png, webp = (F.when(F.col("kind") == "TAIL", "TAIL").otherwise(x) for x in (png, webp))
    return segments.withColumn("role", F.when(F.col("format") == "png", png).when(F.col("format") == "webp", webp).otherwise(out))


def metadata_only(segments: DataFrame) -> DataFrame:
    """Segments without the bytes of the picture: what inspection needs."""
    s = role(segments)
    size = F.octet_length("segment").cast("long")
    return s.select("doc_id", "format", "ord", "kind", F.when(F.col("role").isNotNull(), F.col("payload")).alias("payload"), size.alias("size"), "error")


def exif_blocks(segments: DataFrame) -> DataFrame:
    """doc_id and ``x`` (fields, gps, thumbnail, orientation, size) of the first readable EXIF block."""
    blocks = role(segments).filter("role = 'EXIF'").select("doc_id", "ord", exif(F.col("payload")).alias("x")).filter("x IS NOT NULL")
    return blocks.groupBy("doc_id").agg(F.min_by("x", "ord").alias("x"))


def exif_findings(blocks: DataFrame) -> DataFrame:
    """What EXIF blocks (doc_id, ``x``) tell: fields, coordinates, a thumbnail, the orientation."""
    c = F.col
    label_of = lambda t: F.coalesce(*(F.when(t == k, F.lit(label)) for k, label, _ in EXIF_FIELDS))
    level = lambda sev: c("tag").isin(*(k for k, _, x in EXIF_FIELDS if x == sev))
    fields = blocks.select("doc_id", F.explode("x.fields").alias("f")).select("doc_id", "f.tag", "f.value")
    gps_label = lambda t: reduce(lambda o, kv: F.when(t == kv[0], F.lit(kv[1])).otherwise(o), GPS_FIELDS.items(), t.cast("string"))
    from_blocks = [
        rule(F.size("x.gps") > 0, "EXIF · ubicación", "Coordenadas GPS", F.concat(F.lit("presentes: "), F.array_join(F.array_distinct(F.transform("x.gps", gps_label)), ", ")), "personal"),
        rule(c("x.thumbnail"), "EXIF", "Miniatura incrustada en el EXIF", F.lit("puede mostrar una versión distinta de la foto"), "media"),
        rule(c("x.orientation") > 0, "EXIF", "Orientación", F.concat(c("x.orientation").cast("string"), F.lit(" (se conserva)")), "baja"),
    ]
    by_field = [rule(level(sev), "EXIF", label_of(c("tag")), c("value"), sev) for sev in ("personal", "media", "baja")]
    return findings_of(fields, by_field).unionByName(findings_of(blocks, from_blocks))


def directory_findings(blocks: DataFrame) -> DataFrame:
    """What the directories behind the first one tell (doc_id, ``x``): serial numbers, owners, dates, and the place in degrees."""
    c = F.col
    labels = {k: label for k, label, _ in EXIF_FIELDS}
    fields = blocks.select("doc_id", F.explode("x.more").alias("f")).select("doc_id", "f.dir", "f.tag", "f.value").filter((c("dir") != "GPS") & c("tag").isin(*labels))
    label_of = F.coalesce(*(F.when(c("tag") == k, F.lit(label)) for k, label in labels.items()))
    level = lambda sev: c("tag").isin(*(k for k, _, x in EXIF_FIELDS if x == sev))
    by_field = [rule(level(sev), "EXIF · directorios", label_of, c("value"), sev) for sev in ("personal", "media", "baja")]
    spot = F.concat(F.format_string("%.6f", "x.latitude"), F.lit(", "), F.format_string("%.6f", "x.longitude"))
    place = [rule(c("x.latitude").isNotNull() & c("x.longitude").isNotNull(), "EXIF · ubicación", "Coordenadas en grados", spot, "personal")]
    return findings_of(fields, by_field).unionByName(findings_of(blocks, place))


def file_findings(files: DataFrame) -> DataFrame:
    """What a picture's file (doc_id, format, content) tells as a whole: its type, that its format is not cleaned, and what a TIFF holds, which is an EXIF block itself."""
    label = F.try_element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), F.col("format"))
    size = F.concat(F.round(F.octet_length("content") / 1024, 0).cast("long").cast("string"), F.lit(" KB"))
    types = [
        rule(F.lit(True), "Archivo", "Tipo detectado", F.concat(label, F.lit(" · "), size), "baja"),
        rule(~F.col("format").isin(*WALKS), "Archivo", "Formato no soportado para limpiar", F.lit("este formato todavía no se puede reescribir sin recodificar la imagen"), "media", keep=True),
    ]
    blocks = files.filter("format = 'tiff'").select("doc_id", exif(F.col("content")).alias("x")).filter("x IS NOT NULL")
    return findings_of(files, types).unionByName(exif_findings(blocks))


def image_findings(segments: DataFrame) -> DataFrame:
    """All findings of images: doc_id, grp, label, value, sev, keep.

    One pass over the segments with metadata, one over EXIF blocks, one aggregate by file.
    """
    segments = segments if "size" in segments.columns else metadata_only(segments)
    s = role(segments.filter(F.col("kind").isNotNull()))
    c, is_role = F.col, lambda name: F.col("role") == name
    s = s.withColumn("utf8", F.when(is_role("XMP"), F.make_valid_utf8(F.col("payload").cast("string")))).withColumn("latin", F.when(is_role("IPTC"), F.decode("payload", "ISO-8859-1")))
    utf8, latin = c("utf8"), c("latin")
    # One data set of an IPTC block: mark, number, two bytes of length, text.
    data_set = lambda n: F.trim(F.regexp_replace(F.regexp_extract(latin, f"\x1c\x02{chr(n)}[\\s\\S]{{2}}([^\x1c]{{0,140}})", 1), "[^\x20-\x7eÀ-ÿ]", " "))
    animated = lambda fmt: is_role("ANIMATION") & (c("format") == fmt)
    from_segments = [
        *(rule(is_role("XMP"), "XMP", label, F.regexp_extract(utf8, pattern, 1), sev) for pattern, label, sev in XMP),
        rule(is_role("XMP") & utf8.rlike("<(?:exif:)?GPS(?:Latitude|Longitude)>"), "XMP", "Coordenadas GPS en XMP", F.lit("presentes"), "personal"),
        *(rule(is_role("IPTC"), "IPTC (Photoshop)", label, data_set(n), sev) for n, label, sev in IPTC),
        rule(is_role("IPTC") & ~latin.rlike("\x1c\x02[" + "".join(chr(n) for n, _, _ in IPTC) + "][\\s\\S]{2}[^\x1c]*[\x21-\x7eÀ-ÿ]"), "IPTC (Photoshop)", "Bloque IPTC", F.lit("presente"), "media"),
        rule(is_role("COM"), "Comentario JPEG", "Comentario guardado en el archivo", printable(c("payload"), 140), "media"),
        rule(is_role("OTHER"), "Metadatos de imagen", F.concat(F.lit("Segmento APP"), F.conv(F.substring("kind", 2, 1), 16, 10)), printable(c("payload"), 140), "media"),
        rule(is_role("TAIL"), "Archivo", "Datos después del final de la imagen", F.concat(c("size").cast("string"), F.lit(" bytes")), "personal"),
        rule(is_role("DUCKY"), "Datos de cámara antiguos", "Segmento APP12 (Ducky)", F.lit("presente"), "personal"),
        rule(is_role("TEXT") & (c("kind") != "tIME"), "Texto incrustado en el PNG", F.concat(F.lit("Chunk "), c("kind")), printable(c("payload"), 160), "media"),
        rule(c("kind") == "tIME", "Texto incrustado en el PNG", "Fecha de modificación (tIME)", F.lit("presente"), "media"),
        rule(animated("png"), "PNG animado", "Animación (APNG)", F.lit("se conserva"), "baja"),
        rule(animated("webp"), "WebP animado", "Animación", F.lit("se conserva"), "baja"),
    ]
    profile = F.when(is_role("ICC"), F.when(c("format") == "png", F.col("size")).otherwise(F.octet_length("payload")))
    files = s.groupBy("doc_id", "format").agg(F.sum(profile).alias("icc"), F.count("role").alias("n"))
    bare = (c("n") == 0) & (c("format") != "png")
    from_files = [
        rule(c("icc") > 0, "Perfil de color", "Perfil ICC incrustado", F.concat(c("icc").cast("string"), F.lit(" bytes (se conserva)")), "baja"),
        rule(bare, "Metadatos de imagen", F.when(c("format") == "webp", F.lit("Bloques EXIF/XMP")).otherwise(F.lit("Segmentos con metadatos")), F.lit("ninguno"), "baja"),
    ]
    every = [findings_of(s.filter("role IS NOT NULL"), from_segments), exif_findings(exif_blocks(segments)), findings_of(files, from_files)]
    return reduce(DataFrame.unionByName, every)


def _wide(n: Column, digits: int, *, little: bool = False) -> Column:
    hexed = F.lpad(F.hex(n.cast("long")), digits, "0")
    if little:
        hexed = F.concat(*(F.substring(hexed, digits - 1 - k, 2) for k in range(0, digits, 2)))
    return F.unhex(hexed)


def clean_segments(segments: DataFrame, *, icc: str = "keep", orientation: str = "keep") -> DataFrame:
    """Segments that stay, with a new minimal EXIF block where the orientation is kept: doc_id, format, ord, segment."""
    if icc not in ("keep", "remove") or orientation not in ("keep", "remove"):
        raise ValueError("icc and orientation are keep or remove")
    gone = ["EXIF", "XMP", "IPTC", "COM", "DUCKY", "TEXT", "OTHER", "TAIL", *(["ICC"] if icc == "remove" else [])]
    blocks = exif_blocks(segments).filter("x.orientation > 0" if orientation == "keep" else "false").select("doc_id", tiff_block(F.col("x.orientation"), F.col("x.width"), F.col("x.height")).alias("tiff"))
    s = role(segments.filter(F.col("kind").isNotNull()))
    kept = s.filter(F.col("role").isNull() | ~F.col("role").isin(*gone)).join(blocks.select("doc_id", F.lit(True).alias("turned")), "doc_id", "left")
    # The flags of an extended WebP header tell what follows.
    flags = F.conv(F.hex(F.substring("segment", 9, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xFF & ~0x0C)).bitwiseOR(F.when(F.col("turned"), F.lit(0x08)).otherwise(F.lit(0)))
    kept = kept.withColumn("segment", F.when(F.col("kind") == "VP8X", F.concat(F.substring("segment", 1, 8), _wide(flags, 2), F.substring("segment", 10, 1 << 20))).otherwise(F.col("segment")))
    # A JPEG's block follows its JFIF header, a PNG's the image header; a WebP's comes last.
    after = s.groupBy("doc_id", "format").agg(F.max(F.when(F.col("kind").isin("SOI", "E0", "IHDR"), F.col("ord"))).alias("head"), F.max("ord").alias("tail"))
    body = F.col("tiff")
    png = F.concat(F.lit(b"eXIf"), body)
    block = (
        F.when(F.col("format") == "jpeg", F.concat(F.unhex(F.lit("FFE1")), _wide(F.octet_length(body) + 8, 4), F.lit(b"Exif\0\0"), body))
        .when(F.col("format") == "png", F.concat(_wide(F.octet_length(body), 8), png, _wide(F.crc32(png), 8)))
        .otherwise(F.concat(F.lit(b"EXIF"), _wide(F.octet_length(body), 8, little=True), body))
    )
    new = after.join(blocks, "doc_id").select("doc_id", "format", (F.when(F.col("format") == "webp", F.col("tail")).otherwise(F.col("head")) + 0.5).alias("ord"), block.alias("segment"))
    return kept.select("doc_id", "format", F.col("ord").cast("double").alias("ord"), "segment").unionByName(new)


def assemble(segments: DataFrame) -> DataFrame:
    """doc_id, format and content of segments put together; the size in a WebP header is set anew."""
    listed = segments.groupBy("doc_id", "format").agg(F.sort_array(F.collect_list(F.struct("ord", "segment"))).alias("l"))
    body = joined(F.transform("l", lambda x: x["segment"]))
    whole = listed.select("doc_id", "format", body.alias("content"))
    sized = F.concat(F.substring("content", 1, 4), _wide(F.octet_length("content") - 8, 8, little=True), F.expr("substring(content, 9)"))
    return whole.select("doc_id", "format", F.when(F.col("format") == "webp", sized).otherwise(F.col("content")).alias("content"))


def image_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """What is wrong with cleaned images, by re-reading both: metadata left, or a picture that differs."""
    picture = lambda s: role(s).filter("role IS NULL AND kind NOT IN ('RIFF', 'VP8X')").groupBy("doc_id").agg(F.sha2(joined(F.transform(F.sort_array(F.collect_list(F.struct("ord", "segment"))), lambda x: x["segment"])), 256).alias("sha"))
    left = role(after).filter(F.col("role").isin("XMP", "IPTC", "COM", "DUCKY", "TEXT", "OTHER", "TAIL")).select("doc_id", F.concat(F.lit("left: "), F.col("role")).alias("problem"))
    fields = exif_blocks(after).filter((F.size("x.gps") > 0) | F.exists("x.fields", lambda f: ~f["tag"].isin(0x0112, 0xA002, 0xA003))).select("doc_id", F.lit("left: EXIF fields").alias("problem"))
    a, b = picture(before), picture(after).withColumnRenamed("sha", "sha_after")
    other = a.join(b, "doc_id", "left").filter(~F.col("sha").eqNullSafe(F.col("sha_after"))).select("doc_id", F.lit("picture differs").alias("problem"))
    return left.unionByName(fields).unionByName(other)
