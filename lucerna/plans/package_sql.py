"""DuckDB SQL that tells from the documents table what the package queries must find."""

from __future__ import annotations

from lucerna.operators.verdict import RECOMMENDATIONS

# Which packages carry which parts, as the fixtures are made.
FORMAT = "CASE doc_id % 3 WHEN 0 THEN 'word' WHEN 1 THEN 'excel' ELSE 'powerpoint' END"
PARTS = """parts AS (
  SELECT doc_id, 0 AS k, '[Content_Types].xml' AS name FROM documents UNION ALL SELECT doc_id, 1, '_rels/.rels' FROM documents
  UNION ALL SELECT doc_id, k, name FROM documents, (VALUES (2, 'word/document.xml'), (3, 'word/comments.xml'), (4, 'word/people.xml'), (5, 'word/settings.xml'), (16, 'docProps/thumbnail.jpeg')) v(k, name) WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 6, 'word/vbaProject.bin' FROM documents WHERE doc_id % 21 = 0
  UNION ALL SELECT doc_id, 7, 'xl/workbook.xml' FROM documents WHERE doc_id % 3 = 1
  UNION ALL SELECT doc_id, 8, 'xl/connections.xml' FROM documents WHERE doc_id % 12 = 1
  UNION ALL SELECT doc_id, k, name FROM documents, (VALUES (9, 'xl/externalLinks/_rels/externalLink1.xml.rels'), (10, 'xl/printerSettings/printerSettings1.bin')) v(k, name) WHERE doc_id % 6 = 1
  UNION ALL SELECT doc_id, k, name FROM documents, (VALUES (11, 'ppt/presentation.xml'), (12, 'ppt/commentAuthors.xml'), (13, 'ppt/notesSlides/notesSlide1.xml')) v(k, name) WHERE doc_id % 3 = 2
  UNION ALL SELECT doc_id, k, name FROM documents, (VALUES (14, 'docProps/core.xml'), (15, 'docProps/app.xml')) v(k, name)
), listed AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ord, name FROM parts)"""

_PEOPLE = "'Personas con cuenta vinculada'"
_DATA = "'Excel · datos externos'"
_CHANGES = "'Control de cambios'"
_TRACES = "'Rastros técnicos de edición'"
_ROWS = [
    ("true", "'Archivo'", "'Tipo detectado'", "CASE doc_id % 3 WHEN 0 THEN 'Word' WHEN 1 THEN 'Excel' ELSE 'PowerPoint' END || ' · ' || (SELECT count(*) FROM parts p WHERE p.doc_id = d.doc_id) || ' partes'", "baja", "false"),
    ("true", "'Propiedades del documento'", "'Título'", "'Documento ' || doc_id", "media", "false"),
    ("true", "'Propiedades del documento'", "'Autor'", "source", "personal", "false"),
    ("true", "'Propiedades del documento'", "'Última persona que guardó'", "lang", "personal", "false"),
    ("true", "'Propiedades de la aplicación'", "'Empresa'", "'Empresa ' || lang", "personal", "false"),
    ("true", "'Propiedades de la aplicación'", "'Tiempo de edición'", "(doc_id % 100) || ' minutos'", "media", "false"),
    ("true", "'Paquete ZIP'", "'Fechas internas de cada archivo'", "'1980-01-01 00:00:00'", "baja", "false"),
    ("doc_id % 3 = 0", _PEOPLE, "source", "'(sin identificador)'", "personal", "false"),
    ("doc_id % 3 = 0", _PEOPLE, "'(sin nombre)'", "'AD ' || doc_id", "personal", "false"),
    ("doc_id % 3 = 0", "'Comentarios'", "'Comentarios en el documento'", "'1'", "media", "false"),
    ("doc_id % 3 IN (0, 2)", "'Comentarios'", "'Autores de los comentarios'", "source", "personal", "false"),
    ("doc_id % 3 = 0", _CHANGES, "'Inserciones'", "'1'", "edicion", "false"),
    ("doc_id % 3 = 0", _CHANGES, "'Borrados'", "'1'", "edicion", "false"),
    ("doc_id % 3 = 0", _CHANGES, "'Autores registrados'", "source || ', ' || lang", "personal", "false"),
    ("doc_id % 3 = 0", _CHANGES, "'Fechas registradas'", "'3 marcas entre 2024-01-01T00:00:00Z y 2024-01-03T00:00:00Z'", "edicion", "false"),
    ("doc_id % 3 = 0", "'Miniatura y adjuntos'", "'Miniatura incrustada (vista previa guardada)'", "'puede mostrar una versión anterior del contenido'", "media", "false"),
    ("doc_id % 21 = 0", "'Contenido incrustado'", "'Macros (vbaProject.bin)'", "'presentes'", "personal", "false"),
    ("doc_id % 3 = 0", _TRACES, "'Identificadores rsid (sesiones de edición)'", "'1'", "baja", "false"),
    ("doc_id % 3 = 0", _TRACES, "'Identificadores de párrafo/texto'", "'1'", "baja", "false"),
    ("doc_id % 12 = 1", _DATA, "'Conexiones a bases de datos'", "'1 (cadena de conexión)'", "personal", "false"),
    ("doc_id % 12 = 1", _DATA, "'Cadena de conexión'", "'Server=' || source || ';Password=secreto'", "personal", "false"),
    ("doc_id % 12 = 1", _DATA, "'Cadena de conexión'", "'SELECT 1'", "personal", "false"),
    ("doc_id % 6 = 1", _DATA, "'Enlace a otro libro'", r"'C:\datos\' || doc_id || '.xlsx'", "personal", "true"),
    ("doc_id % 6 = 1", _DATA, "'Configuración de impresora guardada'", "'1 parte(s)'", "media", "false"),
    ("doc_id % 6 = 4", "'Excel · hojas ocultas'", "'Hojas ocultas'", "'1 oculta(s), 0 muy oculta(s)'", "media", "true"),
    ("doc_id % 15 = 10", _DATA, "'Nombres definidos apuntando a otros archivos'", "'Fuera'", "media", "true"),
    ("doc_id % 3 = 2", "'PowerPoint · notas'", "'Diapositivas con notas del orador'", "'1'", "media", "true"),
]
FINDINGS = f"{PARTS}, findings AS (" + " UNION ALL ".join(f"SELECT doc_id, {g} AS grp, {lab} AS label, {v} AS value, '{s}' AS sev, {k} AS keep FROM documents d WHERE {c}" for c, g, lab, v, s, k in _ROWS) + ")"
SIGNALS = (
    "signals AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{n}' AS nivel, '{t}' AS titulo FROM documents WHERE {c}"
        for c, n, t in [
            ("doc_id % 21 = 0", "alto", "Macros incrustadas (VBA)"),
            ("doc_id % 12 = 1", "alto", "Conexión a una base de datos externa"),
            ("doc_id % 6 = 1", "medio", "Enlaces a otros archivos"),
            ("doc_id % 15 = 10", "medio", "Nombres definidos que apuntan fuera del archivo"),
            ("doc_id % 6 = 4", "bajo", "Hojas ocultas"),
        ]
    )
    + ")"
)
_ESCAPED = "regexp_replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
_DROPPED = "name NOT IN ('docProps/thumbnail.jpeg', 'word/vbaProject.bin', 'xl/connections.xml', 'xl/printerSettings/printerSettings1.bin')"

ORACLE = {
    "office_kinds": f"SELECT doc_id, 'office' AS kind, {FORMAT} AS format, CASE doc_id % 3 WHEN 0 THEN 'Word' WHEN 1 THEN 'Excel' ELSE 'PowerPoint' END AS label FROM documents",
    "office_parts": f"WITH {PARTS} SELECT doc_id, ord, name, true AS crc_ok, CASE WHEN name LIKE '%.bin' THEN sha256('\\xFF\\xD8\\xFF\\xD9'::BLOB) END AS sha256 FROM listed",
    "office_findings": f"WITH {FINDINGS} SELECT * FROM findings",
    "office_signals": f"WITH {SIGNALS} SELECT * FROM signals",
    "office_verdict": f"WITH {SIGNALS}, s AS (SELECT doc_id, least(100, sum(CASE nivel WHEN 'alto' THEN 40 WHEN 'medio' THEN 15 ELSE 5 END)) AS s, count(*) AS n FROM signals GROUP BY doc_id) SELECT doc_id, CASE WHEN coalesce(s, 0) >= 40 THEN 'alto' WHEN coalesce(s, 0) >= 15 THEN 'medio' ELSE 'bajo' END AS riesgo, CAST(coalesce(s, 0) AS INTEGER) AS puntuacion, coalesce(n, 0) AS n_signals FROM documents LEFT JOIN s USING (doc_id)",
    "office_clean": f"WITH {PARTS} SELECT doc_id, name, CASE name WHEN 'word/document.xml' THEN sha256({_ESCAPED} || 'nuevo') WHEN 'word/comments.xml' THEN sha256('nota') END AS text_sha256 FROM listed JOIN documents USING (doc_id) WHERE {_DROPPED}",
    "office_accept": f"SELECT doc_id, sha256({_ESCAPED} || 'nuevo') AS accept, sha256({_ESCAPED} || 'viejo') AS reject FROM documents WHERE doc_id % 3 = 0",
    "office_violations": "SELECT 0 AS doc_id, '' AS part, '' AS problem WHERE false",
}

_SEGMENTS = [
    ("jpeg", ["SOI:", "E0:", "E1:EXIF", "E1:XMP", "FE:COM", "SCAN:"]),
    ("png", ["SIGNATURE:", "IHDR:", "tEXt:TEXT", "eXIf:EXIF", "IDAT:", "IEND:"]),
    ("webp", ["RIFF:", "VP8X:", "VP8 :", "EXIF:EXIF", "XMP :XMP"]),
]
ORACLE["image_segments"] = " UNION ALL ".join(
    f"SELECT doc_id, '{fmt}' AS format, {i} AS ord, '{x.split(':')[0]}' AS kind, nullif('{x.split(':')[1]}', '') AS role FROM documents WHERE doc_id % 3 = {k}" for k, (fmt, kinds) in enumerate(_SEGMENTS) for i, x in enumerate(kinds)
)
_TURNED = "SELECT doc_id, 'EXIF' AS grp, 'Orientación' AS label, '6 (se conserva)' AS value, 'baja' AS sev, false AS keep FROM documents"
ORACLE["image_findings"] = f"""{_TURNED} UNION ALL SELECT doc_id, 'EXIF', 'Fabricante de la cámara', source, 'personal', false FROM documents
UNION ALL SELECT doc_id, 'EXIF · ubicación', 'Coordenadas GPS', 'presentes: latitud', 'personal', false FROM documents
UNION ALL SELECT doc_id, 'XMP', 'Herramienta que creó el archivo', lang, 'media', false FROM documents WHERE doc_id % 3 <> 1
UNION ALL SELECT doc_id, 'Comentario JPEG', 'Comentario guardado en el archivo', lang, 'media', false FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'Texto incrustado en el PNG', 'Chunk tEXt', 'Author ' || lang, 'media', false FROM documents WHERE doc_id % 3 = 1"""
ORACLE["image_clean"] = _TURNED
ORACLE["image_violations"] = "SELECT 0 AS doc_id, '' AS problem WHERE false"

_OPEN = "doc_id % 11 <> 0"
_PDF_ROWS = [
    ("true", "'Estructura'", "'Objetos en el archivo'", "'7'", "baja", "false"),
    ("doc_id % 5 = 0", "'Estructura'", "'Versiones anteriores dentro del archivo'", "'2 actualizaciones incrementales en el mismo archivo'", "personal", "true"),
    ("doc_id % 11 = 0", "'Archivo'", "'PDF cifrado'", "'no se puede limpiar sin la contraseña'", "media", "true"),
    (_OPEN, "'Propiedades del documento'", "'Diccionario /Info'", "'presente'", "baja", "false"),
    (_OPEN, "'Propiedades del documento'", "'Autor'", "CASE WHEN doc_id % 5 = 0 THEN lang ELSE source END", "personal", "false"),
    (f"{_OPEN} AND doc_id % 5 <> 0", "'Propiedades del documento'", "'Título'", "'A'", "media", "false"),
    (_OPEN, "'Estructura'", "'Identificador del archivo (/ID)'", "'huellas que identifican este archivo concreto'", "media", "false"),
    (_OPEN, "'XMP incrustado'", "'Paquete XMP'", "'presente'", "personal", "false"),
    (_OPEN, "'XMP incrustado'", "'Herramienta'", "source", "media", "false"),
    (_OPEN, "'Adjuntos'", "'Archivo incrustado dentro del PDF'", "'hay documentos dentro del archivo'", "personal", "true"),
    (_OPEN, "'Estructura'", "'Páginas'", "'1'", "baja", "false"),
    (f"{_OPEN} AND doc_id % 3 = 0", "'JavaScript'", "'Código que puede ejecutarse al abrir el PDF'", "'presente'", "personal", "false"),
    (f"{_OPEN} AND doc_id % 4 = 0", "'Adjuntos'", "'Archivos incrustados (/EmbeddedFiles)'", "'documentos dentro del PDF'", "personal", "true"),
]
ORACLE |= {
    "pdf_objects": "SELECT doc_id, n AS num, CAST(CASE n WHEN 4 THEN strlen(text) WHEN 6 THEN strlen(source) + 58 ELSE -1 END AS BIGINT) AS stream_bytes FROM documents, range(1, 8) r(n)",
    "pdf_findings": " UNION ALL ".join(f"SELECT doc_id, {g} AS grp, {lab} AS label, {v} AS value, '{s}' AS sev, {k} AS keep FROM documents WHERE {c}" for c, g, lab, v, s, k in _PDF_ROWS),
    "pdf_verdict": "WITH s AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE CASE WHEN doc_id % 3 = 0 THEN 40 ELSE 0 END + 15 END AS p FROM documents) SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'desconocido' WHEN p >= 40 THEN 'alto' ELSE 'medio' END AS riesgo, p AS puntuacion, CAST(CASE WHEN doc_id % 11 = 0 THEN 0 WHEN p > 15 THEN 2 ELSE 1 END AS BIGINT) AS n_signals FROM s",
    "pdf_clean": "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'encrypted' ELSE '' END AS error, CAST(CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 4 = 0 THEN 5 ELSE 4 END AS BIGINT) AS objects, CASE WHEN doc_id % 11 = 0 THEN '' ELSE sha256(text) END AS content_sha256 FROM documents",
    "pdf_tables": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 5 ELSE 4 END AS objects, CASE WHEN doc_id % 4 = 0 THEN 5 ELSE 4 END AS told FROM documents WHERE doc_id % 11 <> 0",
}

_ADVICE = "CASE riesgo " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RECOMMENDATIONS.items()) + " END AS recomendacion"
_MIXED_SIGNALS = (
    SIGNALS.replace("signals AS (", "office_signals AS (", 1)
    + """, signals AS (
  SELECT * FROM office_signals WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 'alto', 'Código que se ejecuta al abrir el PDF' FROM documents WHERE doc_id % 4 = 2 AND doc_id % 3 = 0 AND doc_id % 11 <> 0
  UNION ALL SELECT doc_id, 'medio', 'Archivos incrustados dentro del PDF' FROM documents WHERE doc_id % 4 = 2 AND doc_id % 11 <> 0
)"""
)
ORACLE |= {
    "scan_mixed": f"""WITH {_MIXED_SIGNALS}, s AS (SELECT doc_id, least(100, sum(CASE nivel WHEN 'alto' THEN 40 WHEN 'medio' THEN 15 ELSE 5 END)) AS s, string_agg(titulo, '; ' ORDER BY CASE nivel WHEN 'alto' THEN 0 WHEN 'medio' THEN 1 ELSE 2 END, titulo) AS titles FROM signals GROUP BY doc_id),
v AS (SELECT doc_id, doc_id % 4 = 3 OR (doc_id % 4 = 2 AND doc_id % 11 = 0) AS bad, coalesce(s, 0) AS s, coalesce(titles, '') AS titles FROM documents LEFT JOIN s USING (doc_id)),
r AS (SELECT doc_id, CASE WHEN bad THEN 'desconocido' WHEN s >= 40 THEN 'alto' WHEN s >= 15 THEN 'medio' ELSE 'bajo' END AS riesgo, CAST(CASE WHEN bad THEN 0 ELSE s END AS INTEGER) AS puntuacion, titles FROM v)
SELECT doc_id, riesgo, puntuacion, titles, {_ADVICE} FROM r""",
    "clean_mixed": """WITH k AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'office' WHEN 1 THEN 'image' WHEN 2 THEN 'pdf' ELSE 'none' END AS kind, CASE WHEN doc_id % 4 = 3 THEN 'unsupported format' WHEN doc_id % 4 = 2 AND doc_id % 11 = 0 THEN 'encrypted' ELSE '' END AS error FROM documents)
SELECT doc_id, kind, error, CASE WHEN error = '' THEN kind ELSE 'none' END AS kind_out, error = '' AS changed FROM k""",
}

ORACLE["bundles"] = """WITH d AS (SELECT doc_id // 20 AS request, doc_id, lang, text FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY doc_id) - 1 AS ord, row_number() OVER (PARTITION BY request, lang ORDER BY doc_id) AS k FROM d)
SELECT request, ord, lang || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || '.txt' AS name, sha256(text) AS sha256 FROM n"""

_CLEAN_TEXT = "regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{FFFE}\\x{FFFF}]', '', 'g')"
_UNIX = f"replace(replace({_CLEAN_TEXT}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
ORACLE["office_other_spellings"] = f"SELECT doc_id, 0 AS problems, 0 AS people, CASE WHEN doc_id % 3 = 0 THEN sha256({_UNIX} || 'nuevo' || 'viejo') ELSE '' END AS text_sha256 FROM documents"
# What the fixtures of each format carry for a cleaning to count.
_COUNTED = [("authors", "3, 0, 0"), ("dates", "3, 0, 0"), ("accounts", "3, 0, 0"), ("comments", "1, 0, 2"), ("rsid", "4, 0, 0"), ("paraId", "1, 0, 0"), ("settings", "1, 0, 0")]
_BY_FORMAT = ", ".join(f"[{n}][doc_id % 3 + 1] AS {k}" for k, n in _COUNTED)
_ALWAYS = "'Título, autor, última persona que guardó, empresa, plantilla, revisión y fechas del archivo; Fechas internas del paquete ZIP normalizadas'"
_NOTES = """CASE doc_id % 3 WHEN 0 THEN '3 nombres o cuentas de la lista de personas; 3 campos de autor anonimizados; 3 fechas borradas; 1 autor(es) de comentarios sin nombre ni fecha; 4 identificadores de sesión de edición (rsid); 1 identificadores de párrafo o texto; 1 ajuste(s) de plantilla o de control de cambios; '
  WHEN 2 THEN '2 autor(es) de comentarios sin nombre ni fecha; ' ELSE '' END"""
ORACLE["clean_report"] = f"""WITH {FINDINGS}, n AS (SELECT doc_id, count(*) AS n_findings FROM findings GROUP BY doc_id)
SELECT doc_id, 'informe ' || doc_id || '.docx' AS name, 'informe ' || doc_id || ' - sin metadatos.docx' AS output_name, 'office' AS kind, {FORMAT.replace("'word'", "'Word'").replace("'excel'", "'Excel'").replace("'powerpoint'", "'PowerPoint'")} AS format,
  {_BY_FORMAT}, {_NOTES} || {_ALWAYS} AS removed, n_findings, '' AS error FROM documents JOIN n USING (doc_id)"""
_SCORES = f"""WITH {SIGNALS}, o AS (SELECT doc_id, least(100, sum(CASE nivel WHEN 'alto' THEN 40 WHEN 'medio' THEN 15 ELSE 5 END)) AS s, count(*) AS n FROM signals GROUP BY doc_id),
f AS (
  SELECT 4 * doc_id AS file_id, false AS bad, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM documents LEFT JOIN o USING (doc_id)
  UNION ALL SELECT 4 * doc_id + 1, false, 0, 0 FROM documents
  UNION ALL SELECT 4 * doc_id + 2, doc_id % 11 = 0, 15 + CASE WHEN doc_id % 3 = 0 THEN 40 ELSE 0 END, 1 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END FROM documents
  UNION ALL SELECT 4 * doc_id + 3, true, 0, 0 FROM documents
)"""
ORACLE["scan_every_kind"] = f"{_SCORES} SELECT file_id, CASE WHEN bad THEN 'desconocido' WHEN s >= 40 THEN 'alto' WHEN s >= 15 THEN 'medio' ELSE 'bajo' END AS riesgo, CAST(CASE WHEN bad THEN 0 ELSE s END AS INTEGER) AS puntuacion, CAST(CASE WHEN bad THEN 0 ELSE n END AS BIGINT) AS n FROM f"
ORACLE["clean_every_kind"] = """SELECT 4 * doc_id + k AS file_id, ['office', 'image', 'pdf', 'none'][k + 1] AS kind, CASE WHEN k = 3 THEN 'unsupported format' WHEN k = 2 AND doc_id % 11 = 0 THEN 'encrypted' ELSE '' END AS error, NOT (k = 3 OR (k = 2 AND doc_id % 11 = 0)) AS changed FROM documents, range(4) r(k)"""

_PICTURE_SIZE = "CAST(round((octet_length(encode(coalesce(text, ''))) + extra) / 1024.0) AS BIGINT) || ' KB'"
_UNSUPPORTED = "'Archivo' AS grp, 'Formato no soportado para limpiar' AS label, 'este formato todavía no se puede reescribir sin recodificar la imagen' AS value, 'media' AS sev, true AS keep"
# Bytes of a picture file beside its text, from the lengths of what it carries.
_TIFF = "(strlen(source) + 1 + 68)"
_LANG = "strlen(lang)"
_XMP_SIZE = f"({_LANG} + 58)"
_EXTRA = f"""CASE WHEN k = 1 THEN {_TIFF} WHEN k = 2 THEN 16
  WHEN doc_id % 3 = 0 THEN 2 + 18 + (10 + {_TIFF}) + (33 + {_XMP_SIZE}) + (4 + {_LANG}) + 4 + 2
  WHEN doc_id % 3 = 1 THEN 8 + 25 + (19 + {_LANG}) + (12 + {_TIFF}) + 12 + 12
  ELSE 8 + 4 + 18 + (8 + strlen(text) % 2) + (8 + {_TIFF} + {_TIFF} % 2) + (8 + {_XMP_SIZE} + {_XMP_SIZE} % 2) END"""
ORACLE["image_file_findings"] = f"""WITH f AS (SELECT 3 * doc_id + k AS file_id, doc_id, k, source, text, {_EXTRA} AS extra FROM documents, range(3) r(k))
SELECT file_id, 'Archivo' AS grp, 'Tipo detectado' AS label, CASE k WHEN 1 THEN 'TIFF' WHEN 2 THEN 'HEIC' ELSE ['JPEG', 'PNG', 'WebP'][doc_id % 3 + 1] END || ' · ' || {_PICTURE_SIZE} AS value, 'baja' AS sev, false AS keep FROM f
UNION ALL SELECT file_id, {_UNSUPPORTED} FROM f WHERE k > 0
UNION ALL SELECT file_id, 'EXIF', 'Fabricante de la cámara', source, 'personal', false FROM f WHERE k = 1
UNION ALL SELECT file_id, 'EXIF', 'Orientación', '6 (se conserva)', 'baja', false FROM f WHERE k = 1
UNION ALL SELECT file_id, 'EXIF · ubicación', 'Coordenadas GPS', 'presentes: latitud', 'personal', false FROM f WHERE k = 1"""
ORACLE["file_summaries"] = """WITH b AS (SELECT 4 * doc_id + k AS file_id, k, doc_id, CASE k
  WHEN 0 THEN CASE doc_id % 3 WHEN 0 THEN ['2 marcas de control de cambios', CASE WHEN source = lang THEN '1' ELSE '2' END || ' autores distintos', '2 identificadores técnicos', 'cuentas vinculadas', 'miniatura incrustada', CASE WHEN doc_id % 21 = 0 THEN 'macros' END]
    WHEN 1 THEN [CASE WHEN doc_id % 12 = 1 THEN 'conexiones a bases de datos' END] ELSE [] END
  WHEN 1 THEN ['coordenadas GPS', 'datos EXIF', CASE WHEN doc_id % 3 <> 1 THEN 'XMP' END, 'orientación 6 (que se conserva)']
  WHEN 2 THEN [CASE WHEN doc_id % 5 = 0 THEN '1 versión(es) anteriores dentro del archivo' END, 'XMP incrustado', 'identificador del archivo'] ELSE [] END AS bits,
  CASE k WHEN 0 THEN ['Word', 'Excel', 'PowerPoint'][doc_id % 3 + 1] WHEN 1 THEN ['JPEG', 'PNG', 'WEBP'][doc_id % 3 + 1] ELSE 'PDF' END AS label FROM documents, range(4) r(k)),
t AS (SELECT *, array_to_string(list_filter(bits, lambda x: x IS NOT NULL), ', ') AS told FROM b)
SELECT file_id, CASE WHEN k = 3 THEN '' WHEN k = 2 AND doc_id % 11 = 0 THEN 'Detectamos un PDF cifrado: se puede ver el informe, pero no limpiarlo sin la contraseña.'
  WHEN told = '' THEN label || ' sin metadatos personales detectados.' ELSE 'Detectamos ' || ['un archivo de', 'una imagen', 'un'][k + 1] || ' ' || label || ' con ' || told || '.' END AS summary FROM t"""
_FOUND = "'  [x] ' || "
ORACLE["raw_marks"] = f"""WITH {PARTS}, n AS (SELECT doc_id, count(*) AS n FROM listed GROUP BY doc_id),
f AS (SELECT doc_id, lang, source, text, 0 AS k, {_EXTRA.replace("k = 1", "false").replace("k = 2", "false")} AS extra FROM documents),
m AS (
  SELECT 4 * doc_id AS file_id, CASE doc_id % 3 WHEN 1 THEN 17 ELSE 12 END - (doc_id % 12 = 1)::INT - 2 * (doc_id % 6 = 1)::INT - (doc_id % 15 = 10)::INT AS absent, ['  contenedor ZIP/' || ['docx', 'xlsx', 'pptx'][doc_id % 3 + 1] || ' con ' || n || ' partes',
    {_FOUND} 'core.xml dc:title = Documento ' || doc_id, {_FOUND} 'core.xml dc:creator = ' || source, {_FOUND} 'core.xml cp:lastModifiedBy = ' || lang, {_FOUND} 'app.xml TotalTime = ' || doc_id % 100, {_FOUND} 'app.xml Company = Empresa ' || lang,
    CASE WHEN doc_id % 6 = 1 THEN {_FOUND} 'enlaces externos a otros archivos (1)' END, CASE WHEN doc_id % 12 = 1 THEN {_FOUND} 'xl/connections.xml (cadenas de conexión a bases de datos): Server=' || source || ';Password=secreto, SELECT 1' END,
    CASE WHEN doc_id % 15 = 10 THEN {_FOUND} 'nombres definidos: Fuera' END, CASE WHEN doc_id % 6 = 1 THEN {_FOUND} 'configuración de impresora (1)' END,
    CASE WHEN doc_id % 3 = 2 THEN {_FOUND} 'ppt/commentAuthors.xml (autores de comentarios): ' || source END, CASE doc_id % 3 WHEN 0 THEN {_FOUND} 'partes de comentarios: word/comments.xml' WHEN 2 THEN {_FOUND} 'partes de comentarios: ppt/commentAuthors.xml' END] AS l FROM documents JOIN n USING (doc_id)
  UNION ALL SELECT 4 * doc_id + 1, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END, ['  ' || (octet_length(encode(coalesce(text, ''))) + extra) || ' bytes', CASE WHEN doc_id % 3 = 0 THEN {_FOUND} 'XMP (Adobe)' END, CASE WHEN doc_id % 3 = 0 THEN {_FOUND} 'segmento COM (comentario JPEG)' END,
    CASE WHEN doc_id % 3 = 1 THEN {_FOUND} 'chunks de texto PNG' END, CASE WHEN doc_id % 3 = 1 THEN {_FOUND} 'chunk eXIf (EXIF dentro de PNG)' END, {_FOUND} 'fabricante (Make) = ' || source, {_FOUND} 'GPS presente: latitud (coordenadas omitidas)'] FROM f
  UNION ALL SELECT 4 * doc_id + 2, CASE WHEN doc_id % 4 = 0 THEN 8 ELSE 9 END, ['  1 páginas', {_FOUND} '/Author = ' || source, {_FOUND} '/Title = FEFF0041', {_FOUND} 'XMP incrustado', {_FOUND} 'actualizaciones incrementales (texto anterior recuperable)', CASE WHEN doc_id % 4 = 0 THEN {_FOUND} 'archivos adjuntos incrustados' END] FROM documents
  UNION ALL SELECT 4 * doc_id + 3, 0, ['  sin analizador para .txt'] FROM documents
) SELECT file_id, array_to_string(list_filter(l, lambda x: x IS NOT NULL), chr(10)) AS lines, CAST(absent AS BIGINT) AS absent FROM m"""

# Files with name trees: what each object says, by its number.
_ODD_NAMES = "'<< /JavaScript 6 0 R /EmbeddedFiles 8 0 R >>'"
_TREE_ENTRIES = [
    ("true", 1, 1, "Type", "'/Catalog'"), ("true", 1, 1, "Pages", "'2 0 R'"), ("true", 1, 1, "Lang", "'(see 99 0 R now)'"), ("doc_id % 2 = 0", 1, 1, "Names", "'5 0 R'"),
    ("doc_id % 2 = 1", 1, 1, "Names", _ODD_NAMES), ("doc_id % 2 = 1", 1, 2, "JavaScript", "'6 0 R'"), ("doc_id % 2 = 1", 1, 2, "EmbeddedFiles", "'8 0 R'"),
    ("true", 2, 1, "Type", "'/Pages'"), ("true", 2, 1, "Kids", "'[3 0 R]'"), ("true", 2, 1, "Count", "'1'"),
    ("true", 3, 1, "Type", "'/Page'"), ("true", 3, 1, "Parent", "'2 0 R'"), ("true", 3, 1, "Contents", "'4 0 R'"),
    ("doc_id % 3 = 0", 3, 1, "AA", "'<< /O << /S /JavaScript /JS (page) >> >>'"), ("doc_id % 3 = 0", 3, 2, "O", "'<< /S /JavaScript /JS (page) >>'"), ("doc_id % 3 = 0", 3, 3, "S", "'/JavaScript'"), ("doc_id % 3 = 0", 3, 3, "JS", "'(page)'"),
    ("true", 5, 1, "JavaScript", "'6 0 R'"), ("true", 5, 1, "EmbeddedFiles", "'8 0 R'"), ("true", 6, 1, "Kids", "'[7 0 R]'"), ("true", 7, 1, "Limits", "'[(first) (second)]'"), ("true", 7, 1, "Kids", "'[6 0 R]'"),
    ("true", 7, 1, "Names", "'[(first) 9 0 R (second) << /S /JavaScript /JS (two) >>]'"), ("true", 7, 3, "S", "'/JavaScript'"), ("true", 7, 3, "JS", "'(two)'"), ("true", 8, 1, "Names", "'[(' || source || ') 10 0 R]'"),
    ("true", 9, 1, "S", "'/JavaScript'"), ("true", 9, 1, "JS", r"'(one \) 97 0 R)'"), ("true", 10, 1, "Type", "'/Filespec'"), ("true", 10, 1, "F", "'(a.txt)'"),
]
_HAS_TEXT = "text IS NOT NULL"
ORACLE |= {
    "pdf_entries": " UNION ALL ".join(f"SELECT doc_id, {num} AS num, {depth} AS depth, '{key}' AS key, {value} AS value FROM documents WHERE {_HAS_TEXT} AND {c}" for c, num, depth, key, value in _TREE_ENTRIES),
    "pdf_references": f"""SELECT doc_id, src, dst FROM documents, (VALUES (1, 2, -1), (1, 5, 0), (1, 6, 1), (1, 8, 1), (2, 3, -1), (3, 2, -1), (3, 4, -1), (5, 6, -1), (5, 8, -1), (6, 7, -1), (7, 6, -1), (7, 9, -1), (8, 10, -1)) r(src, dst, half)
  WHERE {_HAS_TEXT} AND (half = -1 OR doc_id % 2 = half)""",
    "pdf_tree_names": f"""SELECT doc_id, 'JavaScript' AS tree, name, num FROM documents, (VALUES ('first', 9), ('second', -1)) n(name, num) WHERE {_HAS_TEXT}
  UNION ALL SELECT doc_id, 'EmbeddedFiles', source, 10 FROM documents WHERE {_HAS_TEXT}""",
    "pdf_tree_clean": f"SELECT doc_id, '' AS error, CAST(7 - doc_id % 2 AS BIGINT) AS objects, doc_id % 3 = 0 AS script, CAST(7 - doc_id % 2 AS BIGINT) AS deep_objects, false AS deep_script FROM documents WHERE {_HAS_TEXT}",
    "pdf_violations": f"SELECT doc_id, 'left in the catalogue: /OpenAction' AS problem, 'planted' AS which FROM documents WHERE {_HAS_TEXT}",
    "picture_violations": """SELECT doc_id, 'left: ' || told AS problem, 'as it was' AS which FROM documents,
  (VALUES (0, 'EXIF field 010F'), (0, 'EXIF field 8825'), (0, 'APP1'), (0, 'comment'), (1, 'chunk tEXt'), (1, 'EXIF field 010F'), (1, 'EXIF field 8825'), (2, 'EXIF field 010F'), (2, 'EXIF field 8825'), (2, 'chunk XMP')) t(kind, told)
  WHERE doc_id % 3 = kind""",
    "verify_pairs": """SELECT 'f' || (4 * doc_id + k) || '.bin' AS name, 'f' || (4 * doc_id + k) || ' - sin metadatos.bin' AS wanted, ['office', 'image', 'pdf', 'none'][k + 1] AS kind,
  CASE WHEN doc_id % 7 = 0 OR (doc_id % 5 <> 0 AND (k = 3 OR (k = 2 AND doc_id % 11 = 0))) THEN 'no output' WHEN k = 3 THEN 'no verifier' WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status FROM documents, range(4) r(k)""",
}
ORACLE["verify_tally"] = f"SELECT kind, status, count(*) AS n FROM ({ORACLE['verify_pairs']}) GROUP BY kind, status"

_REQUESTS = "requests AS (SELECT doc_id // 20 AS request, doc_id, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS nth, row_number() OVER (PARTITION BY doc_id // 20, lang ORDER BY doc_id) AS same, lang, coalesce(text, '') AS text FROM documents)"
ORACLE |= {
    "package_responses": f"""WITH {_REQUESTS}
  SELECT request, nth - 1 AS ord, lang || CASE WHEN same > 1 THEN ' (' || same || ')' ELSE '' END || '.txt' AS name, true AS crc_ok, sha256(text) AS sha256 FROM requests
  UNION ALL SELECT request, count(*), 'informe.json', true, sha256('{{"servicio":"metadata","version":"1","files":[' || string_agg('{{"id":' || doc_id || '}}', ',' ORDER BY doc_id) || ']}}') FROM requests GROUP BY request""",
    # The fold over sizes, one document at a time: a page ends before the file that it has no room for.
    "json_responses": """WITH RECURSIVE files AS (SELECT doc_id // 20 AS request, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS nth, strlen(coalesce(text, '')) AS size FROM documents WHERE strlen(coalesce(text, '')) <= 40000),
  dealt AS (
    SELECT request, nth, 0 AS page, size AS used FROM files WHERE nth = 1
    UNION ALL SELECT f.request, f.nth, CASE WHEN d.used + f.size > 40000 THEN d.page + 1 ELSE d.page END, CASE WHEN d.used + f.size > 40000 THEN f.size ELSE d.used + f.size END FROM dealt d JOIN files f ON f.request = d.request AND f.nth = d.nth + 1
  )
  SELECT request, CAST(page AS BIGINT) AS page, count(*) AS files, '' AS error FROM dealt GROUP BY ALL
  UNION ALL SELECT doc_id // 20, -1, 0, 'file beyond the limit of an answer' FROM documents WHERE strlen(coalesce(text, '')) > 40000""",
    "batch_rejects": """WITH f AS (
    SELECT doc_id // 100 AS request, doc_id AS ord, lang || ['.pdf', '.txt', '.DOCX', '.jpeg', ''][doc_id % 5 + 1] AS name, doc_id % 5 IN (0, 2, 3) AS taken, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS nth, strlen(coalesce(text, '')) AS size FROM documents
  ), s AS (
    SELECT *, sum(CASE WHEN taken AND nth <= 50 THEN size ELSE 0 END) OVER (PARTITION BY request ORDER BY ord) AS so_far FROM f
  )
  SELECT request, ord, name, CASE WHEN nth > 50 THEN 'solo se procesan 50 archivos por lote' WHEN NOT taken THEN 'formato no admitido' WHEN so_far > 60000 THEN 'se superó el límite por lote' ELSE '' END AS reason FROM s""",
    "package_elements": """SELECT doc_id, part, tag, text FROM (
    SELECT doc_id, 'docProps/core.xml' AS part, 'dc:title' AS tag, 'Documento ' || doc_id AS text FROM documents UNION ALL SELECT doc_id, 'docProps/core.xml', 'dc:creator', source FROM documents
    UNION ALL SELECT doc_id, 'docProps/core.xml', 'cp:lastModifiedBy', lang FROM documents UNION ALL SELECT doc_id, 'docProps/app.xml', 'ep:Company', 'Empresa ' || lang FROM documents
    UNION ALL SELECT doc_id, 'docProps/app.xml', 'ep:TotalTime', CAST(doc_id % 100 AS VARCHAR) FROM documents)""",
    "exif_directories": """SELECT doc_id, 'EXIF · directorios' AS grp, 'Número de serie del cuerpo' AS label, source AS value, 'personal' AS sev, false AS keep FROM documents
  UNION ALL SELECT doc_id, 'EXIF · ubicación', 'Coordenadas en grados', printf('%.6f', d90) || ', ' || printf('%.6f', -d180), 'personal', false FROM (
    SELECT doc_id, CAST(doc_id % 90 AS DOUBLE) + CAST(doc_id % 60 AS DOUBLE) / 60 + CAST(doc_id % 6000 AS DOUBLE) / 100 / 3600 AS d90, CAST(doc_id % 180 AS DOUBLE) + CAST(doc_id % 60 AS DOUBLE) / 60 + CAST(doc_id % 6000 AS DOUBLE) / 100 / 3600 AS d180 FROM documents)""",
}

_EXTRA = "'Excel · datos externos'"
ORACLE |= {
    "office_extra_findings": f"""SELECT doc_id, 'Propiedades personalizadas' AS grp, 'Cliente' AS label, source AS value, 'personal' AS sev, false AS keep FROM documents
  UNION ALL SELECT doc_id, {_EXTRA}, 'Tabla dinámica con origen externo', 'Fuente ' || doc_id, 'media', true FROM documents WHERE doc_id % 3 = 1
  UNION ALL SELECT doc_id, {_PEOPLE}, source, 'AD ' || doc_id, 'personal', false FROM documents WHERE doc_id % 3 IN (1, 2)""",
    "office_extra_signals": "SELECT doc_id, 'medio' AS nivel, 'Tabla dinámica con origen externo' AS titulo FROM documents WHERE doc_id % 3 = 1",
    "office_settled_violations": "SELECT doc_id, 'word/document.xml' AS part, 'text differs' AS problem, 'reject, checked as accept' AS which FROM documents WHERE doc_id % 3 = 0",
    "profile_findings": """SELECT doc_id, 'Perfil de color' AS grp, 'Perfil ICC incrustado' AS label, (strlen(source) + 14) || ' bytes (se conserva)' AS value, 'baja' AS sev, false AS keep FROM documents
  UNION ALL SELECT doc_id, 'IPTC (Photoshop)', 'Autor (byline)', source, 'personal', false FROM documents""",
    "ole_marks": "SELECT doc_id, 2 - doc_id % 2 AS present, 1 + doc_id % 2 AS absent, 'ole' AS kind FROM documents",
    "pdf_chains": "SELECT doc_id, num, type, version FROM documents, (VALUES (1, 'Catalog', ''), (2, 'Pages', ''), (3, 'Page', 'new'), (4, '', ''), (5, 'ObjStm', ''), (6, 'XRef', ''), (7, '', '')) o(num, type, version)",
    "pdf_chain_findings": """SELECT doc_id, grp, label, coalesce(value, source) AS value, sev, keep FROM documents, (VALUES
    ('Estructura', 'Objetos en el archivo', '7', 'baja', false), ('Estructura', 'Páginas', '1', 'baja', false), ('Estructura', 'Versiones anteriores dentro del archivo', '2 actualizaciones incrementales en el mismo archivo', 'personal', true),
    ('Propiedades del documento', 'Diccionario /Info', 'presente', 'baja', false), ('Propiedades del documento', 'Autor', NULL, 'personal', false)) f(grp, label, value, sev, keep)""",
    "pdf_chain_clean": "SELECT doc_id, '' AS error, CAST(4 AS BIGINT) AS objects, true AS new, false AS old FROM documents",
    "clean_report_media": """SELECT 2 * doc_id + k AS file_id, CASE k WHEN 0 THEN 'image' ELSE 'pdf' END AS kind, CASE WHEN k = 1 THEN 'PDF' ELSE ['JPEG', 'PNG', 'WEBP'][doc_id % 3 + 1] END AS format,
  CASE WHEN k = 1 AND doc_id % 11 = 0 THEN '' ELSE 'm' || (2 * doc_id + k) || ' - sin metadatos' END AS output_name,
  CASE WHEN k = 0 THEN 'EXIF: 3 campos eliminados (cámara, objetivos, fechas, software, autor); Coordenadas GPS eliminadas (1 campos); ' || CASE WHEN doc_id % 3 <> 1 THEN 'XMP eliminado (autor, derechos, lugar); ' ELSE '' END
      || CASE WHEN doc_id % 3 = 0 THEN 'Comentario guardado en el archivo, eliminado; ' WHEN doc_id % 3 = 1 THEN '1 chunks de texto del PNG eliminados (autor, descripción, fecha); ' ELSE '' END || 'Orientación 6 conservada para que la foto no salga girada; La imagen NO se recodifica: los píxeles son idénticos al original'
    WHEN doc_id % 11 = 0 THEN '' ELSE CASE WHEN doc_id % 5 = 0 THEN '1 actualización(es) incremental(es) descartadas; ' ELSE '' END || (CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 3 END) || ' objeto(s) descartados: metadatos, estructura y restos de versiones anteriores; /Info fuera: autor, título, asunto, palabras clave, programas y fechas; Los flujos de contenido se copian sin recomprimir: la imagen no cambia' END AS removed,
  CASE WHEN k = 1 AND doc_id % 11 = 0 THEN 'encrypted' ELSE '' END AS error FROM documents, range(2) r(k)""",
}
ORACLE["pdf_annotations"] = "SELECT doc_id, 'Anotaciones' AS grp, 'Comentarios y anotaciones' AS label, CAST(doc_id % 4 AS VARCHAR) AS value, 'media' AS sev, true AS keep FROM documents WHERE doc_id % 4 > 0"
