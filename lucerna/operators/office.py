"""Office packages: findings from parts and XML nodes, cleaning of parts, and verification of the result.

Everything is DataFrame work over two tables of :mod:`lucerna.sources.packages`: ``parts`` (one row for
each entry) and ``nodes`` (one row for each element with attributes or text).  Both are meant to be
materialised once, since every group of findings reads them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions import names
from lucerna.operators import office_parts
from lucerna.operators.office_parts import COMMENTS, EMPTY_CORE, MINIMAL_APP, PERSONS, REVISION_PARTS
from lucerna.operators.summaries import first_few
from lucerna.sources.packages import MANY_BYTES, NODE, NODES
from lucerna.sources.shared import in_slices, lean, sliced_by_bytes, write_shared

# Part names and patterns, field labels and severities, revision tags.
FOLDERS = {"word": "Word", "xl": "Excel", "ppt": "PowerPoint"}
MACROS = r"(^|/)(vbaProject(Signature)?\.bin|vbaData\.xml)$"
THUMBNAIL, PRINTERS, REVISION_LOG = r"^docProps/thumbnail\.", "^xl/printerSettings/", "^xl/revisions/"
EXTERNAL = r"^https?:|^[A-Za-z]:|^\\\\|^/"
CORE = [
    ("dc:title", "Título", "media"), ("dc:subject", "Asunto", "media"), ("dc:creator", "Autor", "personal"), ("cp:keywords", "Palabras clave", "media"),
    ("dc:description", "Comentarios", "media"), ("cp:lastModifiedBy", "Última persona que guardó", "personal"), ("cp:revision", "Número de revisión", "media"),
    ("dcterms:created", "Creado", "media"), ("dcterms:modified", "Modificado", "media"), ("cp:category", "Categoría", "media"),
    ("cp:contentStatus", "Estado del contenido", "baja"), ("cp:lastPrinted", "Última impresión", "media"), ("cp:version", "Versión", "baja"),
]
APP = [
    ("ep:Template", "Plantilla", "media"), ("ep:TotalTime", "Tiempo de edición", "media"), ("ep:Company", "Empresa", "personal"), ("ep:Manager", "Responsable", "personal"),
    ("ep:HyperlinkBase", "Ruta base de hipervínculos", "personal"), ("ep:Application", "Aplicación", "baja"), ("ep:AppVersion", "Versión de la aplicación", "baja"),
    ("ep:Pages", "Páginas", "baja"), ("ep:Words", "Palabras", "baja"), ("ep:Characters", "Caracteres", "baja"), ("ep:Paragraphs", "Párrafos", "baja"), ("ep:Slides", "Diapositivas", "baja"),
]
REVISIONS = {
    "ins": "Inserciones", "del": "Borrados", "moveFrom": "Movimientos (origen)", "moveTo": "Movimientos (destino)", "pPrChange": "Cambios de formato de párrafo",
    "rPrChange": "Cambios de formato de texto", "tblPrChange": "Cambios de formato de tabla", "trPrChange": "Cambios de formato de fila", "tcPrChange": "Cambios de formato de celda",
    "cellIns": "Celdas insertadas", "cellDel": "Celdas borradas",
}
OTHER_REVISIONS = "cellMerge sectPrChange numberingChange tblGridChange customXmlInsRangeStart customXmlInsRangeEnd customXmlDelRangeStart customXmlDelRangeEnd moveFromRangeStart moveFromRangeEnd moveToRangeStart moveToRangeEnd".split()
SECRET_ATTRIBUTES = ("connection", "command", "password", "user", "uid", "pwd")
SHOWN_STRINGS, SHOWN_CHARACTERS = 4, 140


class Finding(NamedTuple):
    """A rule of findings: where it holds and what it shows; everything but the value is usually fixed."""

    condition: Column
    grp: str
    label: Column | str
    value: Column
    sev: str
    keep: bool


def rule(condition: Column, grp: str, label: Column | str, value: Column, sev: str, *, keep: bool = False) -> Finding:
    return Finding(condition, grp, label, value, sev, keep)


def findings_of(rows: DataFrame, rules: list[Finding]) -> DataFrame:
    """The findings of all rules in one pass over ``rows``: doc_id, grp, label, value, sev, keep.  Empty values are none.

    Only values (and the few labels that depend on a row) are worked out for each row; what is fixed for a
    rule is looked up by its place, so the generated code stays small.
    """
    own = [r.label for r in rules if not isinstance(r.label, str)]
    values = F.array(*(F.when(r.condition, r.value.cast("string")) for r in rules))
    told = rows.select("doc_id", F.posexplode(values).alias("at", "value"), *(x.alias(f"__label{i}") for i, x in enumerate(own))).withColumn("value", F.trim("value")).filter("value <> ''")
    of = lambda items: F.get(F.array(*map(F.lit, items)), F.col("at"))
    label = of([r.label if isinstance(r.label, str) else "" for r in rules])
    places = [i for i, r in enumerate(rules) if not isinstance(r.label, str)]
    for k, i in enumerate(places):
        label = F.when(F.col("at") == i, F.col(f"__label{k}")).otherwise(label)
    return told.select("doc_id", of([r.grp for r in rules]).alias("grp"), label.alias("label"), "value", of([r.sev for r in rules]).alias("sev"), of([r.keep for r in rules]).alias("keep"))


def folder_format(folder: Column) -> Column:
    label = F.lit(None).cast("string")
    for f, text in FOLDERS.items():
        label = F.when(folder == f, F.lit(text)).otherwise(label)
    return label


def formats(parts: DataFrame) -> DataFrame:
    """doc_id, format and parts: the format of the first entry, in package order, below a known folder."""
    folder = F.regexp_extract("name", "^(word|xl|ppt)/", 1)
    first = F.min(F.when(folder != "", F.struct("ord", folder.alias("f"))))["f"]
    return parts.filter(F.col("name").isNotNull()).groupBy("doc_id").agg(first.alias("f"), F.count("*").alias("n")).select("doc_id", folder_format(F.col("f")).alias("format"), F.col("n").alias("parts"))


def _part_findings(parts: DataFrame) -> DataFrame:
    """What part names and stamps tell: one aggregate over the parts, one row for each package."""
    name, folder = F.col("name"), F.regexp_extract("name", "^(word|xl|ppt)/", 1)
    count = lambda pattern: F.count_if(name.rlike(pattern))
    per = parts.groupBy("doc_id").agg(
        F.min(F.when(folder != "", F.struct("ord", folder.alias("f"))))["f"].alias("folder"),
        F.count("*").alias("parts"),
        count("^xl/connections[.]xml$").alias("connections"),
        count(PRINTERS).alias("printers"),
        count(REVISION_LOG).alias("log"),
        count(r"^ppt/notesSlides/notesSlide\d*\.xml$").alias("notes"),
        count(THUMBNAIL).alias("thumbnails"),
        count(MACROS).alias("macros"),
        F.array_sort(F.collect_set(names.packed_stamp(F.col("time"), F.col("date")))).alias("stamps"),
        F.array_sort(F.collect_set(F.when(F.contains("name", F.lit("_xmlsignatures/")), name))).alias("signatures"),
    )
    c, external, inside = F.col, "Excel · datos externos", "Contenido incrustado"
    several = lambda n, what: F.concat(c(n).cast("string"), F.lit(what))
    rules = [
        rule(F.lit(True), "Archivo", "Tipo detectado", F.concat(folder_format(c("folder")), F.lit(" · "), c("parts").cast("string"), F.lit(" partes")), "baja"),
        rule(c("connections") > 0, external, "Conexiones a bases de datos", several("connections", " (cadena de conexión)"), "personal"),
        rule(c("printers") > 0, external, "Configuración de impresora guardada", several("printers", " parte(s)"), "media"),
        rule(c("log") > 0, external, "Registro de revisiones (libro compartido)", several("log", " parte(s) con usuarios y valores anteriores"), "personal", keep=True),
        rule(c("notes") > 0, "PowerPoint · notas", "Diapositivas con notas del orador", c("notes"), "media", keep=True),
        rule(c("thumbnails") > 0, "Miniatura y adjuntos", "Miniatura incrustada (vista previa guardada)", F.lit("puede mostrar una versión anterior del contenido"), "media"),
        rule(c("macros") > 0, inside, "Macros (vbaProject.bin)", F.lit("presentes"), "personal"),
        rule(F.lit(True), "Paquete ZIP", "Fechas internas de cada archivo", first_few(c("stamps")), "baja"),
    ]
    signed = per.select("doc_id", F.explode("signatures").alias("name"))
    return findings_of(per, rules).unionByName(findings_of(signed, [rule(F.lit(True), inside, "Firma digital (se conserva: retirarla invalida el archivo)", name, "media", keep=True)]))


def marks(nodes: DataFrame) -> DataFrame:
    """Nodes that some rule needs, found in one pass: doc_id, at, rule, key, label, value, w.

    ``key`` tells rows of a rule apart that are findings of their own; ``w`` is what a row counts.
    """
    tag, part, text, attrs = F.col("tag"), F.col("part"), F.trim("text"), F.col("attrs")
    node = F.concat(part, F.lit("#"), F.col("node").cast("string"))
    none = F.lit(None).cast("string")
    local = lambda k: F.substring_index(k, ":", -1)

    def mark(when: Column, name: str, *, key: Column | None = None, label: Column | None = None, value: Column | None = None, w: Column | None = None) -> Column:
        fields = (F.lit(name).alias("rule"), (F.lit("") if key is None else key).alias("key"), (none if label is None else label).alias("label"), (none if value is None else value).alias("value"), (F.lit(1) if w is None else w).cast("long").alias("w"))
        return F.when(when, F.struct(*fields))

    a = lambda k: F.coalesce(attrs[f"w15:{k}"], attrs[k], F.lit(""))
    author = F.coalesce(attrs["w15:author"], F.lit(""))
    person = (author != "") | tag.endswith(":person") | (tag == "person") | (a("userId") != "") | (a("providerId") != "")
    account = F.array_join(F.filter(F.array(a("providerId"), a("userId")), lambda x: x != ""), " ")
    commenter = F.when(tag == "w:comment", attrs["w:author"]).when(tag == "ss:author", text).when(tag == "p:cmAuthor", attrs["name"])
    in_comments, in_revised, in_book = part.rlike(COMMENTS), part.rlike(REVISION_PARTS), part == "xl/workbook.xml"
    cache, custom = part.rlike(r"^xl/pivotCache/pivotCacheDefinition\d*\.xml$"), part == "docProps/custom.xml"
    is_property = tag == "op:property"
    revision = F.regexp_extract("tag", "^w:(.*)$", 1)
    keys = F.map_keys(attrs)
    having = lambda f: F.size(F.filter(keys, f))
    rsid, para = having(lambda k: F.lower(local(k)).startswith("rsid")), having(lambda k: local(k).isin("paraId", "paraIdParent", "textId"))
    docid = having(lambda k: local(k) == "docId") + tag.isin("w14:docId", "w15:docId").cast("int")
    xml = part.endswith(".xml")
    secret = F.filter(F.map_entries(attrs), lambda e: F.lower(local(e["key"])).isin(*SECRET_ATTRIBUTES) & (F.char_length(e["value"]) > 1))
    singles = F.array(
        mark((part == "docProps/core.xml") & tag.isin(*(t for t, _, _ in CORE)), "core", key=tag, value=text),
        mark((part == "docProps/app.xml") & tag.isin(*(t for t, _, _ in APP)), "app", key=tag, value=text),
        mark(custom & is_property, "custom", key=F.col("node").cast("string"), label=F.coalesce(attrs["name"], F.lit("(sin nombre)"))),
        mark(custom & ~is_property & (F.col("parent") > 0), "custom", key=F.col("parent").cast("string"), value=text),
        mark(part.rlike(PERSONS) & person, "person", key=node, label=F.when(author != "", author).when(a("displayName") != "", a("displayName")).otherwise("(sin nombre)"), value=F.when(account == "", "(sin identificador)").otherwise(account)),
        mark(in_comments & tag.isin("w:comment", "tc:threadedComment"), "comments"),
        mark(in_comments & (F.coalesce(F.trim(commenter), F.lit("")) != ""), "commenters", key=commenter, value=commenter),
        mark(part.startswith("xl/externalLinks/_rels/") & attrs["Target"].rlike(EXTERNAL), "link", key=node, value=attrs["Target"]),
        mark(in_book & (tag == "ss:sheet") & attrs["state"].isin("hidden", "veryHidden"), "sheets", key=attrs["state"], value=attrs["state"]),
        mark(in_book & (tag == "ss:definedName") & F.contains("text", F.lit("[")), "defined", key=node, value=attrs["name"]),
        mark(cache & (tag == "ss:cacheSource") & (attrs["type"] == "external"), "pivot", key=part, label=F.lit("external")),
        mark(cache & (tag == "ss:worksheetSource"), "pivot", key=part, value=F.coalesce(attrs["name"], attrs["ref"])),
        mark(in_revised & revision.isin(*REVISIONS, *OTHER_REVISIONS), "revision", key=revision),
        mark(in_revised & (attrs["w:author"] != ""), "authors", key=attrs["w:author"], value=attrs["w:author"]),
        mark(in_revised & (attrs["w:date"] != ""), "dates", value=attrs["w:date"]),
        mark(xml & (rsid > 0), "rsid", w=rsid),
        mark(xml & (para > 0), "para", w=para),
        mark(xml & (docid > 0), "docid", w=docid),
    )
    strings = F.when(part == "xl/connections.xml", F.transform(secret, lambda e: F.struct(F.lit("strings").alias("rule"), F.concat(node, F.lit("@"), e["key"]).alias("key"), none.alias("label"), F.left(e["value"], F.lit(SHOWN_CHARACTERS)).alias("value"), F.lit(1).cast("long").alias("w"))))
    found = nodes.select("doc_id", F.struct("part", "node").alias("at"), singles.alias("singles"), strings.alias("strings"))
    every = F.when(F.col("strings").isNull(), F.array_compact("singles")).otherwise(F.concat(F.array_compact("singles"), "strings"))
    return found.select("doc_id", "at", F.explode(every).alias("m")).select("doc_id", "at", "m.*")


#: Rules whose rows become one finding with a list of values.
LISTED = ("commenters", "authors", "defined", "strings", "sheets")


def _node_findings(nodes: DataFrame) -> DataFrame:
    """Findings from marks: one aggregate by rule and key, and a small second one for lists.

    The first is written, so nodes are looked through once: a filter for the lists would go below it and repeat it.
    """
    per = marks(nodes).groupBy("doc_id", "rule", "key").agg(
        F.sum("w").alias("n"), F.min("at").alias("at"), F.max("label").alias("label"), F.min_by("value", F.when(F.col("value").isNotNull(), F.col("at"))).alias("value"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    per = write_shared(per, "office-marks")[0]
    c, is_rule = F.col, lambda name: F.col("rule") == name
    one_of = lambda fields: lambda col: [F.when(c("key") == t, F.lit(x[col])) for t, *x in fields]
    core, app = one_of(CORE), one_of(APP)
    minutes = F.when((c("key") == "ep:TotalTime") & (c("value") != ""), F.concat(c("value"), F.lit(" minutos"))).otherwise(c("value"))
    sev = lambda fields, level: c("key").isin(*(t for t, _, s in fields if s == level))
    label = lambda fields: F.coalesce(*fields(0))
    tag = F.coalesce(*(F.when(c("key") == t, F.lit(x)) for t, x in REVISIONS.items()), c("key"))
    changes, traces, external = "Control de cambios", "Rastros técnicos de edición", "Excel · datos externos"
    rules = [
        *(rule(is_rule("core") & sev(CORE, s), "Propiedades del documento", label(core), c("value"), s) for s in ("personal", "media", "baja")),
        *(rule(is_rule("app") & sev(APP, s), "Propiedades de la aplicación", label(app), minutes, s) for s in ("personal", "media", "baja")),
        rule(is_rule("custom") & c("label").isNotNull(), "Propiedades personalizadas", c("label"), c("value"), "personal"),
        rule(is_rule("person"), "Personas con cuenta vinculada", c("label"), c("value"), "personal"),
        rule(is_rule("comments"), "Comentarios", "Comentarios en el documento", c("n"), "media"),
        rule(is_rule("link"), external, "Enlace a otro libro", c("value"), "personal", keep=True),
        rule(is_rule("pivot") & (c("label") == "external"), external, "Tabla dinámica con origen externo", F.coalesce("value", F.lit("(sin nombre)")), "media", keep=True),
        rule(is_rule("revision"), changes, tag, c("n"), "edicion"),
        rule(is_rule("dates"), changes, "Fechas registradas", F.concat(c("n").cast("string"), F.lit(" marcas entre "), c("lo"), F.lit(" y "), c("hi")), "edicion"),
        rule(is_rule("rsid"), traces, "Identificadores rsid (sesiones de edición)", c("n"), "baja"),
        rule(is_rule("para"), traces, "Identificadores de párrafo/texto", c("n"), "baja"),
        rule(is_rule("docid"), traces, "Identificador persistente del documento (docId)", c("n"), "media"),
    ]
    lists = per.filter(c("rule").isin(*LISTED)).groupBy("doc_id", "rule").agg(F.sort_array(F.collect_list(F.struct("at", "key", "value", "n"))).alias("l"))
    values = F.transform("l", lambda x: x["value"])
    joined = F.array_join(values, ", ")
    hidden = lambda state: F.aggregate(F.filter("l", lambda x: x["key"] == state), F.lit(0).cast("long"), lambda t, x: t + x["n"]).cast("string")
    list_rules = [
        rule(is_rule("commenters"), "Comentarios", "Autores de los comentarios", joined, "personal"),
        rule(is_rule("authors"), changes, "Autores registrados", joined, "personal"),
        rule(is_rule("defined"), external, "Nombres definidos apuntando a otros archivos", joined, "media", keep=True),
        rule(is_rule("sheets"), "Excel · hojas ocultas", "Hojas ocultas", F.concat(hidden("hidden"), F.lit(" oculta(s), "), hidden("veryHidden"), F.lit(" muy oculta(s)")), "media", keep=True),
        *(rule(is_rule("strings"), external, "Cadena de conexión", F.get(values, F.lit(k)), "personal") for k in range(SHOWN_STRINGS)),
    ]
    return findings_of(per, rules).unionByName(findings_of(lists, list_rules))


def office_findings(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """All findings of packages: doc_id, grp, label, value, sev, keep."""
    return _part_findings(parts.filter(F.col("name").isNotNull())).unionByName(_node_findings(nodes.filter(F.col("tag").isNotNull())))


# Cleaning ------------------------------------------------------------------

#: Options and their defaults.
OPTIONS = {"changes": "keep", "comments": "anonymize", "custom_props": True, "macros": False, "connections": True}
CHANGES, COMMENT_MODES = ("keep", "accept", "reject"), ("keep", "anonymize", "delete")


def checked(options: dict[str, object]) -> dict[str, object]:
    """Options with defaults; ValueError on an unknown key or a wrong value."""
    for key, value in options.items():
        if key not in OPTIONS:
            raise ValueError(f"unknown option {key}")
        if isinstance(OPTIONS[key], bool) != isinstance(value, bool):
            raise ValueError(f"wrong value for {key}")
    out = OPTIONS | options
    if out["changes"] not in CHANGES or out["comments"] not in COMMENT_MODES:
        raise ValueError("wrong value for changes or comments")
    return out


def dropped(name: Column, options: dict[str, object]) -> Column:
    """Whether a part goes altogether."""
    gone = name.rlike(THUMBNAIL) | name.rlike(PRINTERS)
    if options["macros"]:
        gone = gone | name.rlike(MACROS)
    if options["custom_props"]:
        gone = gone | (name == "docProps/custom.xml")
    if options["connections"]:
        gone = gone | (name == "xl/connections.xml")
    if options["comments"] == "delete":
        gone = gone | name.rlike(r"^word/comments(Extended|Ids|Extensible)?\.xml$")
    return gone


#: Parts that become Python objects at once, unless they are long.
MANY_PARTS = 256
CLEANED = "doc_id long, ord int, name string, data binary, stats map<string,int>, error string"
_CLEANED = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.int32()), pa.string()]


def clean_parts(parts: DataFrame, **options: object) -> DataFrame:
    """Parts that stay, rewritten: no names, dates, accounts or technical ids; references to dropped parts go too.

    Rewriting goes by namespace and local name, whatever prefixes and quotes a part uses, and leaves every
    byte that it does not have to change.  Columns: doc_id, ord, name, data, stats (what was counted) and
    error, for an XML part that cannot be read; its data is null.
    """
    o = checked(options)
    name = F.col("name")
    # A window, not a join: what the parts are made of is worked out once.
    gone = F.collect_set(F.when(dropped(name, o), name)).over(Window.partitionBy("doc_id"))
    marked = parts.filter(name.isNotNull()).select("doc_id", "ord", "name", "data", gone.alias("gone"))
    kept = marked.filter(~dropped(name, o)).select("doc_id", "ord", "name", "data", "gone")

    def one(name: str, data: bytes | None, gone: list[str]) -> tuple[bytes | None, list[tuple[str, int]], str | None]:
        if not name.endswith((".xml", ".rels")):
            return data, [], None
        try:
            made, stats = office_parts.rewrite(name, data or b"", set(gone), o)
        except (ValueError, expat.ExpatError) as x:
            return None, [], f"{name}: {type(x).__name__}: {x}"
        return made, list(stats.items()), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced_by_bytes(batches, 3, MANY_PARTS, MANY_BYTES):
            made = [one(*x) for x in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array([m[k] for m in made], _CLEANED[3 + k]) for k in range(3))], [x.split()[0] for x in CLEANED.split(", ")])

    return kept.mapInArrow(lean(run), CLEANED)


# Verification --------------------------------------------------------------

def visible_text(data: Column) -> Column:
    """The text runs of a part, in order."""
    return F.array_join(F.regexp_extract_all(data.cast("string"), F.lit(r"<(?:w|a):t(?:\s[^>]*)?>([^<]*)</"), F.lit(1)), "")


def told_text(data: Column, mode: str | None) -> Column:
    """The text of a part as an independent reader tells it: all of it, or what is seen when changes are settled."""

    def told(parts: pa.Array) -> pa.Array:
        return pa.array([office_parts.told_text(parts[i].as_py(), mode) for i in range(len(parts))], pa.string())

    return in_slices(told, "string")(data)


def residue(part: Column, tag: Column, attrs: Column, text: Column, options: dict[str, object]) -> Column:
    """Names, dates, accounts and technical ids that an element keeps, as problems, by namespace and local name.

    The element comes from another reader than the cleaner's.
    """
    keys = F.map_keys(attrs)
    local = lambda k: F.substring_index(k, ":", -1)
    filled = lambda name: F.coalesce(attrs[name], F.lit("")) != ""
    some = lambda test: F.exists(keys, test)
    revised, commented = part.rlike(REVISION_PARTS), part.rlike(COMMENTS) & F.lit(options["comments"] != "keep")
    checks = {
        "author": revised & filled("w:author"),
        "date": revised & attrs["w:date"].isNotNull(),
        "initials": commented & filled("w:initials"),
        "comment author": commented & ((tag == "p:cmAuthor") & (filled("name") | filled("initials")) | (tag == "ss:author") & (F.trim(text) != "")),
        "comment date": commented & ((tag == "tc:threadedComment") & attrs["dT"].isNotNull() | (tag == "p:cm") & attrs["dt"].isNotNull()),
        "account": part.rlike(PERSONS) & some(lambda k: F.lower(local(k)).isin(*office_parts.ACCOUNT) & (F.element_at(attrs, k) != "")),
        "rsid": some(lambda k: F.lower(local(k)).startswith("rsid")) | tag.isin(*office_parts.SESSIONS),
        "paragraph": some(lambda k: local(k).isin(*office_parts.PARAGRAPH_IDS)),
        "document": some(lambda k: local(k) == "docId") | tag.isin(*office_parts.DOCUMENT_IDS),
        "settings": (part == "word/settings.xml") & tag.isin(*office_parts.SETTINGS),
    }
    if options["changes"] != "keep":
        marks = (*office_parts.ADDED, *office_parts.TAKEN, *office_parts.FORMAT_CHANGES, *office_parts.MARKERS, *office_parts.OLD_TEXT)
        checks["change"] = revised & tag.isin(*marks)
    if options["comments"] == "delete":
        checks["comment reference"] = revised & tag.isin(*office_parts.REFERENCES)
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(f"residue: {k}")) for k, c in checks.items())))


def checked_parts(parts: DataFrame, mode: str | None) -> DataFrame:
    """doc_id, name, listed, sha, unread and nodes of (doc_id, name, data, listed): one independent reading of each part.

    ``sha`` is the digest of the text, none where a text is not compared; texts themselves stay in the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced_by_bytes(batches, 2, MANY_PARTS, MANY_BYTES):
            told = [office_parts.checked(x, d, mode) for x, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *(pa.array([t[k] for t in told], x) for k, x in enumerate((pa.string(), pa.bool_(), NODES)))], ["doc_id", "name", "listed", "sha", "unread", "nodes"])

    rows = parts.select(F.col("doc_id").cast("long").alias("doc_id"), "name", "data", "listed")
    return rows.mapInArrow(lean(run), f"doc_id long, name string, listed array<string>, sha string, unread boolean, nodes array<{NODE}>")


def text_digest(name: Column, data: Column, mode: str | None) -> Column:
    """The digest of a part's text as :func:`checked_parts` compares it."""

    def digest(parts: pa.Array, listed: pa.Array) -> pa.Array:
        return pa.array([office_parts.text_digest(x, parts[i].as_py(), mode) for i, x in enumerate(listed.to_pylist())], pa.string())

    return in_slices(digest, "string")(data, name)


def violations(before: DataFrame, after: DataFrame, **options: object) -> DataFrame:
    """What is wrong with cleaned packages: doc_id, part, problem.  Empty means verified.

    Checks: only droppable parts are gone and none is new; every XML part reads; residue; the text of
    surviving parts, as expected for the way changes are treated; content types and relationships that point
    at missing parts; emptied properties; and, where ``after`` has time and date, the entries' stamps.
    """
    return compared(read_originals(before, **options), read_copies(after, **options), **options)


def read_originals(before: DataFrame, **options: object) -> DataFrame:
    """What :func:`compared` needs of the parts as they were; of options, the way changes are treated counts."""
    o = checked(options)
    mode = None if o["changes"] == "keep" else str(o["changes"])
    none, empty, no = F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit(False)
    sha = F.coalesce(text_digest(F.col("name"), F.col("data"), mode), F.lit(""))
    return before.filter(F.col("name").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("in_a"), "name", sha.alias("sha"), no.alias("in_b"), no.alias("unread"), empty.alias("left"), none.alias("by")
    )


def read_copies(after: DataFrame, **options: object) -> DataFrame:
    """What :func:`compared` needs of cleaned parts.  It is the same whether changes were accepted or rejected."""
    o = checked(options)
    c, name, text = F.col, F.col("name"), F.col("data").cast("string")
    mode = None if o["changes"] == "keep" else str(o["changes"])
    own = [F.when((name == "docProps/core.xml") & (text != EMPTY_CORE), "core properties are left").when((name == "docProps/app.xml") & (text != MINIMAL_APP), "application properties are left")]
    if {"time", "date"} <= set(after.columns):
        own.append(F.when((c("time") != 0) | (c("date") != 0x21), "entry has a stamp"))
    # A cleaned part has no changes left, so what is seen in it does not depend on how they would be settled.
    read = checked_parts(after.withColumn("listed", F.array_compact(F.array(*own))), mode and "accept")
    # One row for a part and its first element, and one for each other element.
    rows = read.select("doc_id", "name", "listed", "sha", "unread", F.posexplode_outer("nodes").alias("at", "n")).withColumn("first", F.coalesce("at", F.lit(0)) == 0)
    tag, attrs, none = c("n.tag"), c("n.attrs"), F.lit(None).cast("string")
    ref = (
        F.when(tag == "ct:Override", names.resolve_path(F.lit(""), attrs["PartName"]))
        .when((tag == "rel:Relationship") & ~attrs["TargetMode"].eqNullSafe("External"), names.resolve_path(names.relations_owner(name), attrs["Target"]))
    )
    left = F.concat(F.when(c("first"), c("listed")).otherwise(F.array().cast("array<string>")), F.coalesce(residue(name, tag, attrs, c("n.text"), o), F.array().cast("array<string>")))
    rows = rows.select("doc_id", "name", "sha", "unread", "first", ref.alias("ref"), left.alias("left"))
    empty = F.array().cast("array<string>")
    part = F.when(c("first") | (F.size("left") > 0), F.struct(name.alias("name"), F.when(c("first"), F.coalesce("sha", F.lit(""))).alias("sha"), F.lit(True).alias("in_b"), c("unread").alias("unread"), c("left").alias("left"), none.alias("by")))
    led = F.when(c("ref").isNotNull(), F.struct(c("ref").alias("name"), none.alias("sha"), F.lit(False).alias("in_b"), F.lit(False).alias("unread"), empty.alias("left"), name.alias("by")))
    return rows.select("doc_id", F.explode(F.array_compact(F.array(part, led))).alias("x")).select("doc_id", F.lit(False).alias("in_a"), "x.*")


def compared(was: DataFrame, told: DataFrame, **options: object) -> DataFrame:
    """What :func:`violations` tells, of :func:`read_originals` and :func:`read_copies`."""
    o, c, name = checked(options), F.col, F.col("name")
    # Parts of both sides and what points at them meet under the part's name, in one shuffle.
    both = was.unionByName(told).groupBy("doc_id", "name").agg(
        F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"), F.bool_or("unread").alias("unread"), F.size(F.collect_set("sha")).alias("texts"),
        F.array_distinct(F.flatten(F.collect_list("left"))).alias("left"), F.collect_set("by").alias("by"),
    )
    problem = (
        F.when(c("in_a") & ~c("in_b") & ~dropped(name, o), "part is missing")
        .when(~c("in_a") & c("in_b"), "part is new")
        .when(c("unread"), "part cannot be read")
        .when(c("in_a") & c("in_b") & (c("texts") > 1), "text differs")
    )
    found = lambda part, text: F.struct(part.alias("part"), text.alias("problem"))
    dead = F.when(~c("in_b"), F.transform("by", lambda x: found(x, F.concat(F.lit("points at missing "), name))))
    every = F.concat(F.array(found(name, problem)), F.transform("left", lambda x: found(name, x)), F.coalesce(dead, F.array().cast("array<struct<part:string,problem:string>>")))
    return both.select("doc_id", F.explode(every).alias("p")).select("doc_id", "p.part", "p.problem").filter("problem IS NOT NULL")
