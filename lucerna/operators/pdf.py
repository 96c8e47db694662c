"""PDF files: objects and references as rows, findings, reachability, and a rewritten file.

A file is read as Latin-1 text, which keeps every byte.  Of several objects with one number that which
the file's cross-reference chain names wins, in the file or inside a compressed object stream; what no
table names (none, or a damaged one) comes from a scan: the last one in the file, then objects of object
streams, which only fill numbers that are still missing.  Types, references, filters and trailers are
read from the tokens of a dictionary, so strings and comments are never taken for them.  Small helpers
inflate a stream and decode a string; the rest is DataFrame work.  A file that could not be rebuilt
safely is refused with a reason, never damaged.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.operators.office import findings_of, rule
from lucerna.operators.relations import cut_ranges, dangling, gap_fill, latest, reachable_each, shared_table
from lucerna.sources import pdf_tables, pdf_tokens
from lucerna.sources.pdf_objects import HIGHEST, undo_predictor  # noqa: F401
from lucerna.sources.shared import in_slices

# Labels of the information dictionary, keys that leave the catalogue, patterns of findings.
INFO = [
    ("Author", "Autor", "personal"), ("Creator", "Programa que creó el contenido", "media"), ("Producer", "Programa que generó el PDF", "media"), ("Title", "Título", "media"),
    ("Subject", "Asunto", "media"), ("Keywords", "Palabras clave", "media"), ("CreationDate", "Fecha de creación", "media"), ("ModDate", "Fecha de modificación", "media"),
    ("Company", "Empresa", "personal"), ("SourceModified", "Origen modificado", "media"), ("Trapped", "Estado de atrapado", "baja"),
]
CATALOG_DROP = ["Metadata", "Info", "PieceInfo", "OpenAction", "AA", "SpiderInfo"]
XMP = [
    (r"<dc:creator>[\s\S]{0,400}?<rdf:li[^>]*>([^<]{1,80})<", "Autor declarado", "personal"), (r"<xmp:CreatorTool>([^<]{1,80})<", "Herramienta", "media"), (r"<pdf:Producer>([^<]{1,80})<", "Productor", "media"),
    (r"<xmp:CreateDate>([^<]{1,40})<", "Fecha de creación", "media"), (r"<xmp:ModifyDate>([^<]{1,40})<", "Fecha de modificación", "media"), (r"<xmp:MetadataDate>([^<]{1,40})<", "Fecha de metadatos", "media"),
    (r"<photoshop:(?:City|Country|Location)>([^<]{1,60})<", "Lugar declarado", "personal"),
]
ANNOTATIONS = r"/Subtype\s*/(?:Text|FreeText|Highlight|Square|Stamp|Ink|FileAttachment)"
#: Missing numbers in a row that are listed as free; a wider gap begins a new section of the table.
FREE_ROW = 64
FREE = "0000000000 65535 f \n"
HEAD = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"
#: Why a file is refused whose compressed objects cannot be seen: a damaged stream, or one beyond the limit.
UNREAD = "object stream cannot be read"


def latin(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def stripped(text: Column) -> Column:
    """Without white space around it."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def decode_string(raw: str | None) -> str | None:
    """The text of a literal or hexadecimal string with its delimiters."""
    if not raw:
        return None
    if raw[0] == "<":
        digits = "".join(raw[1:-1].split())
        data = bytes.fromhex(digits + "0" * (len(digits) % 2))
    else:
        out, body, i = bytearray(), raw[1:-1].encode("latin-1"), 0
        plain = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
        while i < len(body):
            c = body[i]
            i += 1
            if c == 0x5C and i < len(body):
                c = body[i]
                if 0x30 <= c <= 0x37:
                    k = i
                    while k < min(i + 3, len(body)) and 0x30 <= body[k] <= 0x37:
                        k += 1
                    out.append(int(body[i:k], 8) & 0xFF)
                    i = k
                    continue
                i += 1
                if c in (10, 13):
                    continue
                c = plain.get(c, c)
            out.append(c)
        data = bytes(out)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


_INFO = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))


def info_values(dictionary: Column) -> Column:
    """Keys of an information dictionary that hold a string, and their texts."""

    def read(dictionaries: pa.Array) -> pa.Array:
        out = []
        for d in dictionaries.to_pylist():
            held = pdf_tokens.own(d)
            out.append([{"key": k, "value": decode_string(held[k])} for k, _, _ in INFO if held.get(k, "")[:1] in ("(", "<") and held[k][:2] != "<<"])
        return pa.array(out, _INFO)

    return in_slices(read, "array<struct<key:string,value:string>>")(dictionary)


def scan_objects(files: DataFrame) -> DataFrame:
    """doc_id, num, gen, dict (what precedes a stream), stream (null without one): of each number the object that the table names, or the last."""
    return latest(pdf_tables.read_objects(files), ["doc_id", "num"], ["told", "ord"]).drop("told", "ord")


def read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, trailers) of files, from one pass over them.

    Objects: doc_id, num, gen, dict, stream_at, stream_bytes and stream_sha (null without a stream), type, refs, data
    and unread.  ``type`` and ``refs`` are what the dictionary's tokens say.  ``data`` is what a stream of compressed
    objects or of metadata holds, ``unread`` tells that it could not be had.  Objects inside compressed object streams
    come first where the table names them, else they fill numbers that the scan has not found.  Streams of pages and
    pictures are left in the files, so the table is small beside them.

    Trailers: doc_id and trailer of every file: the newest of its table, else that of a cross-reference stream or the
    last in the file; null without one.
    """
    rows = shared_table(pdf_tables.read_rows(files), "pdf-rows")
    # Both kinds of objects are chosen once and written: the first is where the streams are that the second is read from.
    direct = latest(rows.filter("dict IS NOT NULL").drop("holder", "place", "trailer", "listed"), ["doc_id", "num"], ["told", "ord"]).drop("told", "ord")
    direct = shared_table(direct, "pdf-direct")
    named = rows.filter("holder IS NOT NULL").select("doc_id", "num", "holder", "place", F.lit(True).alias("named"))
    inside = _compressed(direct).join(named.hint("merge"), ["doc_id", "num", "holder", "place"], "left").withColumn("named", F.coalesce("named", F.lit(False)))
    inside = shared_table(latest(inside, ["doc_id", "num"], ["named", "holder", "place"]).drop("holder", "place"), "pdf-inside")
    objects = gap_fill(inside.filter("named").drop("named"), gap_fill(direct, inside.filter("NOT named").drop("named"), ["doc_id", "num"]), ["doc_id", "num"])
    crossed = direct.filter("type = 'XRef'").groupBy("doc_id").agg(F.max_by("dict", "num").alias("crossed"))
    listed = rows.filter("num IS NULL").select("doc_id", "trailer", "listed")
    return objects, listed.join(crossed.hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("trailer", "crossed", "listed").alias("trailer"))


def read_objects(files: DataFrame) -> DataFrame:
    return read(files)[0]


def trailers(files: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """The trailers alone; ``objects`` is not needed any more."""
    return read(files)[1]


def _compressed(objects: DataFrame) -> DataFrame:
    """Objects inside object streams, with their stream and place there: their spans end where the next one starts."""
    first = pdf_tokens.own_entries(F.col("dict"))["First"].try_cast("int")
    streams = objects.filter("type = 'ObjStm' AND data IS NOT NULL").select("doc_id", F.col("num").alias("holder"), latin(F.col("data")).alias("t"), first.alias("first"))
    text = streams.filter("first IS NOT NULL")
    numbers = F.transform(F.regexp_extract_all(F.left("t", F.col("first")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("long"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(numbers) / 2) - 1, F.lit(0))), lambda i: F.struct(i.cast("long").alias("place"), F.get(numbers, (2 * i).cast("int")).alias("num"), F.get(numbers, (2 * i + 1).cast("int")).alias("at")))
    rows = text.select("doc_id", "holder", "t", "first", F.explode(pairs).alias("p")).select("doc_id", "holder", "t", "first", "p.place", "p.num", "p.at").filter("num IS NOT NULL AND at IS NOT NULL")
    end = F.coalesce(F.lead("at").over(Window.partitionBy("doc_id", "holder").orderBy("at", "num")), F.length("t") - F.col("first"))
    rows = rows.withColumn("end", end).select("doc_id", "num", F.lit(0).alias("gen"), stripped(F.substring("t", (F.col("first") + F.col("at") + 1).cast("int"), (F.col("end") - F.col("at")).cast("int"))).alias("dict"), "holder", "place")
    rows = rows.withColumn("x", pdf_tokens.facts(F.col("dict")))
    none = {c: F.lit(None).cast(t) for c, t in (("stream_at", "long"), ("stream_bytes", "long"), ("stream_sha", "binary"), ("data", "binary"))}
    return rows.select("doc_id", "num", "gen", "dict", "x.type", "x.refs", *(x.alias(c) for c, x in none.items()), F.lit(False).alias("unread"), "holder", "place")


def unread(objects: DataFrame) -> DataFrame:
    """doc_id and error of files with a stream of compressed objects that cannot be seen."""
    return objects.filter("unread AND type = 'ObjStm'").select("doc_id", F.lit(UNREAD).alias("error")).distinct()


def references(objects: DataFrame) -> DataFrame:
    """doc_id, src, dst: every reference in an object's value."""
    return objects.select("doc_id", F.col("num").alias("src"), F.explode("refs").alias("dst"))


def dictionary_entries(objects: DataFrame) -> DataFrame:
    """doc_id, num, depth, key, key_start, val_start, val_end, value: every entry of every dictionary."""
    e = objects.select("doc_id", "num", "dict", F.explode(pdf_tokens.entries(F.col("dict"))).alias("e")).select("doc_id", "num", "dict", "e.*")
    return e.withColumn("value", F.substr("dict", F.col("val_start") + 1, F.col("val_end") - F.col("val_start"))).drop("dict")


def names_dictionaries(objects: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id and num of the objects that a catalogue's /Names leads to, references to references included."""
    value = pdf_tokens.own_entries(F.col("dict"))["Names"]
    start = objects.join(roots.hint("merge"), "doc_id").filter("num = root").select("doc_id", pdf_tokens.referred(value).alias("node")).filter("node IS NOT NULL")
    bare = objects.select("doc_id", F.col("num").alias("src"), pdf_tokens.referred(F.col("dict")).alias("dst")).filter("dst IS NOT NULL")
    return reachable_each(bare, start, ["doc_id"]).select("doc_id", F.col("node").alias("num"))


def tree_names(objects: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """doc_id, name, num: what the name tree under ``key`` (JavaScript, EmbeddedFiles, Dests) of a catalogue's names lists.

    The tree is walked through /Kids of any depth, cycles included; ``num`` is the object that a name leads to, null
    where its value stands in the node.
    """
    return trees_names(objects, roots, [key]).drop("tree")


def trees_names(objects: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """doc_id, tree, name, num: :func:`tree_names` of several trees; what they share is read once and written."""
    named = names_dictionaries(objects, roots).withColumn("names", F.lit(True))
    holders = objects.join(roots.hint("merge"), "doc_id").join(named.hint("merge"), ["doc_id", "num"], "left").filter("num = root OR names")
    found = dictionary_entries(holders).filter(F.col("key").isin(*keys)).select("doc_id", F.col("key").alias("tree"), pdf_tokens.referred(F.col("value")).alias("node"), pdf_tokens.tree_node(F.col("value")).alias("x"))
    found = shared_table(found, "tree-roots")
    # A node has one of two keys; in an escaped name at least the mark of an escape stands.
    may = F.contains("dict", F.lit("Kids")) | F.contains("dict", F.lit("Names")) | F.contains("dict", F.lit("#"))
    nodes = shared_table(objects.filter(may).select("doc_id", "num", pdf_tokens.tree_node(F.col("dict")).alias("x")), "tree-nodes")
    starts = found.filter("node IS NOT NULL").select("doc_id", "tree", "node").unionByName(found.select("doc_id", "tree", F.explode("x.kids").alias("node")))
    kids = nodes.select("doc_id", F.col("num").alias("src"), F.explode("x.kids").alias("dst")).join(found.select("doc_id", "tree").distinct().hint("merge"), "doc_id")
    reached = reachable_each(kids, starts, ["doc_id", "tree"]).withColumnRenamed("node", "num")
    leaves = nodes.join(reached.hint("merge"), ["doc_id", "num"]).select("doc_id", "tree", F.explode("x.names").alias("n"))
    leaves = leaves.unionByName(found.select("doc_id", "tree", F.explode("x.names").alias("n")))
    return leaves.select("doc_id", "tree", decoded(F.col("n.name")).alias("name"), "n.num")


def decoded(raw: Column) -> Column:
    """The texts of strings with their delimiters."""
    return in_slices(lambda x: pa.array([decode_string(v) for v in x.to_pylist()], pa.string()), "string")(raw)


def supported(trailer: Column) -> Column:
    return trailer.isNotNull() & ~F.map_contains_key(pdf_tokens.own_entries(trailer), "Encrypt")


def root_of(trailer: Column) -> Column:
    """The number of the catalogue."""
    return pdf_tokens.referred(pdf_tokens.own_entries(trailer)["Root"])


def pdf_findings(files: DataFrame, objects: DataFrame, trailer: DataFrame, *, xmp_chars: int | None = None) -> DataFrame:
    """All findings of PDF files: doc_id, grp, label, value, sev, keep.  Encrypted files show little more than that.

    One pass over the files, one over the objects with one aggregate by file.  ``xmp_chars`` reads so many
    characters of an XMP packet only; by default it is read whole.
    """
    c = F.col
    told = pdf_tokens.own_entries(c("trailer"))
    said = trailer.select("doc_id", c("trailer").isNotNull().alias("found"), told.alias("told"))
    said = said.select("doc_id", "told", (c("found") & ~F.map_contains_key("told", "Encrypt")).alias("readable"))
    text = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("content").alias("size"), latin(F.col("content")).alias("t")).join(said.hint("merge"), "doc_id", "left")
    readable = c("readable")
    known = objects.join(said.hint("merge"), "doc_id", "left")
    is_type = lambda k: F.coalesce(c("type") == k, F.lit(False))
    eofs, notes = F.regexp_count("t", F.lit("%%EOF")), F.regexp_count("t", F.lit(ANNOTATIONS))
    from_files = [
        rule(F.lit(True), "Archivo", "Tipo detectado", F.concat(F.lit("PDF · "), F.round(c("size") / 1024, 0).cast("long").cast("string"), F.lit(" KB")), "baja"),
        rule(eofs > 1, "Estructura", "Versiones anteriores dentro del archivo", F.concat(eofs.cast("string"), F.lit(" actualizaciones incrementales en el mismo archivo")), "personal", keep=True),
        rule(F.map_contains_key("told", "Encrypt"), "Archivo", "PDF cifrado", F.lit("no se puede limpiar sin la contraseña"), "media", keep=True),
        rule(readable & F.map_contains_key("told", "ID"), "Estructura", "Identificador del archivo (/ID)", F.lit("huellas que identifican este archivo concreto"), "media"),
        rule(readable & (notes > 0), "Anotaciones", "Comentarios y anotaciones", notes, "media", keep=True),
        rule(readable & F.contains("t", F.lit("/AcroForm")), "Formularios", "Formulario con campos", F.lit("los valores escritos siguen dentro del archivo"), "media", keep=True),
        rule(readable & c("t").rlike(r"/JavaScript|/OpenAction|/AA\b"), "JavaScript", "Código que puede ejecutarse al abrir el PDF", F.lit("presente"), "personal"),
        rule(readable & F.contains("t", F.lit("/EmbeddedFiles")), "Adjuntos", "Archivos incrustados (/EmbeddedFiles)", F.lit("documentos dentro del PDF"), "personal", keep=True),
    ]
    is_info = readable & (c("num") == pdf_tokens.referred(c("told")["Info"]))
    infos = known.filter(is_info).select("doc_id", F.explode(info_values(c("dict"))).alias("v")).select("doc_id", "v.key", F.left("v.value", F.lit(120)).alias("value"))
    label_of = F.coalesce(*(F.when(c("key") == k, F.lit(label)) for k, label, _ in INFO))
    level = lambda sev: c("key").isin(*(k for k, _, x in INFO if x == sev))
    from_infos = [rule(level(sev), "Propiedades del documento", label_of, c("value"), sev) for sev in ("personal", "media", "baja")]
    from_objects = [
        rule(is_info, "Propiedades del documento", "Diccionario /Info", F.lit("presente"), "baja"),
        rule(readable & is_type("Metadata"), "XMP incrustado", "Paquete XMP", F.lit("presente"), "personal"),
        rule(readable & is_type("Sig"), "Firmas", "Firma digital", F.lit("se invalidará al reescribir el archivo"), "media", keep=True),
        rule(readable & is_type("Filespec"), "Adjuntos", "Archivo incrustado dentro del PDF", F.lit("hay documentos dentro del archivo"), "personal", keep=True),
    ]
    meta = known.filter(readable & is_type("Metadata"))
    packet = F.make_valid_utf8(c("data").cast("string"))
    xmp = meta.select("doc_id", (packet if xmp_chars is None else F.left(packet, F.lit(xmp_chars))).alias("x"))
    counts = known.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(readable & is_type("Page")).alias("pages"))
    every = [
        findings_of(text, from_files),
        findings_of(known, from_objects),
        findings_of(infos, from_infos),
        findings_of(xmp, [rule(F.lit(True), "XMP incrustado", label, F.regexp_extract("x", pattern, 1), sev) for pattern, label, sev in XMP]),
        findings_of(counts, [rule(F.lit(True), "Estructura", "Objetos en el archivo", c("n"), "baja"), rule(c("pages") > 0, "Estructura", "Páginas", c("pages"), "baja")]),
    ]
    return reduce(DataFrame.unionByName, every)


def _put_together(content: pa.Array, pieces: pa.Array, tail: pa.Array) -> pa.Array:
    """For each file the header, its pieces (head, and a stream by place and length in the old file), and the tail."""
    out = []
    for raw, own, end in zip(content, pieces, tail.to_pylist(), strict=True):
        if end is None:
            out.append(None)
            continue
        old, held = memoryview(raw.as_py()), [HEAD]
        for x in own.as_py():
            held.append(x["head"].encode("latin-1"))
            if x["stream_at"] is not None:
                held += [b"\nstream\n", old[x["stream_at"] : x["stream_at"] + x["stream_bytes"]], b"\nendstream"]
            held.append(b"\nendobj\n")
        out.append(b"".join([*held, end.encode("latin-1")]))
    return pa.array(out, pa.binary())


def _rewritten(kept: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, n and content: objects in the order of their numbers, a table in sections, and a trailer.

    Offsets are a window sum of lengths and each row makes its own lines of the table; streams are copied from the
    old file by their places when a file's pieces are joined, once.
    """
    head = F.concat(F.col("num").cast("string"), F.lit(" "), F.col("gen").cast("string"), F.lit(" obj\n"), F.col("dict"))
    size = F.char_length("head") + F.when(F.col("stream_at").isNotNull(), F.col("stream_bytes") + len("\nstream\n\nendstream")).otherwise(0) + len("\nendobj\n")
    in_order = Window.partitionBy("doc_id").orderBy("num")
    placed = kept.select("doc_id", "num", "gen", "root", head.alias("head"), "stream_at", "stream_bytes").withColumn("bytes", size)
    placed = placed.withColumn("at", F.coalesce(F.sum("bytes").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + len(HEAD))
    # A wide gap begins a section; in a section, numbers in between are listed as free.
    placed = placed.withColumn("gap", F.col("num") - F.coalesce(F.lag("num").over(in_order), F.lit(0)) - 1).withColumn("first", F.lag("num").over(in_order).isNull())
    placed = placed.withColumn("begins", F.col("gap") >= FREE_ROW).withColumn("section", F.sum((F.col("gap") >= FREE_ROW).cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    high = F.max("num").over(Window.partitionBy("doc_id", "section"))
    headed = lambda low: F.concat(low.cast("string"), F.lit(" "), (high - low + 1).cast("string"), F.lit("\n"))
    top = F.when(F.col("first"), F.when(F.col("begins"), "0 1\n").otherwise(headed(F.lit(0)))).otherwise("")
    zero = F.when(F.col("first"), F.lit(FREE)).otherwise("")
    between = F.when(F.col("begins"), headed(F.col("num"))).otherwise(F.repeat(F.lit(FREE), F.col("gap").cast("int")))
    line = F.concat(top, zero, between, F.format_string("%010d %05d n \n", "at", "gen"))
    lined = placed.select("doc_id", "num", "root", "bytes", "head", "stream_at", "stream_bytes", line.alias("line"))
    made = lined.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("num", "line", "head", "stream_at", "stream_bytes"))).alias("l"), F.first("root").alias("root"), F.max("num").alias("last"), F.sum("bytes").alias("bytes"))
    table = F.array_join(F.transform("l", lambda x: x["line"]), "")
    tail = F.concat(F.lit("xref\n"), table, F.lit("trailer\n<< /Size "), (F.col("last") + 1).cast("string"), F.lit(" /Root "), F.col("root").cast("string"), F.lit(" 0 R >>\nstartxref\n"), (F.col("bytes") + len(HEAD)).cast("string"), F.lit("\n%%EOF\n"))
    pieces = F.transform("l", lambda x: F.struct(x["head"].alias("head"), x["stream_at"].alias("stream_at"), x["stream_bytes"].alias("stream_bytes")))
    made = made.select("doc_id", F.size("l").alias("n"), pieces.alias("pieces"), tail.alias("tail"))
    both = made.hint("merge").join(files.select(F.col("doc_id").cast("long").alias("doc_id"), "content"), "doc_id")
    return both.select("doc_id", "n", in_slices(_put_together, "binary")("content", "pieces", "tail").alias("content"))


def without_entries(objects: DataFrame, roots: DataFrame, keys: list[str], *, deep: bool) -> DataFrame:
    """Objects whose dictionaries lack what cleaning takes out; references are those that are left.

    From the catalogue go its own ``keys``; from it and from the names dictionaries that it leads to goes
    /JavaScript with all that hangs on it.  ``deep`` takes actions, script and metadata from every object.
    """
    named = names_dictionaries(objects.drop("root"), roots).withColumn("names", F.lit(True))
    marked = objects.join(named.hint("merge"), ["doc_id", "num"], "left")
    is_root = F.col("num") == F.col("root")
    # Other objects are read only where one of the words stands that a deep cleaning looks for, or the mark of an escaped name.
    may = reduce(Column.__or__, (F.contains("dict", F.lit(x)) for x in ("AA", "Metadata", "PieceInfo", "JS", "JavaScript", "#")))
    touched = marked.filter(is_root | F.col("names") | may if deep else is_root | F.col("names"))
    entries = touched.filter(F.col("dict").contains("/")).select("doc_id", "num", "root", "names", "dict", F.explode(pdf_tokens.entries(F.col("dict"))).alias("e")).select("doc_id", "num", "root", "names", "dict", "e.*")
    entries = entries.withColumn("value", F.substr("dict", F.col("val_start") + 1, F.col("val_end") - F.col("val_start")))
    from_catalogue = (is_root & (F.col("depth") == 1) & F.col("key").isin(*keys)) | ((is_root | F.col("names")) & (F.col("key") == "JavaScript"))
    script = F.col("key").isin("A", "Next", "OpenAction") & F.col("value").rlike(r"/S\s*/JavaScript(?![A-Za-z])")
    gone = entries.filter(from_catalogue | (F.col("key").isin("AA", "Metadata", "PieceInfo", "JS") | script) if deep else from_catalogue)
    gone = shared_table(gone.select("doc_id", "num", "key_start", "val_end"), "cut-entries")
    lose = objects.select("doc_id", "num", "dict").join(gone.select("doc_id", "num").distinct().hint("merge"), ["doc_id", "num"], "left_semi")
    cut = cut_ranges(lose, gone, ["doc_id", "num"], "dict", "key_start", "val_end")
    cut = cut.select("doc_id", "num", F.col("dict").alias("cut"), pdf_tokens.facts(F.col("dict"))["refs"].alias("cut_refs"))
    out = objects.join(cut.hint("merge"), ["doc_id", "num"], "left")
    return out.withColumn("dict", F.coalesce("cut", "dict")).withColumn("refs", F.coalesce("cut_refs", "refs")).drop("cut", "cut_refs")


def clean_pdf(files: DataFrame, *, attachments: bool = False, deep: bool = False, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """doc_id, content, stats and error of rewritten files: one version, only reachable objects, no metadata or actions.

    ``attachments`` takes out all names of the catalogue, embedded files among them.  By default actions and
    metadata of single pages and other objects stay, as findings tell; ``deep`` takes them out as well.
    ``known`` are the written objects and trailers of the same files, where they have been read before.
    ``error`` tells why a file was refused; its content is then null.
    """
    if known is None:
        objects, trailer = read(files)
        known = shared_table(objects, "pdf-objects"), shared_table(trailer, "trailers")
    objects, trailer = known
    roots = shared_table(trailer.filter(supported(F.col("trailer"))).select("doc_id", root_of(F.col("trailer")).alias("root")), "roots")
    keys = [*CATALOG_DROP, *(["Names"] if attachments else [])]
    own = objects.drop("data", "unread", "stream_sha").join(roots.hint("merge"), "doc_id").filter("num > 0 AND (type IS NULL OR type NOT IN ('XRef', 'ObjStm'))")
    edited = shared_table(without_entries(own, roots, keys, deep=deep), "edited")
    # Up to here only dictionaries are handled; streams are copied from the files when all is known.
    reached = reachable_each(references(edited), roots.filter("root IS NOT NULL").select("doc_id", F.col("root").alias("node")), ["doc_id"])
    kept = shared_table(edited.join(reached.select("doc_id", F.col("node").alias("num")).hint("merge"), ["doc_id", "num"], "left_semi"), "kept")
    broken = dangling(references(kept), kept, {"doc_id": "doc_id", "dst": "num"}).groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("dst")), 1, 6).alias("missing"))
    high_numbers = kept.filter(F.col("num") > HIGHEST).select("doc_id", F.lit(True).alias("too_high")).distinct()
    made = _rewritten(kept.join(high_numbers.hint("merge"), "doc_id", "left_anti"), files)
    totals = objects.groupBy("doc_id").agg(F.count("*").alias("total"))
    history = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.regexp_count(latin(F.col("content")), F.lit("%%EOF")) - 1, F.lit(0)).alias("history"))
    hidden = unread(objects).withColumnRenamed("error", "unread")
    out = history
    for told in (trailer, totals, high_numbers, hidden, made, broken):
        out = out.join(told.hint("merge"), "doc_id", "left")
    error = (
        F.when(F.col("trailer").isNull(), "no trailer")
        .when(~supported(F.col("trailer")), "encrypted")
        .when(F.col("unread").isNotNull(), F.col("unread"))
        .when(F.col("too_high"), "object number beyond the limit")
        .when(F.coalesce("n", F.lit(0)) < 2, "no structure")
        .when(F.col("missing").isNotNull(), F.concat(F.lit("broken references: "), F.array_join(F.transform("missing", lambda x: x.cast("string")), ", ")))
    )
    stats = F.create_map(F.lit("objects"), F.col("n"), F.lit("dropped"), (F.col("total") - F.col("n")).cast("int"), F.lit("history"), F.col("history").cast("int"))
    return out.select("doc_id", F.when(error.isNull(), F.col("content")).alias("content"), F.when(error.isNull(), stats).alias("stats"), error.alias("error"))
