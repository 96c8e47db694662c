"""Queries over files made from the documents table: packages, images and PDF files, inspected, cleaned and verified."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions import names, sniff
from lucerna.functions.binary import joined
from lucerna.operators import image_check, images, office, pdf, pdf_check, raw_scan, verdict
from lucerna.operators.relations import shared_table
from lucerna.plans import overview, products, responses, verification
from lucerna.sources import fixtures, packages
from lucerna.sources import pdf_tables as tables
from lucerna.sources.images import exif, read_segments
from lucerna.sources.shared import passing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _office(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.office_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts and nodes for inspection; the parts' bytes are not kept."""
    parts = shared_table(packages.inspect_packages(_office(spark, sf_dir)), "parts")
    return parts, packages.nodes_of(parts)


@query
def office_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind by first bytes, format by the first known folder, and the label of both."""
    files = _office(spark, sf_dir)
    parts = packages.list_packages(files)
    listed = parts.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"))
    fmt = sniff.package_format(F.col("names"))
    return files.select("doc_id", sniff.file_kind(F.col("content")).alias("kind")).join(listed, "doc_id").select("doc_id", "kind", fmt.alias("format"), sniff.kind_label(F.col("kind"), fmt).alias("label"))


@query
def office_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of every package: its place, name and digest, with the checksum verified."""
    p = packages.read_packages(_office(spark, sf_dir))
    return p.select("doc_id", F.col("ord").cast("long").alias("ord"), "name", "crc_ok", F.when(F.col("name").endswith(".bin"), F.sha2("data", 256)).alias("sha256"))


@query
def office_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office.office_findings(*_read(spark, sf_dir))


@query
def office_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = office.office_findings(*_read(spark, sf_dir)).withColumn("kind", F.lit("office"))
    return verdict.signals_of_findings(found).select("doc_id", "nivel", "titulo")


@query
def office_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = office.office_findings(*_read(spark, sf_dir)).withColumn("kind", F.lit("office"))
    return verdict.verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), verdict.signals_of_findings(found))


@query
def office_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of cleaned packages, written and read again, with the visible text they carry."""
    parts = packages.read_packages(_office(spark, sf_dir))
    again = packages.read_packages(packages.write_packages(office.clean_parts(parts, macros=True)))
    text = office.visible_text(F.col("data"))
    return again.select("doc_id", "name", F.when(F.col("name").rlike("^(word/document|word/comments)"), F.sha2(text.cast("binary"), 256)).alias("text_sha256"))


@query
def office_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of Word bodies when changes are accepted, and when they are rejected."""
    parts = office_word(spark, sf_dir)
    side = lambda mode: office.clean_parts(parts, changes=mode).filter("name = 'word/document.xml'").select("doc_id", F.sha2(office.visible_text(F.col("data")).cast("binary"), 256).alias(mode))
    return side("accept").join(side("reject"), "doc_id")


def office_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.read_packages(_office(spark, sf_dir)).filter("name LIKE 'word/%'")


@query
def office_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What independent checks find wrong with cleaned packages: nothing."""
    parts = shared_table(packages.read_packages(_office(spark, sf_dir)), "parts")
    cleaned = shared_table(office.clean_parts(parts, comments="delete"), "cleaned")
    return office.violations(parts, cleaned, comments="delete")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixtures.image_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return shared_table(read_segments(files.withColumn("format", sniff.sniff_image(F.col("content")))), "segments")


@query
def image_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = images.role(_images(spark, sf_dir))
    return s.select("doc_id", "format", F.col("ord").cast("long").alias("ord"), "kind", "role")


@query
def image_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.image_findings(_images(spark, sf_dir))


@query
def image_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found in cleaned images after writing and reading them again: only the orientation."""
    cleaned = images.assemble(images.clean_segments(_images(spark, sf_dir)))
    return images.image_findings(shared_table(read_segments(cleaned), "cleaned"))


@query
def image_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _images(spark, sf_dir)
    after = shared_table(read_segments(images.assemble(images.clean_segments(before))), "cleaned")
    return images.image_violations(before, after)


def _pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_table(fixtures.pdf_files(spark.read.parquet(f"{sf_dir}/documents.parquet")), "pdf")


def _pdf(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = _pdf_files(spark, sf_dir)
    objects, trailers = pdf.read(files)
    return files, shared_table(objects, "objects"), shared_table(trailers, "trailers")


@query
def pdf_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, objects, _ = _pdf(spark, sf_dir)
    return objects.select("doc_id", "num", F.coalesce("stream_bytes", F.lit(-1).cast("long")).alias("stream_bytes"))


@query
def pdf_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.pdf_findings(*_pdf(spark, sf_dir)).filter("label <> 'Tipo detectado'")


@query
def pdf_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, objects, trailer = _pdf(spark, sf_dir)
    found = pdf.pdf_findings(files, objects, trailer).withColumn("kind", F.lit("pdf"))
    return verdict.verdicts(trailer, verdict.signals_of_findings(found), supported=pdf.supported(F.col("trailer")))


@query
def pdf_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned files read again: why a file was refused, how many objects are left, the digest of the page's content."""
    cleaned = shared_table(pdf.clean_pdf(_pdf_files(spark, sf_dir)), "cleaned")
    objects = pdf.scan_objects(cleaned.filter("content IS NOT NULL"))
    per = objects.groupBy("doc_id").agg(F.count("*").alias("objects"), F.max(F.when(F.col("num") == 4, F.sha2("stream", 256))).alias("content_sha256"))
    return cleaned.select("doc_id", F.coalesce("error", F.lit("")).alias("error")).join(per, "doc_id", "left").select("doc_id", "error", F.coalesce("objects", F.lit(0)).alias("objects"), F.coalesce("content_sha256", F.lit("")).alias("content_sha256"))


@query
def pdf_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of cleaned files: how many objects there are, and how many stand where the table says."""
    cleaned = pdf.clean_pdf(_pdf_files(spark, sf_dir)).filter("content IS NOT NULL")
    return tables.read_objects(shared_table(cleaned, "cleaned")).groupBy("doc_id").agg(F.count("*").alias("objects"), F.count_if("told").alias("told"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all kinds in one table: packages, images, PDF files, and texts that are none of them."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = lambda k: d.filter(F.col("doc_id") % 4 == k)
    text = own(3).select("doc_id", F.concat(F.lit("text: "), F.col("text")).cast("binary").alias("content"))
    return shared_table(fixtures.office_files(own(0)).unionByName(fixtures.image_files(own(1))).unionByName(fixtures.pdf_files(own(2))).unionByName(text), "mixed")


@query
def scan_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = products.scan(_mixed(spark, sf_dir))
    return s.select("doc_id", "riesgo", "puntuacion", F.array_join(F.transform("hallazgos", lambda h: h["titulo"]), "; ").alias("titles"), "recomendacion")


@query
def clean_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cleaning did to each file; cleaned files are scanned by their first bytes again."""
    c = products.clean(_mixed(spark, sf_dir), macros=True)
    return c.select("doc_id", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("error", F.lit("")).alias("error"), F.coalesce(sniff.file_kind(F.col("content")), F.lit("none")).alias("kind_out"), F.coalesce(F.col("sha256_in") != F.col("sha256_out"), F.lit(False)).alias("changed"))


@query
def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of twenty documents each in one package, named by language: repeated names are numbered."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = d.select(F.floor(F.col("doc_id") / 20).cast("long").alias("request"), F.col("doc_id").alias("ord"), F.concat(F.col("lang"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    made = products.bundle(files).withColumnRenamed("request", "doc_id")
    return packages.read_packages(made).select(F.col("doc_id").alias("request"), F.col("ord").cast("long").alias("ord"), "name", F.sha2("data", 256).alias("sha256"))


@query
def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of cleaning every document's package: names, format, counters, what was removed, how much was found."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = _office(spark, sf_dir).join(d.select("doc_id", F.concat(F.lit("../informe "), F.col("doc_id").cast("string"), F.lit(".docx")).alias("name")), "doc_id")
    r = products.clean_report(shared_table(files, "files"), macros=True)
    count = lambda k: F.coalesce(F.col("stats")[k], F.lit(0)).cast("long").alias(k)
    notes = F.array_join("removed", "; ").alias("removed")
    return r.select("doc_id", "name", "output_name", "kind", "format", *map(count, ("authors", "dates", "accounts", "comments", "rsid", "paraId", "settings")), notes, F.size("findings").cast("long").alias("n_findings"), F.coalesce("error", F.lit("")).alias("error"))


@query
def office_other_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages whose parts use other prefixes and single quotes, cleaned: what is found and what is wrong afterwards."""
    parts = shared_table(packages.read_packages(packages.write_packages(fixtures.respelled(fixtures.office_parts(spark.read.parquet(f"{sf_dir}/documents.parquet"))))), "respelled")
    kept = shared_table(office.clean_parts(parts, macros=True), "cleaned")
    wrong = office.violations(parts, kept.drop("stats", "error"), macros=True).groupBy("doc_id").agg(F.count("*").alias("problems"))
    inspected = shared_table(packages.inspect_packages(packages.write_packages(kept)), "parts")
    people = office.office_findings(inspected, packages.nodes_of(inspected)).filter("sev = 'personal' AND NOT keep AND NOT (label = '(sin nombre)' AND value = '(sin identificador)')").groupBy("doc_id").agg(F.count("*").alias("people"))
    body = kept.filter("name = 'word/document.xml'").select("doc_id", F.sha2(office.told_text(F.col("data"), None).cast("binary"), 256).alias("text_sha256"))
    every = kept.select("doc_id").distinct().join(wrong, "doc_id", "left").join(people, "doc_id", "left").join(body, "doc_id", "left")
    return every.select("doc_id", F.coalesce("problems", F.lit(0)).alias("problems"), F.coalesce("people", F.lit(0)).alias("people"), F.coalesce("text_sha256", F.lit("")).alias("text_sha256"))


def _every_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a package, an image, a PDF file and a text: four files, numbered apart."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = d.select("doc_id", F.concat(F.lit("text: "), F.col("text")).cast("binary").alias("content"))
    kinds = [fixtures.office_files(d), fixtures.image_files(d), fixtures.pdf_files(d), text]
    out = None
    for k, files in enumerate(kinds):
        one = files.select((F.col("doc_id") * 4 + k).alias("doc_id"), "content")
        out = one if out is None else out.unionByName(one)
    return shared_table(out, "every")


@query
def scan_every_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of every document in every kind of file."""
    s = products.scan(_every_kind(spark, sf_dir))
    return s.select(F.col("doc_id").alias("file_id"), "riesgo", "puntuacion", F.size("hallazgos").cast("long").alias("n"))


@query
def clean_every_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cleaning and its checks did to every document in every kind of file."""
    c = products.clean(_every_kind(spark, sf_dir), macros=True)
    return c.select(F.col("doc_id").alias("file_id"), F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("error", F.lit("")).alias("error"), F.coalesce(F.col("sha256_in") != F.col("sha256_out"), F.lit(False)).alias("changed"))


@query
def image_file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What picture files tell as a whole; every document's picture is also there as a TIFF and as a HEIC file."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return images.file_findings(shared_table(_pictures(d), "pictures").withColumn("format", sniff.sniff_image(F.col("content")))).withColumnRenamed("doc_id", "file_id")


def _pictures(d: DataFrame) -> DataFrame:
    kinds = [fixtures.image_files(d), fixtures.tiff_files(d), fixtures.heic_files(d)]
    out = None
    for k, files in enumerate(kinds):
        one = files.select((F.col("doc_id") * 3 + k).alias("doc_id"), "content")
        out = one if out is None else out.unionByName(one)
    return out


@query
def file_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence on every document in every kind of file."""
    return overview.summaries(_every_kind(spark, sf_dir)).select(F.col("doc_id").alias("file_id"), F.coalesce("summary", F.lit("")).alias("summary"))


@query
def raw_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks that the raw scanners find in every document in every kind of file, named by its kind."""
    kind, third = F.col("doc_id") % 4, (F.floor(F.col("doc_id") / 4) % 3).cast("int")
    of = lambda *names: F.element_at(F.array(*map(F.lit, names)), third + 1)
    name = F.concat(F.lit("Informe.v2."), F.when(kind == 0, of("docx", "XLSX", "pptx")).when(kind == 1, of("jpg", "png", "webp")).when(kind == 2, "pdf").otherwise("txt"))
    found = raw_scan.raw_marks(_every_kind(spark, sf_dir).withColumn("name", name))
    # One aggregate: a second one would scan all files again.
    line = F.struct("ord", raw_scan.mark_line(F.col("present"), F.col("text")).alias("line"))
    shown = F.sort_array(F.collect_list(F.when(F.coalesce("present", F.lit(True)), line)))
    told = found.groupBy("doc_id").agg(shown.alias("l"), F.count_if(~F.col("present")).alias("absent")).filter(F.size("l") > 0)
    return told.select(F.col("doc_id").alias("file_id"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"), "absent")


def _pdf_trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = shared_table(fixtures.pdf_tree_files(spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL")), "pdf-trees")
    objects, trailers = pdf.read(files)
    return files, shared_table(objects, "objects"), shared_table(trailers, "trailers")


@query
def pdf_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all dictionaries of every file with name trees: nesting, key and value as written."""
    _, objects, _ = _pdf_trees(spark, sf_dir)
    return pdf.dictionary_entries(objects).filter("num <> 4").select("doc_id", "num", "depth", "key", "value")


@query
def pdf_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of every file with name trees; what strings and comments hold is none."""
    _, objects, _ = _pdf_trees(spark, sf_dir)
    return pdf.references(objects)


@query
def pdf_tree_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the name trees of scripts and attachments list."""
    _, objects, trailers = _pdf_trees(spark, sf_dir)
    roots = trailers.select("doc_id", pdf.root_of(F.col("trailer")).alias("root"))
    return pdf.trees_names(objects, roots, ["JavaScript", "EmbeddedFiles"]).select("doc_id", "tree", "name", F.coalesce("num", F.lit(-1).cast("long")).alias("num"))


@query
def pdf_tree_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with name trees, cleaned: why refused, objects left, and whether a script is left, by default and in a deep cleaning."""
    files, objects, trailers = _pdf_trees(spark, sf_dir)
    side = lambda deep: pdf.clean_pdf(files, deep=deep, known=(objects, trailers)).select("doc_id", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(F.col("stats")["objects"], F.lit(0)).cast("long").alias("objects"), F.contains(pdf.latin(F.col("content")), F.lit("/JS ")).alias("script"))
    return side(False).join(side(True).select("doc_id", F.col("objects").alias("deep_objects"), F.col("script").alias("deep_script")), "doc_id")


@query
def pdf_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second reader finds wrong with cleaned files: nothing, and what was planted in copies of them."""
    files, objects, trailers = _pdf_trees(spark, sf_dir)
    plain = _pdf_files(spark, sf_dir)
    cleaned = shared_table(pdf.clean_pdf(files, known=(objects, trailers)).filter("content IS NOT NULL").select("doc_id", "content"), "cleaned")
    before, ends = (shared_table(x, "plain") for x in pdf.read(plain))
    again = pdf.clean_pdf(plain, known=(before, ends)).filter("content IS NOT NULL").select("doc_id", "content")
    text = pdf.latin(F.col("content"))
    planted = cleaned.withColumn("content", F.encode(F.replace(text, F.lit("/Lang (see 99 0 R now)"), F.lit("/OpenAction 4 0 R     ")), "ISO-8859-1"))
    told = lambda streams, after, which: pdf_check.pdf_violations(pdf_check.stream_digests(streams), after).withColumn("which", F.lit(which))
    return told(objects, cleaned, "trees").unionByName(told(before, again, "plain")).unionByName(told(objects, planted, "planted"))


@query
def picture_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second reader finds wrong with cleaned pictures: nothing; and with pictures that were not cleaned at all."""
    files = shared_table(fixtures.image_files(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("format", sniff.sniff_image(F.col("content"))), "pictures")
    cleaned = shared_table(images.assemble(images.clean_segments(read_segments(files))), "cleaned")
    told = lambda after, which: image_check.picture_violations(files, after).withColumn("which", F.lit(which))
    return told(cleaned, "cleaned").unionByName(told(files, "as it was"))


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in every kind of file and its copy; every seventh copy is missing, every fifth is the original."""
    with passing(spark) as settled:
        with passing(spark) as keep:
            name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".bin"))
            files = _every_kind(spark, sf_dir).filter("doc_id IS NOT NULL").withColumn("name", name)
            done = products.clean(files, macros=True).select("doc_id", name.alias("name"), "content")
            number = F.floor(F.col("doc_id") / 4)
            # Copies and the originals that stand for them are never in one row before they are paired by name.
            given = done.filter((number % 7 != 0) & (number % 5 != 0)).unionByName(files.filter((number % 7 != 0) & (number % 5 == 0)).select("doc_id", "name", "content"))
            outputs = given.select(names.output_name(F.col("name")).alias("name"), "content").filter("content IS NOT NULL")
            pairs = keep(verification.paired(files, outputs), "pairs")
        return verification.verify(pairs, settled, macros=True)


@query
def verify_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each original, the name that its copy must have, and what the verifier of its kind says."""
    return _verified(spark, sf_dir).select("name", "wanted", F.coalesce("kind", F.lit("none")).alias("kind"), "status")


@query
def verify_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.tally(_verified(spark, sf_dir))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of twenty documents each as the files of a request, named by language, each with a report."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    report = F.to_json(F.struct(F.col("doc_id").alias("id")))
    return d.select(F.floor(F.col("doc_id") / 20).cast("long").alias("request"), F.col("doc_id").alias("ord"), F.concat(F.col("lang"), F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), report.alias("report"))


@query
def package_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages made of rows of bytes, put together and read again: names, and digests of files and reports."""
    pieces = responses.package_response(_requests(spark, sf_dir))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("section", "ord", "piece"))), lambda x: x["piece"])
    whole = pieces.groupBy(F.col("request").alias("doc_id")).agg(listed.alias("l")).select("doc_id", joined(F.col("l")).alias("content"))
    return packages.read_packages(whole).select(F.col("doc_id").alias("request"), F.col("ord").cast("long").alias("ord"), "name", "crc_ok", F.sha2("data", 256).alias("sha256"))


@query
def json_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of answers of at most 40,000 bytes of files each, and files that no page can hold."""
    pages = responses.json_pages(_requests(spark, sf_dir), most=40_000)
    count = F.size(F.split("body", "bytesBase64")) - 1
    return pages.select("request", F.coalesce("page", F.lit(-1).cast("long")).alias("page"), F.coalesce(count, F.lit(0)).cast("long").alias("files"), F.coalesce("error", F.lit("")).alias("error"))


@query
def batch_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch of a hundred documents accepts and refuses, as files of many names."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ending = F.element_at(F.array(*map(F.lit, (".pdf", ".txt", ".DOCX", ".jpeg", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    files = d.select(F.floor(F.col("doc_id") / 100).cast("long").alias("request"), F.col("doc_id").alias("ord"), F.concat(F.col("lang"), ending).alias("name"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    kept, refused = responses.batch(files, most_bytes=60_000)
    return kept.withColumn("reason", F.lit("")).unionByName(refused).select("request", "ord", "name", "reason")


@query
def package_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the property parts of every package, by a lateral join of SQL with a table function."""
    packages.register(spark)
    return spark.sql("SELECT f.doc_id, n.part, n.tag, n.text FROM {files} f, LATERAL package_nodes(f.content, '^docProps/.*[.]xml$') n WHERE n.error IS NULL AND n.parent >= 0", files=_office(spark, sf_dir))


@query
def exif_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serial numbers and places of cameras, from the directories that the first one leads to."""
    files = fixtures.camera_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    blocks = files.select("doc_id", exif(F.col("content")).alias("x")).filter("x IS NOT NULL")
    return images.directory_findings(blocks)


@query
def office_extra_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom properties, pivot tables of external sources, and accounts of Excel and PowerPoint files."""
    parts = shared_table(packages.inspect_packages(fixtures.extra_packages(spark.read.parquet(f"{sf_dir}/documents.parquet"))), "parts")
    return office.office_findings(parts, packages.nodes_of(parts)).filter("grp NOT IN ('Archivo', 'Paquete ZIP')")


@query
def office_extra_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = shared_table(packages.inspect_packages(fixtures.extra_packages(spark.read.parquet(f"{sf_dir}/documents.parquet"))), "parts")
    found = office.office_findings(parts, packages.nodes_of(parts)).withColumn("kind", F.lit("office"))
    return verdict.signals_of_findings(found).select("doc_id", "nivel", "titulo")


@query
def office_settled_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with packages whose changes were accepted, or rejected: nothing; and with those of the other mode: their texts."""
    parts = shared_table(packages.read_packages(_office(spark, sf_dir)), "parts")
    done = {mode: shared_table(office.clean_parts(parts, changes=mode).drop("stats", "error"), mode) for mode in ("accept", "reject")}
    # Each table is read once, though copies are compared with originals more than once.
    was = {mode: shared_table(office.read_originals(parts, changes=mode), "was") for mode in done}
    seen = {mode: shared_table(office.read_copies(done[mode], changes=mode), "seen") for mode in done}
    told = lambda mode, other: office.compared(was[mode], seen[other], changes=mode).select("doc_id", "part", "problem", F.lit(f"{other}, checked as {mode}").alias("which"))
    return told("accept", "accept").unionByName(told("reject", "reject")).unionByName(told("accept", "reject"))


@query
def profile_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour profiles and authors of IPTC blocks."""
    files = fixtures.profiled_pictures(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("format", F.lit("jpeg"))
    return images.image_findings(shared_table(images.metadata_only(read_segments(files)), "segments"))


@query
def ole_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of old Office files, found or not."""
    files = fixtures.ole_files(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("name", F.lit("viejo.doc"))
    kind = shared_table(files, "ole")
    found = raw_scan.raw_marks(kind).groupBy("doc_id").agg(F.count_if("present").alias("present"), F.count_if(~F.col("present")).alias("absent"))
    return found.join(kind.select("doc_id", F.coalesce(sniff.file_kind(F.col("content")), F.lit("none")).alias("kind")), "doc_id")


def _chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = shared_table(fixtures.chained_pdf_files(spark.read.parquet(f"{sf_dir}/documents.parquet")), "chains")
    objects, trailers = pdf.read(files)
    return files, shared_table(objects, "objects"), shared_table(trailers, "trailers")


@query
def pdf_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of files whose newest ones stand in compressed streams that only a chain of sections tells."""
    _, objects, _ = _chains(spark, sf_dir)
    word = F.when(F.contains("dict", F.lit("/New")), "new").when(F.contains("dict", F.lit("/Old")) | F.contains("dict", F.lit("/Stray")), "old").otherwise("")
    return objects.select("doc_id", "num", F.coalesce("type", F.lit("")).alias("type"), word.alias("version"))


@query
def pdf_chain_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files with chains tell: the author from an object in a stream, pages and versions."""
    return pdf.pdf_findings(*_chains(spark, sf_dir)).filter("label NOT IN ('Tipo detectado', 'Comentarios y anotaciones')")


@query
def pdf_chain_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with chains, cleaned: objects left, and whether the new page is, with its annotation, and the old one or an author."""
    files, objects, trailers = _chains(spark, sf_dir)
    c = pdf.clean_pdf(files, known=(objects, trailers))
    t = pdf.latin(F.col("content"))
    holds = lambda text: F.contains(t, F.lit(text))
    return c.select("doc_id", F.coalesce("error", F.lit("")).alias("error"), F.col("stats")["objects"].cast("long").alias("objects"), (holds("/New true") & holds("/Subtype /Highlight")).alias("new"), (holds("/Old") | holds("/Stray") | holds("/Author") | holds("/ObjStm")).alias("old"))


@query
def clean_report_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of cleaning every document's picture and PDF file: formats, what was removed, and why a file was refused."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kinds = [fixtures.image_files(d), fixtures.pdf_files(d)]
    one = lambda k: kinds[k].select((F.col("doc_id") * 2 + k).alias("doc_id"), "content")
    files = shared_table(one(0).unionByName(one(1)), "media").withColumn("name", F.concat(F.lit("m"), F.col("doc_id").cast("string")))
    r = products.clean_report(files)
    return r.select(F.col("doc_id").alias("file_id"), "kind", "format", F.coalesce("output_name", F.lit("")).alias("output_name"), F.coalesce(F.array_join("removed", "; "), F.lit("")).alias("removed"), F.coalesce("error", F.lit("")).alias("error"))


@query
def pdf_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of PDF files: highlights count, links do not."""
    files = shared_table(fixtures.annotated_pdf_files(spark.read.parquet(f"{sf_dir}/documents.parquet")), "annotated")
    objects, trailers = pdf.read(files)
    return pdf.pdf_findings(files, objects, trailers).filter("grp = 'Anotaciones'")
