"""What a request gets back: options of its own, a package with a report, or JSON pages under a limit; and what a batch refuses.

Options come as data, one JSON text for each file: it is checked against the same rules for every row, and a wrong
one is an error of its file (400), never of the job.  A file that cannot be cleaned is another error (422).
"""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.operators.relations import number_names
from lucerna.plans import products
from lucerna.sources.files import ACCEPTED
from lucerna.sources.zip_rows import zip_rows

# Names, values and defaults of options, messages, limits of a batch and of a JSON answer, the report's name.
DEFAULTS = {"changes": "keep", "comments": "anonymize", "customProps": True, "macros": True, "connections": True, "icc": "keep", "orientation": "keep", "attachments": False}
CHOICES = {"changes": ("keep", "accept", "reject"), "comments": ("anonymize", "delete"), "icc": ("keep", "remove"), "orientation": ("keep", "remove")}
MOST_FILES, MOST_BATCH_BYTES, MOST_JSON_BYTES, REPORT = 50, 400 << 20, 8 << 20, "informe.json"
BAD_REQUEST, UNSUPPORTED = 400, 422


def normal_options(text: str | None) -> tuple[str | None, str | None]:
    """(options with defaults as JSON, what is wrong with them): one of the two is None."""
    try:
        given = {} if text is None or not text.strip() else json.loads(text)
    except ValueError:
        given = ()
    if given is None:
        given = {}
    if not isinstance(given, dict):
        return None, "Las opciones deben ser un objeto JSON."
    for key, allowed in CHOICES.items():
        if key in given and given[key] not in allowed:
            return None, f'Opción "{key}" inválida: se espera {", ".join(allowed)}.'
    for key, default in DEFAULTS.items():
        if isinstance(default, bool) and key in given and not isinstance(given[key], bool):
            return None, f'Opción "{key}" inválida: se espera true o false.'
    unknown = [k for k in given if k not in DEFAULTS]
    if unknown:
        return None, f"Opciones desconocidas: {', '.join(unknown)}."
    return json.dumps(DEFAULTS | given, sort_keys=True), None


def options_of(text: Column) -> Column:
    """``options`` (JSON with all defaults) and ``problem`` of a JSON text."""

    @F.arrow_udf("struct<options:string,problem:string>")
    def read(texts: pa.Array) -> pa.Array:
        found = [normal_options(x) for x in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["options", "problem"])

    return read(text)


def clean_each(files: DataFrame) -> DataFrame:
    """:func:`products.clean` of (doc_id, content, options), each file by its own options, with ``options`` and ``code``.

    Files are read and inspected once; what is done to them is planned once for each set of options that occurs.
    There are at most 384 such sets, whatever the number of files.
    """
    told = files.withColumn("__o", options_of(F.col("options"))).select(F.col("doc_id").cast("long").alias("doc_id"), "content", "__o.options", "__o.problem")
    sets = [r["options"] for r in told.filter("problem IS NULL").select("options").distinct().orderBy("options").collect()]
    done = []
    for text in sets:
        o = json.loads(text)
        mine = told.filter(F.col("options") == text).select("doc_id", "content")
        office = {"changes": o["changes"], "comments": o["comments"], "custom_props": o["customProps"], "macros": o["macros"], "connections": o["connections"]}
        done.append(products.clean(mine, icc=o["icc"], orientation=o["orientation"], attachments=o["attachments"], **office).withColumn("options", F.lit(text)))
    wrong = told.filter("problem IS NOT NULL").select("doc_id", F.lit(BAD_REQUEST).alias("code"), F.col("problem").alias("error"))
    if not done:
        done = [products.clean(told.filter("false").select("doc_id", "content")).withColumn("options", F.lit(None).cast("string"))]
    every = reduce(DataFrame.unionByName, done).withColumn("code", F.when(F.col("error").isNotNull(), F.lit(UNSUPPORTED)))
    return every.unionByName(wrong, allowMissingColumns=True)


def package_response(done: DataFrame, *, service: str = "metadata", version: str = "1") -> DataFrame:
    """Pieces of one package for each request of (request, ord, name, content, report): the files, numbered where names repeat, and a report.

    ``report`` is a JSON text.  A file without content is in the report alone.
    """
    key = F.concat_ws("/", F.col("request").cast("string"), "name")
    named = number_names(done.filter("content IS NOT NULL").withColumn("__key", key), "__key", "ord")
    inside = F.expr("substring(unique_name, length(cast(request AS string)) + 2)")
    entries = named.select("request", F.col("ord").cast("long").alias("ord"), inside.alias("name"), F.col("content").alias("data"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "report"))), lambda x: x["report"]), ",")
    told = done.groupBy("request").agg((F.max("ord") + 1).cast("long").alias("ord"), listed.alias("files"))
    head = f'{{"servicio":{json.dumps(service)},"version":{json.dumps(version)},"files":['
    reports = told.select("request", "ord", F.lit(REPORT).alias("name"), F.concat(F.lit(head), "files", F.lit("]}")).cast("binary").alias("data"))
    return zip_rows(entries.unionByName(reports))


def json_pages(done: DataFrame, *, most: int = MOST_JSON_BYTES) -> DataFrame:
    """request, page, body and error: answers of (request, ord, content, report) in pages whose files hold at most ``most`` bytes.

    Files keep their order; a page ends before the file that it has no room for.  A file that alone is larger is a row
    with ``error``.  Only sizes are folded in one place; files go to their pages by a join.
    """
    sized = done.withColumn("size", F.octet_length("content").cast("long"))
    fits = sized.filter(F.col("size") <= most)
    start = F.struct(F.lit(0).cast("long").alias("page"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<ord:bigint,page:bigint>>").alias("out"))

    def deal(state: Column, x: Column) -> Column:
        over = state["used"] + x["size"] > most
        page = F.when(over, state["page"] + 1).otherwise(state["page"])
        used = F.when(over, x["size"]).otherwise(state["used"] + x["size"])
        return F.struct(page.alias("page"), used.alias("used"), F.concat(state["out"], F.array(F.struct(x["ord"].alias("ord"), page.alias("page")))).alias("out"))

    sizes = fits.groupBy("request").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), "size"))).alias("l"))
    pages = sizes.select("request", F.explode(F.aggregate("l", start, deal, lambda s: s["out"])).alias("p")).select("request", "p.ord", "p.page")
    # Spark breaks base64 into lines, which JSON does not allow inside a text.
    coded = F.translate(F.base64("content"), "\r\n", "")
    one = F.concat(F.lit('{"report":'), "report", F.lit(',"bytesBase64":"'), coded, F.lit('"}'))
    put = fits.join(pages, ["request", "ord"]).groupBy("request", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("t")))), lambda x: x["t"]), ",").alias("files"))
    none = F.lit(None).cast("string")
    answers = put.select("request", "page", F.concat(F.lit('{"ok":true,"files":['), "files", F.lit("]}")).alias("body"), none.alias("error"))
    large = sized.filter(F.col("size") > most).select("request", F.lit(None).cast("long").alias("page"), none.alias("body"), F.lit("file beyond the limit of an answer").alias("error"))
    return answers.unionByName(large)


def batch(files: DataFrame, *, most_files: int = MOST_FILES, most_bytes: int = MOST_BATCH_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of (request, ord, name, size): together they are the input; rejected rows have a ``reason``.

    An ordered fold: only the first files count; a name that the app does not take does not count towards the bytes,
    one that goes beyond them does.
    """
    order = Window.partitionBy("request").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    place, taken = F.count("*").over(order), F.coalesce(F.col("name").rlike(ACCEPTED), F.lit(False))
    told = files.withColumn("__place", place).withColumn("__taken", taken)
    counts = F.when(F.col("__taken") & (F.col("__place") <= most_files), F.coalesce("size", F.lit(0))).otherwise(F.lit(0))
    told = told.withColumn("__sum", F.sum(counts).over(order))
    reason = (
        F.when(F.col("__place") > most_files, F.lit(f"solo se procesan {most_files} archivos por lote"))
        .when(~F.col("__taken"), F.lit("formato no admitido"))
        .when(F.col("__sum") > most_bytes, F.lit("se superó el límite por lote"))
    )
    told = told.withColumn("reason", reason).drop("__place", "__taken", "__sum")
    return told.filter("reason IS NULL").drop("reason"), told.filter("reason IS NOT NULL")
