"""Files as rows: folders of binary files, JSON uploads, and the tables that results are written to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions import names
from lucerna.functions.text import base64_fits

#: Limits of one request.
MOST_FILES, MOST_FILE_BYTES, MOST_REQUEST_BYTES = 10, 32 << 20, 64 << 20
#: Fixed value: names that the app takes.
ACCEPTED = r"(?i)\.(docx|docm|dotx|dotm|xlsx|xlsm|xltx|xltm|pptx|pptm|potx|potm|pdf|jpe?g|png|webp)$"


def read_files(spark: SparkSession, path: str, *, most: int = MOST_FILE_BYTES) -> DataFrame:
    """doc_id, name, content, length of the files below a folder.

    The size limit is pushed into the scan, so larger files are never read.  The id is a hash of the
    path: it does not depend on how files are dealt to tasks.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= most)
    return found.select(F.xxhash64("path").alias("doc_id"), names.safe_name(F.col("path")).alias("name"), "content", "length")


def too_large(spark: SparkSession, path: str, *, most: int = MOST_FILE_BYTES) -> DataFrame:
    """Names and sizes of files that :func:`read_files` leaves out; their bytes are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") > most)
    return found.select(names.safe_name(F.col("path")).alias("name"), "length", F.lit("file too large").alias("reason"))


def uploads(requests: DataFrame, *, most: int = MOST_FILE_BYTES) -> DataFrame:
    """request, ord, name, content, error of JSON bodies: one file, or a list ``files``, in base64.

    A text that is too long is refused before it is decoded; one that is not base64 is an error row.
    """
    one = "struct<name:string,bytesBase64:string>"
    body = F.from_json("body", "name string, bytesBase64 string, files array<" + one + ">")
    single = F.when(body["bytesBase64"].isNotNull(), F.array(F.struct(body["name"].alias("name"), body["bytesBase64"].alias("bytesBase64"))))
    listed = F.coalesce(body["files"], single, F.array().cast(f"array<{one}>"))
    rows = requests.select("request", F.posexplode(listed).alias("ord", "f")).select("request", "ord", names.safe_name(F.col("f.name")).alias("name"), F.col("f.bytesBase64").alias("b"))
    fits = F.coalesce(base64_fits(F.col("b"), most), F.lit(True))
    content = F.when(fits, F.expr("try_to_binary(b, 'base64')"))
    rows = rows.withColumn("content", content).withColumn("fits", fits)
    error = F.when(F.col("b").isNull(), "no content").when(~F.col("fits"), "file too large").when(F.col("content").isNull(), "not base64")
    return rows.select("request", "ord", "name", "content", error.alias("error"))


def file_card(content: Column) -> Column:
    """Size and digest of a file."""
    return F.struct(F.octet_length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def verdict_json(verdicts: DataFrame) -> DataFrame:
    """doc_id and the verdict as one JSON text."""
    return verdicts.select("doc_id", F.to_json(F.struct("riesgo", "puntuacion", "hallazgos", "recomendacion")).alias("body"))


def accepted(name: Column) -> Column:
    return name.rlike(ACCEPTED)
