"""New files of a folder, scanned as they come: each batch is written once, whatever restarts in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lucerna.functions import names
from lucerna.plans import products

SOURCE = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def new_files(spark: SparkSession, folder: str, *, most: int, per_batch: int = 1000) -> DataFrame:
    """doc_id (a hash of the path), name, content of files as they appear; larger ones are left out by the scan."""
    found = spark.readStream.format("binaryFile").schema(SOURCE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    return found.filter(F.col("length") <= most).select(F.xxhash64("path").alias("doc_id"), names.safe_name(F.col("path")).alias("name"), "content")


def scan_to(spark: SparkSession, folder: str, sink: str, checkpoint: str, *, most: int, per_batch: int = 1000) -> StreamingQuery:
    """Verdicts of new files into ``sink``, a folder for each batch.

    The sink is idempotent: a batch that runs again after a restart replaces its own folder and no other, so no verdict
    is lost or written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        files = batch.persist()
        try:
            told = products.scan(files.select("doc_id", "content")).join(files.select("doc_id", "name"), "doc_id")
            told.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        finally:
            files.unpersist()

    stream = new_files(spark, folder, most=most, per_batch=per_batch)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verdicts(spark: SparkSession, sink: str) -> DataFrame:
    """All verdicts of a sink, with the number of the batch that brought them."""
    return spark.read.option("basePath", sink).parquet(f"{sink}/batch=*")
