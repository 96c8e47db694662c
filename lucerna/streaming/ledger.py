"""The sales ledger: one JSON line for each settlement or failure, as a batch and as a stream.

The same functions serve both: a stream passes its watermark first.  Windows and sessions are
extensions; de-duplication within the watermark drops a line that was sent twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Fields of a line, in order.
FIELDS = "fecha TIMESTAMP, resultado STRING, servicio STRING, recurso STRING, red STRING, importe STRING, token STRING, cobradoA STRING, pagador STRING, tx STRING, error STRING"
SETTLED, FAILED = "liquidado", "fallido"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIELDS).json(path)


def append(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").json(path)


def check_writable(spark: SparkSession, path: str) -> None:
    """Fail early where the ledger cannot be written: an append without lines."""
    append(spark.createDataFrame([], FIELDS), path)


def stream(spark: SparkSession, path: str, *, late: str = "1 hour") -> DataFrame:
    """New files of the ledger folder; a line with the same transaction and time within the watermark counts once."""
    lines = spark.readStream.schema(FIELDS).json(path).withWatermark("fecha", late)
    return lines.dropDuplicatesWithinWatermark(["tx", "recurso", "resultado"])


def windows_to(spark: SparkSession, source: str, sink: str, checkpoint: str, *, window: str = "6 hours") -> StreamingQuery:
    """Append closed windows of settled amounts to a Parquet folder, exactly once."""
    out = windowed(stream(spark, source), window=window)
    return out.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def from_events(events: DataFrame) -> DataFrame:
    """Ledger lines from an event table: purchases are settled, errors failed, others are not sales."""
    kept = events.filter(F.col("event_type").isin("purchase", "error"))
    settled = F.col("event_type") == "purchase"
    return kept.select(
        F.col("ts").cast("timestamp").alias("fecha"),
        F.when(settled, SETTLED).otherwise(FAILED).alias("resultado"),
        F.lit("metadata").alias("servicio"),
        F.concat(F.lit("/v1/"), F.when(F.col("user_id") % 2 == 0, "scan").otherwise("clean")).alias("recurso"),
        F.lit("eip155:8453").alias("red"),
        F.concat(F.lit("$"), F.col("value").cast("decimal(12,2)").cast("string")).alias("importe"),
        F.col("user_id").cast("string").alias("pagador"),
        F.when(settled, F.col("event_id").cast("string")).alias("tx"),
        F.when(~settled, F.lit("settlement failed")).alias("error"),
    )


def amount() -> Column:
    return F.regexp_replace("importe", r"^\$", "").cast("decimal(12,2)")


def totals(lines: DataFrame) -> DataFrame:
    """Lines and cents by resource and result."""
    return lines.groupBy("recurso", "resultado").agg(F.count("*").alias("lines"), F.sum((amount() * 100).cast("long")).alias("cents"))


def windowed(lines: DataFrame, *, window: str = "6 hours") -> DataFrame:
    """Settled lines and cents of each resource in tumbling windows."""
    w = lines.filter(F.col("resultado") == SETTLED).groupBy(F.window("fecha", window).alias("w"), "recurso")
    return w.agg(F.count("*").alias("lines"), F.sum((amount() * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("window_start"), "recurso", "lines", "cents")


def sessions(lines: DataFrame, *, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each payer: lines no further apart than the gap."""
    s = lines.groupBy(F.session_window("fecha", gap).alias("s"), "pagador")
    return s.agg(F.count("*").alias("lines")).select(F.col("s.start").alias("session_start"), "pagador", "lines")
