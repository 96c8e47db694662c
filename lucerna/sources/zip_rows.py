"""Packages as rows of bytes: local entries, the directory and its end, in the order in which they are written.

No package is ever one value: an entry is deflated on its own, offsets are sums over lengths, checksums are
Spark's.  A writer appends the pieces of a request in the order of (section, ord).
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.operators.relations import shared_table

# Version 2.0, names in UTF-8, deflated, midnight of 1980-01-01; the largest counts and sizes of the plain format.
_COMMON = "1400" + "0008" + "0800" + "0000" + "2100"
MOST_ENTRIES, MOST_BYTES = 0xFFFF, 0xFFFFFFFF
LOCAL, DIRECTORY, END = 0, 1, 2
BEYOND = "package beyond the format's limits"


def _little(n: Column, width: int) -> Column:
    """A number as ``width`` bytes, the lowest first."""
    hexed = F.lpad(F.hex(n.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(hexed, 2 * (width - 1 - k) + 1, 2) for k in range(width))))


def _deflated(data: Column) -> Column:
    @F.arrow_udf("binary")
    def deflate(parts: pa.Array) -> pa.Array:
        out = []
        for x in parts:
            d = zlib.compressobj(6, zlib.DEFLATED, -15)
            out.append(d.compress(x.as_py() or b"") + d.flush())
        return pa.array(out, pa.binary())

    return deflate(data)


def zip_rows(entries: DataFrame) -> DataFrame:
    """request, section, ord, piece and error of the packages of (request, ord, name, data).

    The pieces of a request, one behind the other, are its package: equal entries give equal bytes.  A null data is an
    empty entry, a null name an entry named ``archivo``.  A request with more entries or bytes than the format holds is
    one row with ``error``.  Names are taken as they come: number repeated ones first.
    """
    e = entries.select("request", "ord", F.encode(F.coalesce("name", F.lit("archivo")), "UTF-8").alias("name"), F.coalesce("data", F.lit(b"")).alias("data"))
    packed = shared_table(e.select("request", "ord", "name", F.crc32("data").alias("crc"), F.octet_length("data").cast("long").alias("size"), _deflated(F.col("data")).alias("packed")), "zip-entries")
    sizes = F.concat(_little(F.col("crc"), 4), _little(F.col("length"), 4), _little(F.col("size"), 4), _little(F.octet_length("name"), 2), F.unhex(F.lit("0000")))
    own = packed.withColumn("length", F.octet_length("packed").cast("long"))
    # Offsets need lengths only: the data takes no part in the window.
    order = Window.partitionBy("request").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    narrow = own.drop("packed").withColumn("at", F.coalesce(F.sum(F.col("length") + 30 + F.octet_length("name")).over(order), F.lit(0)))
    total = narrow.groupBy("request").agg(F.count("*").alias("n"), F.sum(F.col("length") + 30 + F.octet_length("name")).alias("body"), F.sum(46 + F.octet_length("name")).alias("listed"))
    fits = (F.col("n") <= MOST_ENTRIES) & (F.col("body") + F.col("listed") <= MOST_BYTES)
    good = total.filter(fits).select("request")
    null = F.lit(None).cast("string").alias("error")
    local = own.join(good, "request", "left_semi").select("request", F.lit(LOCAL).alias("section"), "ord", F.concat(F.unhex(F.lit("504B0304" + _COMMON)), sizes, "name", "packed").alias("piece"), null)
    listed = narrow.join(good, "request", "left_semi").select(
        "request", F.lit(DIRECTORY).alias("section"), "ord",
        F.concat(F.unhex(F.lit("504B0102" + "1400" + _COMMON)), sizes, F.unhex(F.lit("0000" * 3 + "00000000")), _little(F.col("at"), 4), "name").alias("piece"), null,
    )
    counts = F.concat(_little(F.col("n"), 2), _little(F.col("n"), 2), _little(F.col("listed"), 4), _little(F.col("body"), 4))
    end = total.filter(fits).select("request", F.lit(END).alias("section"), F.lit(0).alias("ord"), F.concat(F.unhex(F.lit("504B0506" + "00000000")), counts, F.unhex(F.lit("0000"))).alias("piece"), null)
    beyond = total.filter(~fits).select("request", F.lit(END).alias("section"), F.lit(0).alias("ord"), F.lit(None).cast("binary").alias("piece"), F.lit(BEYOND).alias("error"))
    return local.unionByName(listed).unionByName(end).unionByName(beyond)
