"""Exact length histogram: documents by encoded length, and what follows from its suffix sums.

One pass encodes every whole text and aggregates (length, documents).  Everything else is read off
that histogram: totals, exact quantiles, and for every context limit how many tokens remain when
documents are cut there.  Null texts are empty (length 0); repeated rows count each; other columns
are ignored; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.llm.common import slices, tidy, write_shared
from lucerna.llm.tokenize import OWNER, public_path, tokenizer

#: The histogram is summed in ranges of so many lengths, so that no task holds all lengths.
RANGE = 4096
QUANTILES = (0.5, 0.9, 0.99)


def token_lengths(documents: DataFrame, path: str | None = None, *, added_tokens: bool = False) -> DataFrame:
    """doc_id and n_tokens of every document; see :mod:`lucerna.llm.tokenize` for added tokens written in a text."""
    path = path or public_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, added_tokens)
        for b in slices(batches):
            _, bounds = tok.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(bounds), pa.int64())], ["doc_id", "n_tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run, OWNER), "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens and documents."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("documents"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length L in the histogram, as a context limit: what documents of at least L and below it hold.

    Columns: n_tokens, documents, tokens (of documents this long), documents_from and tokens_from (suffix
    sums, this length included), documents_to (documents up to this length), truncated_tokens (the
    total when every document is cut after L tokens) and share_to (share of documents up to it).
    Sums run within ranges of lengths and over the ranges' totals, both small.
    """
    h = histogram.withColumn("tokens", F.col("n_tokens") * F.col("documents")).withColumn("__r", F.floor(F.col("n_tokens") / RANGE))
    per = h.groupBy("__r").agg(F.sum("documents").alias("__d"), F.sum("tokens").alias("__t"))
    above = Window.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    per = per.select("__r", F.coalesce(F.sum("__d").over(above), F.lit(0)).alias("__da"), F.coalesce(F.sum("__t").over(above), F.lit(0)).alias("__ta"), F.sum("__d").over(every).alias("__dn"), F.sum("__t").over(every).alias("__tn"))
    down = Window.partitionBy("__r").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    s = h.join(per, "__r").select(
        "n_tokens", "documents", "tokens",
        (F.sum("documents").over(down) + F.col("__da")).alias("documents_from"),
        (F.sum("tokens").over(down) + F.col("__ta")).alias("tokens_from"),
        "__dn", "__tn",
    )
    longer_d, longer_t = F.col("documents_from") - F.col("documents"), F.col("tokens_from") - F.col("tokens")
    return s.select(
        "n_tokens", "documents", "tokens", "documents_from", "tokens_from",
        (F.col("__dn") - longer_d).alias("documents_to"),
        (F.col("__tn") - longer_t + longer_d * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("__dn") - longer_d) / F.col("__dn")).alias("share_to"),
    )


def quantiles(sums: DataFrame, at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """For each q the smallest length up to which at least that share of documents lies."""
    return sums.agg(*(F.min(F.when(F.col("share_to") >= q, F.col("n_tokens"))).alias(f"q{round(q * 100)}") for q in at))


def totals_at(sums: DataFrame, limit: int) -> DataFrame:
    """Total tokens, and the total when documents are cut at ``limit`` (any limit, also between lengths)."""
    cut = F.when(F.col("n_tokens") > limit, F.col("documents") * limit).otherwise(F.col("tokens"))
    return sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(cut), F.lit(0)).alias("truncated_tokens"))


def count_tokens(documents: DataFrame, *, path: str | None = None, added_tokens: bool = False) -> DataFrame:
    """The histogram with its suffix sums, one row for each length that occurs."""
    histogram, _ = write_shared(length_histogram(token_lengths(documents, path, added_tokens=added_tokens)), "lengths")
    return suffix_sums(histogram)
