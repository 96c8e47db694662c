"""Best-fit-decreasing packing of token sequences, exact at any size.

A piece is at most ``capacity`` tokens long, so the whole input has at most ``capacity`` distinct
lengths.  Best fit decreasing only looks at lengths: bins that have the same room left are alike.
The planner therefore places *classes*: longest first, all pieces of one length at once, each step
finding the smallest room that still fits through a segment tree over rooms.  Its work and its
plan depend on the capacity, not on the number of documents.  Spark numbers the pieces of each
length and looks their places up in the plan.

Rows and edge cases: a null text is an empty one and takes one token (the end mark); repeated rows
are packed each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.llm.common import slices, tidy, write_shared
from lucerna.llm.tokenize import OWNER, public_path, tokenizer

CAPACITY = 2048
#: Pieces of one length are numbered in cells of about so many.
CELL_ROWS = 1_000_000


class RoomTree:
    """Segment tree over rooms 0..capacity: how many bins have each room, and the smallest room >= x in use."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1 - 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, bins: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += bins
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that some open bin has."""
        i = least + self.leaves
        if i >= 2 * self.leaves:
            return None
        if self.count[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go: (length, first rank, bins, pieces per bin, first bin, offset) runs.

    Piece number r of a length lies in the run with first rank <= r < first rank + bins * per bin,
    in bin first bin + (r - first rank) // per bin.  The bins equal those of placing one piece at
    a time, longest first, each into the tightest open bin.
    """
    tree = RoomTree(capacity)
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs of bins (first, how many)
    runs, opened = [], 0

    def open_bins(room: int, first: int, bins: int) -> None:
        if bins and room:
            groups[room].append((first, bins))
            tree.add(room, bins)

    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                per = capacity // length
                first, bins, room = opened, -(-left // per), capacity
                opened += bins
            else:
                first, bins = groups[room].pop()
                per = room // length
                tree.add(room, -bins)
                used = min(bins, -(-left // per))
                if used < bins:
                    open_bins(room, first + used, bins - used)
                bins = used
            full = min(bins, left // per)
            offset = capacity - room
            if full:
                runs.append((length, rank, full, per, first, offset))
                open_bins(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < bins:
                runs.append((length, rank, 1, left, first + full, offset))
                open_bins(room - left * length, first + full, 1)
                rank, left = rank + left, 0
    return runs


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, *, added_tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, added_tokens)
        mark = np.array([end_id], "<u4").tobytes()
        for b in slices(batches):
            ids, bounds = tok.encode([t or "" for t in b.column("text").to_pylist()])
            raw = ids.tobytes()
            docs, piece, start, length, crc = [], [], [], [], []
            for doc, lo, hi in zip(b.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                body = raw[4 * lo : 4 * hi] + mark
                n = hi - lo + 1
                for k, s in enumerate(range(0, n, capacity)):
                    docs.append(doc)
                    piece.append(k)
                    start.append(s)
                    length.append(min(capacity, n - s))
                    crc.append(zlib.crc32(body[4 * s : 4 * min(n, s + capacity)]))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run, OWNER), "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length``; ``cut`` must give the same rows when read again.

    Pieces of one length are numbered in cells of about CELL_ROWS rows, so no task sorts a whole length.  Cells are
    dealt by all that a piece says and, where ``cut`` has one, by its ``__row`` number (left out of the result), so
    that repeated rows and rows without id are spread as well.
    To the driver go one count for each length, then one for each cell: at most ``capacity`` and a
    CELL_ROWS-th of the pieces.  What comes back are the cells' first numbers and the plan's runs.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    told = [c for c in ("doc_id", "piece", "start", "ids_crc32", "__row") if c in cut.columns]
    wide = spark.createDataFrame(sorted((k, -(-n // CELL_ROWS)) for k, n in counts.items()), "length long, __cells long")
    celled = cut.join(F.broadcast(wide), "length").withColumn("__cell", F.pmod(F.xxhash64(*told), F.col("__cells"))).drop("__cells")
    cells: list[tuple[int, int, int]] = []
    before: dict[int, int] = defaultdict(int)
    for r in sorted(celled.groupBy("length", "__cell").agg(F.count("*").alias("n")).collect(), key=lambda r: (r["length"], r["__cell"])):
        cells.append((r["length"], r["__cell"], before[r["length"]]))
        before[r["length"]] += r["n"]
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for length, first, _, per, to, offset in plan(counts, capacity):
        runs[length].append((first, per, to, offset))
    #: First ranks, pieces a bin, first bin and offset of the runs of each length, in the order of ranks.
    planned = {length: np.array(sorted(x), np.int64).T for length, x in runs.items()}
    firsts = spark.createDataFrame(cells, "length long, __cell long, __before long")
    within = Window.partitionBy("length", "__cell").orderBy(*told)
    ranked = celled.join(F.broadcast(firsts), ["length", "__cell"]).withColumn("__rank", F.col("__before") + F.row_number().over(within) - 1)

    @F.arrow_udf("struct<bin:bigint,at:bigint>")
    def lies(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        length, rank = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        bins, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for k in np.unique(length):
            mine = np.flatnonzero(length == k)
            first, per, to, offset = planned[int(k)]
            run = np.searchsorted(first, rank[mine], "right") - 1
            nth = rank[mine] - first[run]
            bins[mine], at[mine] = to[run] + nth // per[run], offset[run] + nth % per[run] * k
        return pa.StructArray.from_arrays([pa.array(bins), pa.array(at)], ["bin", "at"])

    found = ranked.withColumn("__at", lies(F.col("length").cast("long"), F.col("__rank").cast("long")))
    return found.select(*(c for c in cut.columns if c != "__row"), F.col("__at.bin").alias("sequence_id"), F.col("__at.at").alias("offset"))


def pack_documents(documents: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, added_tokens: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    cut, _ = write_shared(pieces(documents, path or public_path("word_bpe_49k.json"), capacity, added_tokens=added_tokens).withColumn("__row", F.monotonically_increasing_id()), "pieces")
    return place(cut, capacity)
