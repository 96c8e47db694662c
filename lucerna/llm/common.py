"""Helpers that the corpus operators share: shared tables, bounded slices of Arrow batches, hashing splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.sources import shared
from lucerna.sources.shared import drop_shared, shared_dir
from lucerna.sources.shared import give_back as _give_back

__all__ = ["drop_shared", "id_remainder", "lasting", "numbers", "shared_dir", "slices", "table", "tidy", "write_shared"]

#: Rows of an Arrow batch that become Python objects at once. Documents reach megabytes.
BATCH_ROWS = 500
#: Bytes that a writer of a shared table holds before it writes a row group; several write at once in an executor.
ROW_GROUP = 16 << 20


def write_shared(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back."""
    return shared.write_shared(df, label, row_group=ROW_GROUP)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices short enough that the objects of long texts fit a Python worker."""
    return shared.sliced(batches, BATCH_ROWS)


def numbers(score: Callable[[list[str | None]], np.ndarray], texts: pa.Array) -> pa.Array:
    """``score`` of every text, slice by slice."""
    parts = [np.asarray(score(texts.slice(at, BATCH_ROWS).to_pylist()), float) for at in range(0, len(texts), BATCH_ROWS)]
    return pa.array(np.concatenate(parts) if parts else [], pa.float64())


#: What operators keep in a worker from one task to the next, and how it is emptied.
_kept: dict[str, Callable[[], None]] = {}


def lasting(owner: str, empty: Callable[[], None]) -> None:
    """Tell that ``owner`` keeps something in this worker; tasks of others empty it."""
    _kept[owner] = empty


def _leave_to(owner: str) -> None:
    """Spark uses workers again, so what the operators of earlier stages keep in this one goes first."""
    for other in [x for x in _kept if x != owner]:
        _kept.pop(other)()
    _give_back()


def tidy(run: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches in a worker that lives on: at most one operator's caches, and no spare memory, stay in it."""

    def task(batches: Iterator) -> Iterator:
        _leave_to(owner)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def id_remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the split that separates learning from held-out rows."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
