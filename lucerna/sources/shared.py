"""Tables in the folder that the driver and all executors share, and bounded slices of Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's switch for deleting a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}
_lock = threading.Lock()
_writers: dict[int, tuple[int, str | None]] = {}
#: Where a thread notes the tables of the :func:`passing` step that it is in.
_step = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, one machine (tests) gets a temporary folder of its own; a cluster gets an error,
    because executors would each write to their own disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    with _lock:
        return _own.get(spark.sparkContext.applicationId) or _made(spark.sparkContext.applicationId)


def _made(application: str) -> str:
    _own[application] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[application]


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The switch is on while any thread of the session writes, and as before when the last one is done."""
    key = id(spark)
    with _lock:
        n, before = _writers.get(key) or (0, spark.conf.get(CLEANUP, None))
        _writers[key] = (n + 1, before)
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writers.pop(key)
            if n > 1:
                _writers[key] = (n - 1, before)
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def write_shared(df: DataFrame, label: str, *, row_group: int | None = None) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back.

    Nothing reads the write's shuffle files again, so Spark may delete them as soon as it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lucerna/{label}-{uuid.uuid4().hex}"
    writer = df.write if row_group is None else df.write.option("parquet.block.size", str(row_group))
    if (noted := getattr(_step, "paths", None)) is not None:
        noted.append(path)
    with _cleaning(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_shared(spark: SparkSession, *paths: str) -> None:
    """Delete tables of :func:`write_shared` that nothing will read again."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A step whose tables are deleted when it ends, but for those written by the function that it gives.

    Those belong to the step around it, if there is one.  What leaves the step must be made of them alone.
    """
    around = getattr(_step, "paths", None)
    _step.paths = own = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        inside, _step.paths = _step.paths, around
        try:
            return write_shared(df, label)[0]
        finally:
            _step.paths = inside

    try:
        yield keep
    finally:
        _step.paths = around
        drop_shared(spark, *own)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches of a task in slices of at most ``rows`` rows.

    Spark bounds the bytes of a batch (``spark.sql.execution.arrow.maxBytesPerBatch``); slices, which copy
    nothing, bound how much of it becomes Python objects at once.  No setting of the session is touched.
    """
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Memory that nothing holds any more goes back to the machine, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches in a worker that lives on: no spare memory stays in it."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


#: Values of an Arrow function that become Python objects at once, and about how many bytes of binaries or texts.
SLICE_ROWS, SLICE_BYTES = 500, 1 << 20


def in_slices(read: Callable[..., pa.Array], kind: str, *, rows: int = SLICE_ROWS) -> Callable[..., Column]:
    """An Arrow function that ``read`` works out slice by slice, so what it holds does not grow with Spark's batches.

    Slices end by rows, and by the bytes of the first column where that is binary or text.
    """

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        # One column comes by itself, several as a tuple.
        columns = (list(b) if isinstance(b, tuple) else [b] for b in batches)
        whole = (pa.RecordBatch.from_arrays(c, [str(i) for i in range(len(c))]) for c in columns)
        yield from lean(lambda bs: (read(*s.columns) for s in sliced_by_bytes(bs, 0, rows, SLICE_BYTES)))(whole)

    return run


#: Rows are sent on together until there are so many, or so many bytes in them.
MANY_ROWS, MANY_BYTES = 2_000, 1 << 20


def sent_together(files: Iterable[tuple[int, list[tuple]]], types: list[pa.DataType], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows that files have become, each with about how many bytes they hold: small files share a batch, a large one ends it."""
    rows: list[tuple] = []
    held = 0
    for size, own in files:
        rows += own
        held += size
        if rows and (held >= MANY_BYTES or len(rows) >= MANY_ROWS):
            yield _batch(rows, types, columns)
            rows, held = [], 0
    if rows:
        yield _batch(rows, types, columns)


def _batch(rows: list[tuple], types: list[pa.DataType], columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], columns)


def sliced_by_bytes(batches: Iterator[pa.RecordBatch], column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Like :func:`sliced`, for rows of very different lengths: a slice ends, too, where ``column`` has come to ``size`` bytes.

    Only a single longer value makes a slice larger.  Other types are told by their rows alone.
    """
    for b in batches:
        held = b.column(column)
        if not (pa.types.is_binary(held.type) or pa.types.is_string(held.type)):
            yield from sliced(iter([b]), rows)
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(held), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            n = min(rows, max(1, int(np.searchsorted(ends, before + size, "right")) - at))
            yield b.slice(at, n)
            at += n
