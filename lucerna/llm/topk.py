"""Exact top-k by distributed histogram selection.

Every query is scored against every candidate, block by block.  A round sums score histograms over
all blocks and finds, for each query, the bin that holds its k-th value; the next round splits that
bin.  When bins are one score wide the k-th value is known, and a last scoring keeps what reaches
it, ties in the order of ids.  A block only reports bins from its own k-th value upwards: lower bins
cannot hold the global one.  What moves is therefore at most k numbers for each query and block.

Rows and edge cases: vectors that are null or hold null or non-finite components, and null ids, take
no part; a repeated id counts once, with its smallest vector; vectors of another length than the
query's are not compared with it; fewer than k candidates give them all; an empty table gives nothing.
Components so large that a score may not fit a long are refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.llm.common import drop_shared, slices, write_shared
from lucerna.sources.shared import sliced

CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 512
#: Bytes of a block's vectors, whatever their length: longer vectors make shorter blocks.
BLOCK_BYTES = 32 << 20
#: Bins of one round, as a power of two.
BIN_BITS = 12
#: Candidate blocks of one group; each group meets every query block, so work is dealt as finely as there are blocks.
GROUP_BLOCKS = 4


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * component) for usable vectors."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    usable = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    v = v.filter(usable).groupBy("vec_id").agg(F.min("e").alias("e"))
    return v.select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("q"))


def _blocks(rows: DataFrame, limit: int) -> DataFrame:
    """Vectors of one length packed into rows of at most ``limit`` vectors and BLOCK_BYTES bytes.

    A block's number is its place among all blocks: it holds from the time that the table is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def emit(dim: int) -> pa.RecordBatch:
            ids, vs = held.pop(dim)
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            raw = np.array(ids, "<i8")[order].tobytes()
            data = np.array(vs, "<i8").reshape(len(ids), dim)[order]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([raw]), pa.array([data.tobytes()])], ["dim", "ids", "data"])

        for b in slices(batches):
            q = b.column("q")
            flat, at = q.values.to_numpy(zero_copy_only=False), q.offsets.to_numpy()
            for i, vec in enumerate(b.column("vec_id").to_pylist()):
                v = flat[at[i] : at[i + 1]]
                ids, vs = held.setdefault(len(v), ([], []))
                ids.append(vec)
                vs.append(v)
                if len(ids) == max(1, min(limit, BLOCK_BYTES // (8 * max(1, len(v))))):
                    yield emit(len(v))
        for dim in list(held):
            yield emit(dim)

    return rows.mapInArrow(run, "dim int, ids binary, data binary").withColumn("block", F.monotonically_increasing_id())


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and integer scores; a query's own row gets the least integer."""
    dim = row["dim"]
    qid, cid = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
    q, c = np.frombuffer(row["q_data"], "<i8").reshape(len(qid), dim), np.frombuffer(row["data"], "<i8").reshape(len(cid), dim)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, dim)
    s = (q.astype(float) @ c.T.astype(float)).astype(np.int64) if most < 2**53 else q @ c.T
    s[qid[:, None] == cid[None, :]] = np.iinfo(np.int64).min
    return qid, cid, s


def _histogram(row: dict, width: int, k: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Counts of the bins, ``width`` scores wide, from this block's own need-th value upwards, inside each query's open bin."""
    qid, _, s = _scores(row)
    least = np.iinfo(np.int64).min
    low = np.frombuffer(row["low"], "<i8") if row["low"] is not None else np.full(len(qid), least + 1)
    high = np.frombuffer(row["high"], "<i8") if row["high"] is not None else np.full(len(qid), np.iinfo(np.int64).max)
    need = np.frombuffer(row["need"], "<i8") if row["need"] is not None else np.full(len(qid), k)
    s = np.where((s >= low[:, None]) & (s <= high[:, None]), s, least)
    take = min(k, s.shape[1])
    top = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take :]
    top.sort(axis=1)
    ids, bins, counts = [], [], []
    for i in range(len(qid)):
        n = min(take, int(need[i]))
        if n <= 0 or top[i, -1] == least:
            continue
        edge = max(top[i, take - n], least + 1)
        floor = (int(edge) // width) * width if edge > least + 1 else int(low[i])
        mine = s[i][(s[i] >= floor) & (s[i] > least)]
        b, c = np.unique(mine // width, return_counts=True)
        ids.append(np.full(len(b), qid[i]))
        bins.append(b)
        counts.append(c)
    return ids, bins, counts


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50) -> DataFrame:
    """The k best candidates of each vector whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows, row_path = write_shared(quantised(vectors), "vectors")
    stats = rows.agg(F.max(F.array_max(F.transform("q", lambda x: F.abs(x.cast("double"))))).alias("most"), F.max(F.size("q")).alias("dim")).first()
    bound = max(1, int(stats["most"] or 0) ** 2 * max(1, stats["dim"] or 1))
    if bound >= 2**63:
        raise ValueError("scores of these vectors do not fit a long")
    blocks, block_path = write_shared(_blocks(rows, CANDIDATE_BLOCK), "blocks")
    groups = max(1, -(-blocks.count() // GROUP_BLOCKS))
    candidates = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(groups)))
    asked = rows.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    queries, query_path = write_shared(_blocks(asked.repartition(max(1, -(-asked.count() // QUERY_BLOCK))), QUERY_BLOCK).select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "queries")
    bits = max(0, (2 * bound + 1).bit_length() - BIN_BITS)
    state, paths = None, []

    def pairs(state: DataFrame | None) -> DataFrame:
        q = queries
        if state is None:
            q = q.withColumns({c: F.lit(None).cast("binary") for c in ("low", "high", "need")})
        else:
            q = q.join(state, "q_block", "left")
        q = q.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        return candidates.join(q, ["dim", "salt"]).select("dim", "ids", "data", "q_block", "q_ids", "q_data", "low", "high", "need")

    def counted(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches, 1):
                for row in b.to_pylist():
                    got = _histogram(row, width, k)
                    if got[0]:
                        a = [np.concatenate(x).astype(np.int64) for x in got]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[0]), row["q_block"])), *map(pa.array, a)], ["q_block", "query_id", "bin", "n"])

        return run

    while True:
        width = 1 << bits
        sums = pairs(state).mapInArrow(counted(width), "q_block long, query_id long, bin long, n long").groupBy("q_block", "query_id", "bin").agg(F.sum("n").alias("n"))
        if state is not None:
            # What is still needed inside the open bin comes from the state's packed arrays.
            sums = sums.join(needs, ["q_block", "query_id"])
        else:
            sums = sums.withColumn("still", F.lit(k).cast("long"))
        down = Window.partitionBy("q_block", "query_id").orderBy(F.desc("bin"))
        cum = sums.withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.lead("bin").over(down).isNull())
        at = cum.filter((F.col("upto") - F.col("n") < F.col("still")) & ((F.col("upto") >= F.col("still")) | F.col("last")))
        needs = at.select("q_block", "query_id", (F.col("still") - F.col("upto") + F.col("n")).alias("still"), (F.col("bin") * width).alias("low"), ((F.col("bin") + 1) * width - 1).alias("high"))
        needs, need_path = write_shared(needs, "selected")
        if paths:
            drop_shared(spark, *paths)
        paths, state = [need_path], _packed(queries, needs)
        if bits == 0:
            break
        bits = max(0, bits - BIN_BITS)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            for row in b.to_pylist():
                qid, cid, s = _scores(row)
                low = np.frombuffer(row["low"], "<i8")
                out: list[list[np.ndarray]] = [[], [], []]
                for i in range(len(qid)):
                    keep = np.flatnonzero((s[i] >= low[i]) & (s[i] > np.iinfo(np.int64).min))
                    keep = keep[np.lexsort((cid[keep], -s[i][keep]))][:k]
                    for x, y in zip(out, (np.full(len(keep), qid[i]), cid[keep], s[i][keep]), strict=True):
                        x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kept, _ = write_shared(pairs(state).mapInArrow(final, "query_id long, vec_id long, score long"), "kept")
    drop_shared(spark, row_path, block_path, query_path, *paths)
    return kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed(queries: DataFrame, needs: DataFrame) -> DataFrame:
    """low, high and need of a query block's queries, in the block's order; at most QUERY_BLOCK of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for row in b.to_pylist():
                by = {x["query_id"]: x for x in row["found"] or []}
                ids = np.frombuffer(row["q_ids"], "<i8").tolist()
                none = {"low": np.iinfo(np.int64).min + 1, "high": np.iinfo(np.int64).max, "still": 0}
                cols = [np.array([by.get(i, none)[c] for i in ids], "<i8").tobytes() for c in ("low", "high", "still")]
                yield pa.RecordBatch.from_arrays([pa.array([row["q_block"]]), *(pa.array([c]) for c in cols)], ["q_block", "low", "high", "need"])

    grouped = needs.groupBy("q_block").agg(F.collect_list(F.struct("query_id", "low", "high", "still")).alias("found"))
    return queries.select("q_block", "q_ids").join(grouped, "q_block", "left").mapInArrow(run, "q_block long, low binary, high binary, need binary")
