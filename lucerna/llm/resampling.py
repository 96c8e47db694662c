"""Target-distribution importance resampling with partition-local word tries.

Features are runs of 1 to ``order`` consecutive words.  Each task holds a trie of words: a node stands
for a run, keeps how often it came and the CRC-32 state of its bytes, so a longer run's checksum goes on
from its parent's.  When a task ends, or its trie is full, the counts go to bucket totals and the trie
starts anew; what tasks send on is one number for each bucket that they met.  From the totals of corpus
and target each bucket gets a gain.  Documents are then scored by walking a trie whose nodes carry gains.

The draw adds to each weight a Gumbel number that only the id decides, and takes the highest scores:
sampling without replacement in proportion to exp(weight / 1000).  Scores are whole numbers in a fixed
range, so counts of bins and then of one bin's scores tell where the draw ends; only what reaches that
score is sorted, by ranges of (score, id), and ranks are offsets of ranges plus places in them.

Rows and edge cases: a null text has no words; a document without features weighs 0; a null id draws
like the empty id and comes after other ids in ties; rows that repeat an id are documents of their own,
ordered by features and weight where score and id are equal; words of any length count (long ones are
not kept in the trie); other columns are ignored; an empty corpus gives nothing, an empty target gives
every bucket its smoothed share.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import slices, write_shared

BUCKETS = 10_000
#: A trie starts anew beyond so many nodes or bytes of words; longer words are counted without a node.
MOST_NODES, MOST_BYTES, LONGEST = 200_000, 16 << 20, 64
#: Bytes of a text that become a list of words at once.
PART = 1 << 20
#: Scores of one bin of the first count, as a power of two.
BIN_BITS = 8
#: Lower-case words of ASCII letters, digits and all other characters; everything else separates.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_parts(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a whole text, in lists of bounded length."""
    plain = (text or b"").translate(_WORD)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PART) if at + PART < len(plain) else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


class WordTrie:
    """Runs of words.  A node is [children, checksum state, bucket, number]; ``value`` gives a new node's number."""

    __slots__ = ("buckets", "held", "nodes", "order", "root", "value")

    def __init__(self, order: int, buckets: int, value: Callable[[int], int]):
        self.order, self.buckets, self.value = order, buckets, value
        self.clear()

    def clear(self) -> None:
        self.root: dict[bytes, list] = {}
        self.nodes = self.held = 0

    def full(self) -> bool:
        return self.nodes > MOST_NODES or self.held > MOST_BYTES

    def child(self, parent: list | None, word: bytes) -> list:
        """The node of ``word`` below ``parent``; a long word gets one that is not kept."""
        children = self.root if parent is None else parent[0]
        if children is None:
            children = parent[0] = {}
        node = children.get(word)
        if node is None:
            state = zlib.crc32(word) if parent is None else zlib.crc32(word, zlib.crc32(b" ", parent[1]))
            bucket = state % self.buckets
            node = [None, state, bucket, self.value(bucket)]
            if len(word) <= LONGEST:
                children[word] = node
                self.nodes += 1
                self.held += len(word)
        return node

    def runs(self, before: list[bytes], part: list[bytes]) -> Iterator[tuple[list, bool]]:
        """(node, kept) of every run that ends in ``part``; it may start in the words before."""
        known = len(before)
        sequence = before + part
        for i in range(len(sequence)):
            node, kept = None, True
            for k, word in enumerate(sequence[i : i + self.order]):
                node, kept = self.child(node, word), kept and len(word) <= LONGEST
                if i + k >= known:
                    yield node, kept


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def _before(order: int, before: list[bytes], part: list[bytes]) -> list[bytes]:
    return (before + part[-order:])[1 - order :] if order > 1 else []


def _count(trie: WordTrie, text: bytes | None, totals: np.ndarray, merge: Callable[[], None]) -> None:
    before: list[bytes] = []
    for part in word_parts(text):
        if trie.order == 1:
            get, child = trie.root.get, trie.child
            for word in part:
                node = get(word) or child(None, word)
                node[3] += 1
                if len(word) > LONGEST:
                    totals[node[2]] += 1
        else:
            for node, kept in trie.runs(before, part):
                if kept:
                    node[3] += 1
                else:
                    totals[node[2]] += 1
        before = _before(trie.order, before, part)
        if trie.full():
            merge()


def _gained(trie: WordTrie, text: bytes | None) -> tuple[int, int]:
    """(words, summed gains of all runs) of one whole text."""
    before: list[bytes] = []
    n = total = 0
    for part in word_parts(text):
        n += len(part)
        if trie.order == 1:
            get, child = trie.root.get, trie.child
            for word in part:
                total += (get(word) or child(None, word))[3]
        else:
            total += sum(node[3] for node, _ in trie.runs(before, part))
        before = _before(trie.order, before, part)
        if trie.full():
            trie.clear()
    return n, total


def bucket_totals(texts: DataFrame, *, order: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: how often features of each bucket occur in the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        trie = WordTrie(order, buckets, lambda bucket: 0)

        def merge() -> None:
            stack = list(trie.root.values())
            while stack:
                node = stack.pop()
                totals[node[2]] += node[3]
                stack.extend((node[0] or {}).values())
            trie.clear()

        for b in slices(batches):
            for text in _bytes(b.column("text")):
                _count(trie, text, totals, merge)
        merge()
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(totals[some], pa.int64())], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, *, buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the logarithm of target share to corpus share, smoothed by one for each bucket."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    s, t = [0] * buckets, [0] * buckets
    # One row for each bucket at most: bounded by the parameter, whatever the corpus.
    for row in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log(((b + 1.0) * all_s) / ((a + 1.0) * all_t))) for a, b in zip(s, t, strict=True)]


def weighed(documents: DataFrame, gain: list[int], *, order: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean gain of a document's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(order, len(gain), gain.__getitem__)
        for b in slices(batches):
            found = [_gained(trie, text) for text in _bytes(b.column("text"))]
            runs = [sum(max(0, n - k) for k in range(order)) for n, _ in found]
            means = [total // n if n else 0 for n, (_, total) in zip(runs, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in ([n for n, _ in found], runs, means))], ["doc_id", "n_words", "n_features", "weight"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _least_drawn(able: DataFrame, percent: int) -> tuple[int, int | None]:
    """(how many are drawn, the score at which the draw ends), by counts of bins and then of one bin's scores.

    Scores are thousandths of logarithms, so both counts have a few hundred rows, whatever the corpus.
    """
    tally = lambda rows, key: sorted(((r["key"], r["n"]) for r in rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).collect()), reverse=True)
    coarse = tally(able, F.shiftright("score", BIN_BITS))
    drawn = sum(n for _, n in coarse) * percent // 100
    left = drawn
    for key, n in coarse if drawn else []:
        if left <= n:
            for score, m in tally(able.filter(F.shiftright("score", BIN_BITS) == key), F.col("score")):
                left -= m
                if left <= 0:
                    return drawn, score
        left -= n
    return 0, None


def resample_to_target(documents: DataFrame, target: DataFrame, *, order: int = 1, buckets: int = BUCKETS, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; rank is null where it is not drawn."""
    spark = documents.sparkSession
    gain = gains(bucket_totals(documents, order=order, buckets=buckets), bucket_totals(target, order=order, buckets=buckets), buckets=buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = weighed(documents, gain, order=order).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    scored, _ = write_shared(scored, "resample-scores")
    able = F.col("n_words") >= least_words
    drawn, last = _least_drawn(scored.filter(able), percent)
    reach = (able & (F.col("score") >= last)) if last is not None else F.lit(False)
    rest = scored.filter(~reach).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if last is None:
        return rest
    down = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row")]
    placed = scored.filter(reach).repartitionByRange(*down).sortWithinPartitions(*down).withColumn("at", F.monotonically_increasing_id())
    placed, _ = write_shared(placed.select("doc_id", "n_features", "weight", "score", "at"), "resample-drawn")
    # A place is the number of a range and a place in it; one row for each range comes to the driver.
    before, offsets = 0, []
    for r in placed.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n")).orderBy("range").collect():
        offsets.append((r["range"], before))
        before += r["n"]
    known = F.broadcast(spark.createDataFrame(offsets, "range long, before long"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("range", F.shiftright("at", 33)).join(known, "range")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank")).unionByName(rest)
