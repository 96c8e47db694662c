"""N-gram Jaccard join with signature trees, exact for every pair of documents.

A document's set holds its distinct word shingles.  Equal sets are joined first and represented by
their smallest id.  A prefix filter then brings together what can link: in one global order of
shingles, rarest first, two linking sets share one of their first n - ceil(t n) + 1.  A set with
that many shingles of its own has no partner and leaves at once, whatever passages it shares.  Sets
that share a filter key form a *family*; links never leave a family.  Families are cut into units of
bounded weight (pairs of size classes and slices, if one family is large), and each unit builds a
signature tree: nodes hold OR-combined token bitmaps and size ranges, and a dual traversal prunes
node pairs by the largest overlap that they allow.  What survives is intersected exactly.  Only
links between representatives' components and link counts leave a unit, never all pairs.

The order counts a shingle's frequency only where the filter can need it: sets of at most ``SMALL``
shingles use all of them, larger ones those whose hash lies in the lowest part (others come after,
by hash).  Sizes where a set could link with one of the other kind use both orders.

The words of a shingle and the least similarity are parameters of a call; the constants are defaults.

Rows and edge cases: null and empty texts have the empty set and no link; a null id is linked with
nothing and has no component; repeated rows are copies of each other; an id that comes with several
texts stands for the smallest of them, in every row; other columns are ignored; an empty table gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import drop_shared, slices, tidy, write_shared
from lucerna.llm.graph import components

SHINGLE_WORDS = 4
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Sets up to SMALL order all their shingles; larger ones only those in the lowest part of the hash range.
SMALL = 120
#: A unit holds at most about so much weight; a set weighs its shingles plus SET_WEIGHT.
UNIT_WEIGHT, SET_WEIGHT = 1_500_000, 400
FANOUT = 8
#: Pairs of nodes or sets that a traversal looks at together.
SLICE = 100_000

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text; only A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < k:
        out = np.full(1, len(words), np.uint64)
        for x in h:
            out = out * _MULTIPLY + x
        return _mix(out)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _MULTIPLY + h[i : i + n]
    return np.unique(_mix(out))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def large_from(percent: int = PERCENT) -> int:
    """Sets from so many shingles on have the order of large sets, so that two linking sets always share an order."""
    return percent * (SMALL + 1) // 100


def lowest_part(percent: int = PERCENT) -> int:
    """The (even) end of the lowest part of the hash range: the prefix's share of a set and some more."""
    return min(int((107 - percent) / 100 * 2**64), 2**63 - 2)


def _sketch(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n, key of the set, and the shingles that each order of the filter may need.

    ``tokens`` holds both orders' shingles; the lowest bit tells which order a token belongs to.
    """
    large_size, low = large_from(percent), np.uint64(lowest_part(percent))
    for b in slices(batches):
        n, keys, tokens, small, large = [], [], [], [], []
        for text in b.column("text").to_pylist():
            s = shingles(text, words)
            n.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            every = s if len(s) <= SMALL else s[:0]
            lowest = s[: max(int(np.searchsorted(s, low)), prefix_length(len(s), percent))] if len(s) >= large_size else s[:0]
            small.append(len(every))
            large.append(len(lowest))
            tokens.append(np.concatenate([every & ~np.uint64(1), lowest | np.uint64(1)]).view(np.int64))
        listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32()), pa.array(np.concatenate(tokens) if tokens else [], pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), listed, pa.array(small, pa.int32()), pa.array(large, pa.int32())], ["doc_id", "n", "key", "tokens", "small", "large"])


def families(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(rep, family) of every set that shares a filter key with another; ``sets`` has rep, n, tokens, small, large."""
    spark = sets.sparkSession
    tokens = sets.select("rep", F.explode("tokens").alias("token"))
    # Each step is written, so that its shuffle is gone before the next one begins.
    counted, counted_path = write_shared(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "frequencies")
    shared, shared_path = write_shared(tokens.join(counted, "token"), "shared")
    drop_shared(spark, counted_path)
    # Shingles of large sets beyond the lowest part come last, by hash alone: how many sets list them says nothing.
    is_large = F.col("token").bitwiseAND(F.lit(1)) == 1
    beyond = is_large & ((F.col("token") < 0) | (F.col("token") >= lowest_part(percent)))
    place = F.struct(beyond.alias("beyond"), F.when(beyond, F.lit(0)).otherwise(F.col("df")).alias("df"), F.when(F.col("token") < 0, F.lit(1)).otherwise(F.lit(0)).alias("high"), "token")
    per = shared.groupBy("rep", is_large.alias("large_order")).agg(F.sort_array(F.collect_list(place)).alias("places"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    own = F.when(F.col("large_order"), F.col("large")).otherwise(F.col("small")) - F.size("places")
    open_places = (prefix - own).cast("int")
    keys = per.join(sets.select("rep", "n", "small", "large"), "rep").filter(open_places > 0).select("rep", F.explode(F.slice("places", F.lit(1), open_places)).alias("p")).select("rep", F.col("p.token").alias("token"))
    keys, path = write_shared(keys, "keys")
    first = keys.groupBy("token").agg(F.min("rep").alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    edges = keys.join(first, "token").filter("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    found = components(edges).select(F.col("node").alias("rep"), F.col("label").alias("family"))
    drop_shared(spark, shared_path, path)
    return found


def units(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Deal members (rep, family, n) to units: (unit, side, rep).

    A family of bounded weight is one unit.  A heavier one is cut by size class (linking sets are in
    the same or adjacent classes) and by hash into slices; every two slices that can link meet in one
    unit, where only pairs of different slices (or one slice with itself) are compared.
    """
    weighed = members.withColumn("w", F.col("n") + SET_WEIGHT)
    total = weighed.groupBy("family").agg(F.sum("w").alias("total"))
    split = weighed.join(total, "family")
    light = split.filter(F.col("total") <= UNIT_WEIGHT).select(F.concat_ws(":", "family").alias("unit"), F.lit(0).alias("side"), "rep")
    heavy = split.filter(F.col("total") > UNIT_WEIGHT).withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int"))
    per = heavy.groupBy("family", "class").agg(F.ceil(F.sum("w") / (UNIT_WEIGHT / 2)).cast("int").alias("m"))
    up = per.select("family", (F.col("class") - 1).alias("class"), F.col("m").alias("m_up"))
    down = per.select("family", (F.col("class") + 1).alias("class"), F.col("m").alias("m_down"))
    h = heavy.join(per, ["family", "class"]).join(up, ["family", "class"], "left").join(down, ["family", "class"], "left")
    h = h.withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int"))
    others = lambda m: F.when(F.coalesce(m, F.lit(0)) > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda c, i, d, j: F.concat_ws(":", F.col("family"), c, i, d, j)
    cls, sl = F.col("class"), F.col("slice")
    same = F.transform(others(F.col("m")), lambda j: F.struct(name(cls, F.least(sl, j), cls, F.greatest(sl, j)).alias("unit"), F.when(sl <= j, F.lit(1)).otherwise(F.lit(2)).alias("side")))
    same = F.transform(same, lambda x: F.struct(x["unit"].alias("unit"), F.when(x["unit"] == name(cls, sl, cls, sl), F.lit(0)).otherwise(x["side"]).alias("side")))
    above = F.transform(others(F.col("m_up")), lambda j: F.struct(name(cls, sl, cls + 1, j).alias("unit"), F.lit(1).alias("side")))
    below = F.transform(others(F.col("m_down")), lambda j: F.struct(name(cls - 1, j, cls, sl).alias("unit"), F.lit(2).alias("side")))
    return light.union(h.select(F.explode(F.concat(same, above, below)).alias("x"), "rep").select("x.unit", "x.side", "rep"))


class SignatureTree:
    """Levels of nodes over sets: OR of bitmaps, size range, and the most shingles of a set that share a bit with another."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets])
        low = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        self.order = np.lexsort((low, size))
        self.sets = [sets[i] for i in self.order]
        self.size = size[self.order]
        bits = 1 << int(np.clip(np.ceil(np.log2(16 * max(1, np.median(size)))), 9, 16))
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        for i, s in enumerate(self.sets):
            at = (s >> np.uint64(20)) & np.uint64(bits - 1)
            np.bitwise_or.at(maps[i], (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        maps = maps.view(np.uint64)
        spare = self.size - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, self.size, self.size, spare)]
        while len(self.levels[-1][0]) > FANOUT:
            m, lo, hi, sp = self.levels[-1]
            at = np.arange(0, len(m), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sp, at)))


def _possible(level: tuple, i: np.ndarray, j: np.ndarray, leaf: bool, percent: int) -> np.ndarray:
    """Whether the sets below nodes i and j can overlap enough."""
    m, lo, hi, spare = level
    fits = (100 * hi[i] >= percent * lo[j]) & (100 * hi[j] >= percent * lo[i])
    keep = np.flatnonzero(fits)
    step = max(1, 1_000_000 // m.shape[1])
    for at in range(0, len(keep), step):
        part = keep[at : at + step]
        a, b = i[part], j[part]
        both = np.bitwise_count(m[a] & m[b]).sum(1, dtype=np.int64)
        if leaf:  # a set's bits outside the other's are shingles that the other lacks
            most = np.minimum(both + spare[a], both + spare[b])
        else:
            most = np.minimum(both + np.minimum(spare[a], spare[b]), np.minimum(hi[a], hi[b]))
        fits[part] = (100 + percent) * most >= percent * (lo[a] + lo[b])
    return fits


def linked_pairs(sets: list[np.ndarray], percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of all sets that link, in bounded slices, by dual traversal and exact intersection."""
    if len(sets) < 2:
        return
    tree = SignatureTree(sets)
    top = len(tree.levels[-1][0])
    i, j = (x.astype(np.int32) for x in np.triu_indices(top))
    stack = [(len(tree.levels) - 1, i, j)]
    while stack:  # depth first in slices, so that the frontier stays small
        depth, i, j = stack.pop()
        if len(i) > SLICE:
            cut = len(i) // 2
            stack += [(depth, i[:cut], j[:cut]), (depth, i[cut:], j[cut:])]
            continue
        if depth == 0:
            apart = i < j
            i, j = i[apart], j[apart]
        ok = _possible(tree.levels[depth], i, j, depth == 0, percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if depth == 0:
            good = _overlapping(tree, i, j, percent)
            yield tree.order[good[0]], tree.order[good[1]]
            continue
        below = len(tree.levels[depth - 1][0])
        fan = np.arange(FANOUT, dtype=np.int32)
        ci = np.broadcast_to(FANOUT * i[:, None, None] + fan[None, :, None], (len(i), FANOUT, FANOUT)).ravel()
        cj = np.broadcast_to(FANOUT * j[:, None, None] + fan[None, None, :], (len(i), FANOUT, FANOUT)).ravel()
        real = (ci < below) & (cj < below) & (ci <= cj)
        stack.append((depth - 1, ci[real], cj[real]))


def _overlapping(tree: SignatureTree, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose intersection is large enough, counted exactly."""
    by = np.argsort(i, kind="stable")
    i, j = i[by], j[by]
    good = np.zeros(len(i), bool)
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    for lo, hi in zip(starts, np.r_[starts[1:], len(i)], strict=True):
        mine = tree.sets[i[lo]]
        for a in range(lo, hi, 512):
            js = j[a : min(hi, a + 512)]
            flat = np.concatenate([tree.sets[x] for x in js])
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            sizes = tree.size[js]
            common = np.add.reduceat(mine[at] == flat, np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
            good[a : a + len(js)] = (100 + percent) * common >= percent * (len(mine) + sizes)
    return i[good], j[good]


class Reach:
    """The smallest index reachable from each index over the pairs added so far."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def labels(self) -> np.ndarray:
        """The root of each index; every path becomes one step long."""
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.labels()
        new = np.unique(np.stack([label[i], label[j]], 1)[label[i] != label[j]], axis=0)
        for a, b in new.tolist():
            a, b = self.root(a), self.root(b)
            self.parent[max(a, b)] = min(a, b)


def _join_unit(t: pa.Table, words: int, percent: int) -> pa.Table:
    """Links inside one unit: for each set the smallest set that it reaches here, and its linked documents."""
    t = t.sort_by([("rep", "ascending"), ("side", "ascending")])
    rep, side, copies = (t.column(c).to_numpy() for c in ("rep", "side", "copies"))
    links, reach = np.zeros(len(rep)), Reach(len(rep))
    for i, j in linked_pairs([shingles(x.as_py(), words) for x in t.column("text")], percent):
        apart = (side[i] != side[j]) | (side[i] == 0)
        i, j = i[apart], j[apart]
        links += np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        reach.add(i, j)
    some = links > 0
    return pa.table({"a": rep[some], "b": rep[reach.labels()][some], "links": links[some].astype(np.int64)})


def one_text_per_id(texts: DataFrame) -> DataFrame:
    """Rows with the smallest text of their id; only ids with several texts, told by hashes, are joined."""
    hashed = texts.filter("doc_id IS NOT NULL AND text IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    odd, path = write_shared(hashed.filter("lo <> hi").select("doc_id"), "several")
    if odd.isEmpty():
        drop_shared(texts.sparkSession, path)
        return texts
    own = texts.join(odd, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("own"))
    return texts.join(own, "doc_id", "left").select("doc_id", F.coalesce("own", "text").alias("text"))


def ngram_components(documents: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, and n_links: how many other documents each document links with.

    Sets of shingles of ``words`` words link from a Jaccard similarity of ``percent`` hundredths on.
    """
    spark = documents.sparkSession
    texts = one_text_per_id(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    sketches, sketch_path = write_shared(texts.mapInArrow(tidy(lambda batches: _sketch(batches, words, percent)), "doc_id long, n long, key binary, tokens array<long>, small int, large int"), "sketches")
    ids, _ = write_shared(sketches.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")), "ids")
    classes = ids.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes, class_path = write_shared(classes, "classes")
    first = classes.select(F.col("key").alias("k"), "rep")
    sets = sketches.join(first, (F.col("key") == F.col("k")) & (F.col("doc_id") == F.col("rep"))).dropDuplicates(["key", "doc_id"]).select("rep", "n", "tokens", "small", "large")
    sizes, size_path = write_shared(sets, "sets")
    drop_shared(spark, sketch_path)
    family = families(sizes, percent)
    members = family.join(sizes.select("rep", "n"), "rep").join(classes.select("rep", "copies"), "rep").dropDuplicates(["rep"])
    members, member_path = write_shared(members, "members")
    drop_shared(spark, size_path)  # the largest table; only members' texts are needed from here on
    dealt = units(members.select("rep", "family", "n"), percent)
    held = texts.join(members.select("rep", "copies"), texts["doc_id"] == F.col("rep")).dropDuplicates(["rep"]).select("rep", "copies", "text")
    joined = dealt.join(held, "rep").groupBy("unit").applyInArrow(lambda t: _join_unit(t, words, percent), "a long, b long, links long")
    joined, joined_path = write_shared(joined, "links")
    label = components(joined.select("a", "b"))
    links = joined.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    found = links.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left")
    of = classes.join(found, "rep", "left").select("key", F.coalesce("label", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of, _ = write_shared(of, "of")
    drop_shared(spark, class_path, member_path, joined_path)
    return ids.join(of, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
