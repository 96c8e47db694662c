"""Relational shapes of document packages: who is missing, who wins, what is reachable.

Every function takes and returns DataFrames; keys are column lists that include the document, so the
work of one package is never more than rows that share its keys.  Joins by such keys are merged, never
broadcast: rows of ids take so few bytes in a file that Spark would send millions of them through the driver.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.sources.shared import drop_shared, in_slices, write_shared


def dangling(refs: DataFrame, targets: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``refs`` whose key (ref column -> target column) no row of ``targets`` has."""
    keys = targets.select(*(F.col(t).alias(f"__{t}") for t in on.values())).distinct()
    met = [refs[r] == keys[f"__{t}"] for r, t in on.items()]
    return refs.join(keys.hint("merge"), met, "left_anti")


def gap_fill(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """All of ``first``, and the rows of ``second`` whose keys it lacks."""
    return first.unionByName(second.join(first.select(*on).distinct().hint("merge"), on, "left_anti"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the highest ``order`` for each key.

    An aggregate, not a window: it combines before the shuffle, so a hot key costs one row a task.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__b"))
    return best.select(*keys, *(F.col(f"__b.{c}").alias(c) for c in rest)).select(*rows.columns)


def first_wins(sections: DataFrame, keys: list[str], rank: list[str]) -> DataFrame:
    """The row of the smallest rank for each key: what a chain of sections says, newest first."""
    rest = [c for c in sections.columns if c not in keys]
    best = sections.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*rank)).alias("__b"))
    return best.select(*keys, *(F.col(f"__b.{c}").alias(c) for c in rest)).select(*sections.columns)


def span_ends(rows: DataFrame, keys: list[str], start: str, last: Column) -> DataFrame:
    """Add ``span_end``: the next start within the key, or ``last`` behind the final one."""
    return rows.withColumn("span_end", F.coalesce(F.lead(start).over(Window.partitionBy(*keys).orderBy(start)), last))


def number_names(rows: DataFrame, name: str, order: str, *, span: int = 100_000) -> DataFrame:
    """Add ``unique_name``: the second row of a name gets `` (2)`` before its extension, and so on.

    ``order`` is a whole number.  Rows are numbered within spans of it, and each span starts after the
    rows of those before it, so no task sorts all rows of a frequent name.
    """
    cut = rows.withColumn("__span", F.floor(F.col(order) / span))
    counts = cut.groupBy(name, "__span").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(name).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(name, "__span", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(name, "__span").orderBy(order))
    numbered = cut.withColumn("__n", within).join(counts, [name, "__span"]).withColumn("__n", F.col("__n") + F.col("__before"))
    stem, ext = F.regexp_replace(name, r"\.[^.]+$", ""), F.regexp_extract(name, r"\.[^.]+$", 0)
    unique = F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), F.col("__n").cast("string"), F.lit(")"), ext))
    return numbered.withColumn("unique_name", unique).drop("__n", "__span", "__before")


def running_limits(files: DataFrame, request: str, order: str, size: str, *, most_files: int, most_bytes: int, most_request: int) -> DataFrame:
    """Add ``accepted`` and ``reason``: too large alone, too many before it, or too many bytes with those before it."""
    up_to = Window.partitionBy(request).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    reason = (
        F.when(F.col(size) > most_bytes, "file too large")
        .when(F.count("*").over(up_to) > most_files, "too many files")
        .when(F.sum(size).over(up_to) > most_request, "request too large")
    )
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def package_diff(before: DataFrame, after: DataFrame, on: list[str], compare: str) -> DataFrame:
    """Keys that were removed, added or changed between two tables: on..., change."""
    a = before.select(*on, F.col(compare).alias("__a"), F.lit(True).alias("__in_a"))
    b = after.select(*on, F.col(compare).alias("__b"), F.lit(True).alias("__in_b"))
    change = F.when(F.col("__in_b").isNull(), "removed").when(F.col("__in_a").isNull(), "added").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return a.join(b, on, "full_outer").select(*on, change.alias("change")).filter(F.col("change").isNotNull())


def union_ranges(ranges: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The ranges [start, end) of each key with those that touch or overlap joined into one.

    A range begins a new island where the running maximum of the ends before it lies before its start.
    """
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = ranges.filter(F.col(start) < F.col(end)).withColumn("__new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    island = apart.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def cut_ranges(rows: DataFrame, ranges: DataFrame, keys: list[str], text: str, start: str, end: str) -> DataFrame:
    """``rows`` whose ``text`` lacks the ranges [start, end) of its key, places from 0: what is left is the complement of their union."""
    joined = union_ranges(ranges, keys, start, end).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(start).cast("int").alias("a"), F.col(end).cast("int").alias("b")))).alias("__r"))
    begins = F.concat(F.array(F.lit(0)), F.transform("__r", lambda r: r["b"]))
    ends = F.concat(F.transform("__r", lambda r: r["a"]), F.array(F.char_length(text)))
    kept = F.array_join(F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda p: F.substr(F.col(text), p["b"] + 1, F.greatest(p["e"] - p["b"], F.lit(0)))), "")
    out = rows.join(joined.hint("merge"), keys, "left").withColumn(text, F.when(F.col("__r").isNull(), F.col(text)).otherwise(kept))
    return out.select(*rows.columns)


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the folder that the cluster shares, and read it back."""
    return write_shared(df, label)[0]


#: Rounds of :func:`reachable` after which what was found so far is written as one table again.
ROUNDS_OF_A_TABLE = 16


def reachable(edges: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes (keys..., node) reachable from the roots over edges (keys..., src, dst), cycles included.

    For graphs of any size: each round joins only the newest nodes with the edges and drops those already
    seen.  Rounds are written to the shared folder, so lost executors do not recompute the chain, and
    joined into one table now and then, so plans stay small.  A deep graph takes a round for each step;
    graphs that are small each, such as files, are walked by :func:`reachable_each`.
    """
    spark = edges.sparkSession
    edges, edge_path = write_shared(edges.select(*keys, "src", "dst").distinct(), "graph")
    seen, path = write_shared(roots.select(*keys, "node").distinct(), "seen")
    paths, front = [path], seen
    while True:
        step = front.withColumnRenamed("node", "src").join(edges, [*keys, "src"]).select(*keys, F.col("dst").alias("node")).distinct()
        front, path = write_shared(step.join(seen, [*keys, "node"], "left_anti"), "front")
        paths.append(path)
        if front.isEmpty():
            whole, _ = write_shared(seen, "reached")
            drop_shared(spark, edge_path, *paths)
            return whole
        seen = seen.unionByName(front)
        if len(paths) > ROUNDS_OF_A_TABLE:
            seen, path = write_shared(seen, "seen")
            drop_shared(spark, *paths[:-1])
            paths = [paths[-1], path]


def reachable_each(edges: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """Like :func:`reachable`, for many graphs that are small each: every key's edges are walked in one task.

    A single shuffle, whatever the depth.  What a group holds is two numbers for each reference of one
    file; the file itself, with these references spelled out, has been one row before.
    """
    e = edges.select(*keys, "src", "dst").unionByName(roots.select(*keys, F.lit(None).cast(edges.schema["src"].dataType).alias("src"), F.col("node").cast(edges.schema["dst"].dataType).alias("dst")))
    kind = edges.schema["dst"].dataType.simpleString()

    def walk(graphs: pa.Array) -> pa.Array:
        bounds = [x - graphs.offsets[0].as_py() for x in graphs.offsets.to_pylist()]
        flat = graphs.values.slice(graphs.offsets[0].as_py(), bounds[-1])
        src, dst = flat.field("src").to_pylist(), flat.field("dst").to_pylist()
        out = []
        for begin, end in zip(bounds, bounds[1:], strict=False):
            near, stack = defaultdict(list), []
            for a, b in zip(src[begin:end], dst[begin:end], strict=True):
                (stack if a is None else near[a]).append(b)
            seen = set(stack)
            stack = list(seen)
            while stack:
                for x in near.get(stack.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        stack.append(x)
            out.append(list(seen))
        return pa.array(out, pa.list_(flat.type.field("dst").type))

    return e.groupBy(*keys).agg(F.collect_list(F.struct("src", "dst")).alias("__g")).select(*keys, F.explode(in_slices(walk, f"array<{kind}>")("__g")).alias("node"))
