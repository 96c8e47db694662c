"""Corpus roll-ups: spans of dates, previews, distinct people, counts by group, lists of notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_span(rows: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """How many stamps, the first and the last, compared as text; empty stamps do not count."""
    s = F.when(F.col(stamp) != "", F.col(stamp))
    return rows.groupBy(*keys).agg(F.count(s).alias("marks"), F.min(s).alias("first"), F.max(s).alias("last")).filter("marks > 0")


def first_few(values: Column, show: int = 3, joint: str = " · ") -> Column:
    """The first ``show`` of a sorted list of distinct texts, and how many more there are."""
    shown = F.array_join(F.slice(values, 1, show), joint)
    return F.when(F.size(values) > show, F.concat(shown, F.lit(" (+"), (F.size(values) - show).cast("string"), F.lit(" más)"))).otherwise(shown)


def stamp_preview(rows: DataFrame, keys: list[str], stamp: str, show: int = 3) -> DataFrame:
    """Distinct sorted stamps of each key, shortened.

    Only the smallest few and the number of distinct stamps are needed, so stamps are made distinct
    before they are gathered.
    """
    distinct = rows.select(*keys, stamp).filter(F.col(stamp).isNotNull()).distinct()
    return distinct.groupBy(*keys).agg(first_few(F.array_sort(F.collect_list(stamp)), show).alias("preview"))


def people(rows: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """Distinct names of each key in the order in which they first occur: n_people and people."""
    first = rows.filter(F.coalesce(F.trim(F.col(name)), F.lit("")) != "").groupBy(*keys, name).agg(F.min(order).alias("__o"))
    listed = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__o", name))).alias("__l"))
    return listed.select(*keys, F.size("__l").cast("long").alias("n_people"), F.array_join(F.transform("__l", lambda x: x[name]), ", ").alias("people"))


def by_group(findings: DataFrame) -> DataFrame:
    """Findings and personal ones for each group over the whole corpus."""
    return findings.groupBy("grp").agg(F.count("*").alias("findings"), F.count_if(F.col("sev") == "personal").alias("personal"), F.countDistinct("doc_id").alias("documents"))


def pending(findings: DataFrame) -> DataFrame:
    """Distinct labels of what survives cleaning, by document."""
    return findings.filter("keep").select("doc_id", "grp", "label").distinct()


def notes(counters: dict[str, Column]) -> Column:
    """Ordered distinct texts of counters above zero."""
    return F.array_distinct(F.filter(F.array(*(F.when(c > 0, F.lit(text)) for text, c in counters.items())), lambda x: x.isNotNull()))


def roll_up(stats: DataFrame, column: str) -> DataFrame:
    """Corpus totals of a map of counters."""
    return stats.select(F.explode(column).alias("counter", "n")).groupBy("counter").agg(F.sum("n").alias("total"), F.count("*").alias("documents"))
