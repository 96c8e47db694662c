"""File and part names: safe names, output names, package paths, sizes and packed time stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default name, longest name, and what is kept of a longer one.
DEFAULT_NAME, LONGEST, HEAD, TAIL = "archivo", 150, 140, 10
#: Fixed value: what a cleaned file's name gets before its extension.
CLEAN_SUFFIX = " - sin metadatos"


def safe_name(raw: Column) -> Column:
    """Last path segment without control characters and leading dots; never empty, never long."""
    last = F.element_at(F.split(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\\/]+", "/"), "/"), -1)
    base = F.trim(F.regexp_replace(F.regexp_replace(last, r"[\x00-\x1f\x7f]", ""), r"^\.+", ""))
    name = F.when(base == "", F.lit(DEFAULT_NAME)).otherwise(base)
    return F.when(F.char_length(name) > LONGEST, F.concat(F.left(name, F.lit(HEAD)), F.right(name, F.lit(TAIL)))).otherwise(name)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def extension(name: Column) -> Column:
    """The extension with its dot; empty without one (a name without a dot stays without)."""
    return F.regexp_extract(name, r"\.[^.]*$", 0)


def output_name(name: Column) -> Column:
    return F.concat(stem(name), F.lit(CLEAN_SUFFIX), extension(name))


def resolve_path(base: Column, target: Column) -> Column:
    """A relative target against a folder, with ``.`` and ``..`` worked out; a rooted target stands alone."""
    whole = F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(F.coalesce(base, F.lit("")), target))
    step = lambda done, part: F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(part.isin("", "."), done).otherwise(F.concat(done, F.array(part)))
    worked = F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")
    # Most have no such step and stay as they are.
    bare = F.when(F.startswith(whole, F.lit("/")), F.substr(whole, F.lit(2))).otherwise(whole)
    return F.when(~bare.rlike(r"(^|/)\.{0,2}(/|$)"), bare).otherwise(worked)


def relations_owner(name: Column) -> Column:
    """The folder that targets of a relationship part are relative to."""
    return F.regexp_extract(name, r"^(.*?)_rels/[^/]*$", 1)


def human_size(n: Column) -> Column:
    """Bytes, KB with one decimal, MB with two."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_string("%.1f", F.round(n / F.lit(1024.0), 1)), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.2f", F.round(n / F.lit(1048576.0), 2)), F.lit(" MB")))


def packed_stamp(time: Column, date: Column) -> Column:
    """A package entry's packed date and time as text; impossible values stay readable."""
    bits = lambda c, shift, mask: F.shiftright(c, shift).bitwiseAND(F.lit(mask))
    return F.format_string("%d-%02d-%02d %02d:%02d:%02d", F.lit(1980) + bits(date, 9, 0x7F), bits(date, 5, 0x0F), bits(date, 0, 0x1F), bits(time, 11, 0x1F), bits(time, 5, 0x3F), bits(time, 0, 0x1F) * 2)
