"""Prices, base units, network families and checked numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a price may look like.
PRICE = r"^\$?[0-9]+(\.[0-9]+)?$"
#: Names of the two network families and how their identifiers look.
FAMILIES = {"evm": r"^eip155:[0-9]+$", "svm": r"^solana:[A-Za-z0-9]+$"}


def price(text: Column) -> Column:
    """``$`` and the number; null where the text is no price."""
    bare = F.trim(text)
    return F.when(bare.rlike(PRICE), F.concat(F.lit("$"), F.regexp_replace(bare, r"^\$", "")))


def base_units(text: Column, decimals: int) -> Column:
    """The amount of a price in the smallest units of a token, exactly; rounded down beyond its decimals."""
    amount = F.regexp_replace(price(text), r"^\$", "").cast("decimal(20,10)")
    return F.floor(amount * F.lit(10**decimals).cast("decimal(18,0)")).cast("decimal(38,0)")


def network_family(network: Column) -> Column:
    out = F.lit(None).cast("string")
    for family, pattern in FAMILIES.items():
        out = F.when(network.rlike(pattern), F.lit(family)).otherwise(out)
    return out


def positive_int(text: Column) -> Column:
    """The whole number above zero that a text holds, else null."""
    value = F.when(F.trim(text).rlike("^[0-9]{1,18}$"), F.trim(text)).try_cast("bigint")
    return F.when(value > 0, value)


def port(text: Column) -> Column:
    value = F.when(F.trim(text).rlike("^[0-9]{1,5}$"), F.trim(text)).try_cast("int")
    return F.when(value.between(0, 65535), value)
