"""Product lists of a deployment: canonical order, unknown names, published routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Products in their canonical order, and their routes.
PRODUCTS = ("clean", "scan", "secrets")


def _named(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != "")


def products(text: Column) -> Column:
    """The known products that a comma-separated list names, in canonical order whatever the list's; all for an empty list."""
    named = _named(text)
    return F.when(F.size(named) == 0, F.array(*map(F.lit, PRODUCTS))).otherwise(F.filter(F.array(*map(F.lit, PRODUCTS)), lambda p: F.array_contains(named, p)))


def unknown(text: Column) -> Column:
    """Names in the list that are no product."""
    return F.array_sort(F.array_except(_named(text), F.array(*map(F.lit, PRODUCTS))))


def routes(text: Column) -> Column:
    """Routes that are published: those of active products."""
    return F.transform(products(text), lambda p: F.concat(F.lit("/v1/"), p))


def networks(text: Column) -> Column:
    """Networks of a comma-separated list, each once, in the order in which they first come."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


#: Under which name a product's price is told.
PRICE_FIELDS = {"clean": "precio", "scan": "precioScan", "secrets": "precioSecrets"}


def prices(active: Column, price_of: dict[str, Column]) -> Column:
    """Prices of active products by the names under which they are told: nothing of a product that is not served."""
    entries = F.array(*(F.struct(F.lit(PRICE_FIELDS[p]).alias("key"), price_of[p].alias("value"), F.lit(p).alias("product")) for p in PRODUCTS))
    served = F.filter(entries, lambda e: F.array_contains(active, e["product"]))
    return F.map_from_entries(F.transform(served, lambda e: F.struct(e["key"], e["value"])))


def decimals(text: Column) -> Column:
    """Decimals of a token: 6 where none are told, null where the text is no whole number from 0 to 18."""
    given = F.coalesce(F.trim(text), F.lit(""))
    value = F.when(given.rlike("^[0-9]{1,2}$"), given).try_cast("int")
    return F.when(given == "", F.lit(6)).when(value <= 18, value)


def ledger_path(text: Column) -> Column:
    """Where the ledger goes: nowhere (null) for an empty text or ``off``."""
    given = F.trim(F.coalesce(text, F.lit("")))
    return F.when((given != "") & (F.lower(given) != "off"), given)
