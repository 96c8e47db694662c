"""Texts and bytes: digests, strict decoding, base64 limits and bounded extraction from markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def strict_text(content: Column) -> Column:
    """The text of valid UTF-8 bytes, else null: bad bytes are refused, not replaced."""
    return F.try_validate_utf8(content.cast("string"))


def base64_fits(encoded: Column, most: int) -> Column:
    """Whether a base64 text can decode to at most ``most`` bytes (with a tenth of slack), told by its length alone."""
    return F.length(encoded) * F.lit(0.75) <= F.lit(most * 1.1)


def meta_content(html: Column, name: str, within: int = 8000) -> Column:
    """The content of a named meta element within the first characters."""
    return F.regexp_extract(F.left(html, F.lit(within)), f"<meta name=\"{name}\" content=\"([^\"]*)\"", 1)


def printable(content: Column, most: int) -> Column:
    """The first bytes as Latin-1 text, other characters as blanks."""
    return F.regexp_replace(F.decode(F.substring(content, 1, most), "ISO-8859-1"), r"[^\x20-\x7e\xa0-\xff]+", " ")


def escape_markup(text: Column) -> Column:
    """The four characters that markup needs escaped."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for plain, code in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out
