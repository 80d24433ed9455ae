"""Text expressions: keys, labels, searching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def admin_key(country: Column, admin1: Column) -> Column:
    """``country.admin1``; null if either is."""
    return F.concat(country, F.lit("."), admin1)


def long_name(*parts: Column) -> Column:
    """Parts joined by comma and space; null if any is."""
    out = [parts[0]]
    for p in parts[1:]:
        out += [F.lit(", "), p]
    return F.concat(*out)


def label(name: Column, region: Column, country: Column) -> Column:
    """Display form: missing and empty regions and countries are left out."""
    return F.concat_ws(", ", name, F.nullif(region, F.lit("")), F.nullif(country, F.lit("")))


def or_default(value: Column, default: str = "No region") -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def packed_name(name: Column) -> Column:
    """A name as it comes out of the token columns: without any white space."""
    return F.regexp_replace(name, r"(?U)\s+", "")


def name_words(name: Column) -> Column:
    """Words and punctuation runs of a name, Unicode-aware; white space is dropped."""
    return F.regexp_extract_all(name, F.lit(r"(?U)(\w+|[^\w\s]+)"), F.lit(1))


def search_terms(text: Column) -> Column:
    """Distinct search terms: ASCII letter and digit runs in lower case; other letters belong to runs."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda t: t != ""))


def term_places(text: Column) -> Column:
    """All search terms of ``text`` in their order, repeats kept; none of null.  Only ASCII letters are made small."""
    small = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.filter(F.split(small, r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda t: t != ""), F.array().cast("array<string>"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def fixed(n: Column, digits: int) -> Column:
    """``n`` with so many decimals, as coordinates, sizes and times are shown."""
    return F.format_string(f"%.{digits}f", n.cast("double"))


def coordinate_label(name: Column, lat: Column, lon: Column, region: Column, country: Column) -> Column:
    """A sample row as a line: name (lat, lon) - region, country."""
    return F.format_string("%s (%.4f, %.4f) - %s, %s", name, lat, lon, or_default(region), country)


def base36(n: Column, digits: int) -> Column:
    """The last so many base-36 digits of ``n``, in lower case: invented keys to probe with."""
    return F.lower(F.right(F.lpad(F.conv(n.cast("string"), 10, 36), digits, "0"), F.lit(digits)))
