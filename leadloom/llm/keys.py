"""Canonical forms of contact fields as native columns, shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def alnum(c: Column) -> Column:
    """Lower-case letters and digits only; null as ''."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def phone(c: Column) -> Column:
    """Ten digits where the entry has a phone number (country code 1 dropped), else its letters and digits."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]+", "")
    ten = F.when(F.length(digits) == 10, digits).when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10))
    return F.coalesce(ten, alnum(c))


def usable_phones(c: Column) -> Column:
    """Sorted distinct numbers of a list: ten digits, not all equal. Each entry goes through one pattern only."""
    digits = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"[^0-9]+", ""))
    ten = F.transform(digits, lambda d: F.when(F.length(d) == 10, d).when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)))
    return F.array_sort(F.array_distinct(F.filter(ten, lambda d: d.isNotNull() & (F.replace(d, F.substring(d, 1, 1), F.lit("")) != ""))))


def usable_email(c: Column) -> Column:
    """Trimmed, lower-case ``local@host`` with a dot inside the host; null otherwise."""
    e = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(e.rlike(r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"), e)


def entries(c: Column, f) -> Column:
    """Sorted distinct canonical entries of a list; null lists, null and empty entries vanish."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), f), lambda x: x.isNotNull() & (x != ""))))


def url_parts(c: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of a URL: no scheme, user, leading www., default port, fragment; host and path in lower case."""
    u = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))
    u = F.regexp_replace(F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_extract(u, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", ""), r"^www\.", ""), r"\.+$", "")
    return host, F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), F.regexp_extract(u, r"\?(.*)$", 1)


def url(c: Column) -> Column:
    """Canonical URL text: host, path and sorted query parameters without punctuation."""
    host, path, query = url_parts(c)
    params = F.array_sort(F.filter(F.transform(F.split(query, "[&;]"), alnum), lambda x: x != ""))
    return F.concat_ws("|", alnum(host), alnum(path), F.array_join(params, "&"))
