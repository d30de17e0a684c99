"""Facts from page text and HTML as native column expressions."""

from __future__ import annotations

import html as html_lib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions import fixed, urls


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern; [] for null."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def first(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match, trimmed; null if there is none or it is empty."""
    return blank_to_null(F.trim(F.regexp_extract(c, pattern, group)))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body names it: it is bound as the variable of a lambda."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def truthy(c: Column) -> Column:
    """Strings: neither null nor empty."""
    return c.isNotNull() & (c != "")


def lines(c: Column) -> Column:
    return F.transform(F.split(F.coalesce(c, F.lit("")), r"\R"), lambda x: F.trim(x))


def emails(c: Column, strict: bool = False) -> Column:
    """Sorted distinct addresses in lower case without known non-contacts. ``strict`` also drops image names like logo@2x.png."""

    def keep(m: Column) -> Column:
        name, host = F.lower(F.substring_index(m, "@", 1)), F.lower(F.substring_index(m, "@", -1))
        ok = ~host.isin(fixed.IGNORED_MAIL_HOSTS) & ~name.isin(fixed.IGNORED_MAIL_NAMES) & ~name.rlike(fixed.IMAGE_NAME)
        return ok & ~host.rlike(r"^\dx\.(png|jpg|jpeg|gif|svg|webp)$") if strict else ok

    return F.array_sort(F.array_distinct(F.transform(F.filter(found(c, fixed.EMAIL), keep), F.lower)))


def mailto_emails(html: Column) -> Column:
    """Addresses of mailto links in order, repeats kept."""
    return F.transform(found(html, fixed.MAILTO, 1), F.lower)


def phone_digits(c: Column) -> Column:
    d = F.regexp_replace(c, r"\D", "")
    return F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)


def phones(c: Column) -> Column:
    """Distinct North American numbers as (AAA) BBB-CCCC, by first occurrence."""
    digits = F.filter(F.transform(found(c, fixed.PHONE), phone_digits), lambda d: F.length(d) == 10)
    return F.transform(F.array_distinct(digits), lambda d: F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4)))


def social_links(c: Column, strict: bool = False) -> Column:
    """network -> first link to it. ``strict``: the host must be the network's or below it, not just end like it."""

    def network(url: Column) -> Column:
        host = urls.loose_domain(url)
        out = F.lit(None).cast("string")
        for ending, name in fixed.SOCIAL.items():
            hit = (host == ending) | host.endswith("." + ending) if strict else host.endswith(ending)
            out = F.when(hit, name).otherwise(out)
        return out

    pairs = F.filter(F.transform(found(c, fixed.LINK), lambda u: F.struct(network(u).alias("n"), u.alias("u"))), lambda p: p["n"].isNotNull())
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(pairs, empty, lambda acc, p: F.when(F.map_contains_key(acc, p["n"]), acc).otherwise(F.map_concat(acc, F.create_map(p["n"], p["u"]))))


def street_address(c: Column) -> Column:
    """The first street address with state and ZIP code, or null."""
    return first(c, fixed.STREET, 0)


def _cut(c: Column, breaks: list[str]) -> Column:
    """The part before the first listed separator that occurs."""
    out = c
    for b in reversed(breaks):
        out = F.when(F.instr(c, b) > 0, F.trim(F.substring_index(c, b, 1))).otherwise(out)
    return out


def company_name(html: Column, text: Column, url: Column, structured: Column | None = None) -> Column:
    """Structured name, site name, title, first fit line of the text, or the URL's authority."""
    site = F.coalesce(*[first(html, p) for p in fixed.SITE_NAME])
    title = _cut(F.trim(F.regexp_extract(html, fixed.TITLE, 1)), fixed.TITLE_BREAKS)
    stripped = F.transform(lines(text), lambda x: F.trim(F.regexp_replace(x, r"^[# ]+", "")))
    fit = F.filter(stripped, lambda x: (F.length(x) >= 3) & ~x.rlike(r"^[\[*!<{]") & ~x.rlike(fixed.NOT_A_NAME))
    cut = F.filter(F.transform(fit, lambda x: _cut(x, fixed.LINE_BREAKS)), lambda x: F.length(x) >= 3)
    return F.coalesce(
        *([F.substring(blank_to_null(structured), 1, 120)] if structured is not None else []),
        F.when(F.length(site) >= 2, F.substring(site, 1, 120)),
        F.when(F.length(title) >= 3, F.substring(title, 1, 120)),
        F.substring(F.try_element_at(cut, F.lit(1)), 1, 120),
        urls.authority(url),
    )


def description(text: Column) -> Column:
    """The first line over 60 characters that is no heading, cut at 300; '' if none."""
    fit = F.filter(lines(text), lambda x: (F.length(x) > 60) & ~x.startswith("#"))
    return F.coalesce(F.substring(F.try_element_at(fit, F.lit(1)), 1, 300), F.lit(""))


def business_hours(text: Column) -> Column:
    """Opening hours in a text, white space collapsed, cut at 200; null if none."""
    hit = F.coalesce(*[first(text, p) for p in fixed.HOURS])
    return F.substring(F.regexp_replace(hit, r"(?U)\s+", " "), 1, 200)


_DROP = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->")
_BREAK = re.compile(r"(?i)<(?:br|/?(?:p|div|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|main))\b[^>]*>")
_TAG = re.compile(r"<[^>]+>")


@F.pandas_udf(T.StringType())
def page_text(html: pd.Series) -> pd.Series:
    """Readable text of HTML: scripts, styles and comments dropped, block tags as line breaks, entities resolved."""

    def one(h: str | None) -> str | None:
        if h is None:
            return None
        t = _TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", h)))
        rows = (re.sub(r"[ \t\xa0]+", " ", x).strip() for x in html_lib.unescape(t).splitlines())
        return "\n".join(x for x in rows if x)

    return html.map(one)
