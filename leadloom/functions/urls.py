"""URL handling and link extraction as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import fixed


def normalize_url(c: Column) -> Column:
    """Trimmed, with https:// unless it has http, https, file or raw: in front (case counts)."""
    t = F.trim(c)
    return F.when(t.rlike(r"^(http://|https://|file://|raw:)"), t).otherwise(F.concat(F.lit("https://"), t))


def authority(c: Column) -> Column:
    """Host with user and port, as written; '' if there is none."""
    return F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def domain(c: Column) -> Column:
    """Authority in lower case without one leading www.; null if empty. The key of the lead cache."""
    return F.nullif(F.regexp_replace(F.lower(authority(c)), r"^www\.", ""), F.lit(""))


def loose_domain(c: Column) -> Column:
    """Authority in lower case without any leading w and dots. The key of URL deduplication."""
    return F.regexp_replace(F.lower(authority(c)), r"^[w.]+", "")


def email_domain(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("@")), F.trim(F.lower(F.substring_index(c, "@", -1))))


def skipped(c: Column, strict: bool = False) -> Column:
    """Whether the URL is on a host that is no business site. ``strict``: only the host or below it, not one that ends alike."""
    names = "|".join(h.replace(".", r"\.") for h in fixed.SKIPPED_HOSTS)
    return loose_domain(c).rlike((r"(^|\.)" if strict else "") + f"({names})$")


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def _or(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, a).otherwise(b)


def unquote(c: Column) -> Column:
    """Percent decoding that keeps + and leaves broken text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def internal_links(html: Column, base: Column, most: int = 10) -> Column:
    """Links to the base's own host: contact-like pages first, each group in page order, at most ``most``."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    hrefs = F.filter(F.transform(_all(html, fixed.HREF, 1), lambda h: F.trim(h)), lambda h: ~h.rlike(r"^(mailto:|tel:|javascript:)"))
    full = F.transform(hrefs, lambda h: F.when(h.startswith("/"), F.concat(root, h)).when(h.startswith("http"), h))
    ends = "(" + "|".join(e.replace(".", r"\.") for e in fixed.ASSET_ENDINGS) + ")$"
    own = F.filter(full, lambda u: u.isNotNull() & (F.lower(authority(u)) == F.lower(authority(base))) & ~F.lower(path(u)).rlike(ends) & (u != base))
    own = F.array_distinct(own)
    wanted = "|".join(fixed.CONTACT_WORDS)
    good = lambda u: F.lower(path(u)).rlike(wanted)
    return F.slice(F.concat(F.filter(own, good), F.filter(own, lambda u: ~good(u))), 1, most)


def redirect_urls(html: Column, text: Column) -> Column:
    """Targets of uddg= parameters on a result page; from the text if the HTML has none."""
    return F.transform(_or(_all(html, r"uddg=([^&\"'>\s]+)", 1), _all(text, r"uddg=([^&)\s]+)", 1)), unquote)


def listed_urls(html: Column) -> Column:
    """First link of each b_algo item; else all links that do not lead to the engine itself."""
    return _or(_all(html, r"(?s)<li[^>]*class=\"b_algo\"[^>]*>.*?<a\s+href=\"(https?://[^\"]+)\"", 1), _all(html, r"href=\"(https?://(?!www\.bing|www\.microsoft)[^\"]+)\"", 1))


def header_urls(html: Column, text: Column) -> Column:
    """Links of result headers; else the links of the text."""
    return _or(_all(html, r"(?s)class=\"result-header\"[^>]*href=\"(https?://[^\"]+)\"", 1), _all(text, r"\]\((https?://[^\s)]+)\)", 1))


def outside_urls(html: Column, text: Column) -> Column:
    """Links on a map page that lead off the map."""
    a = F.filter(_all(html, r"https?://(?!www\.google|maps\.google|play\.google)[^\s\"'<>]+", 0), lambda u: F.contains(authority(u), F.lit(".")))
    return F.concat(a, _all(text, r"\]\((https?://(?!www\.google|maps\.google)[^\s)]+)\)", 1))


def directory_urls(html: Column) -> Column:
    """Canonical addresses of directory profiles, by first occurrence."""
    return F.array_distinct(F.transform(_all(html, fixed.DIRECTORY_PAGE, 1), lambda s: F.concat(F.lit("https://homestars.com/companies/"), s)))


def short_url(c: Column) -> Column:
    """Host and path (unless it is /) for display; the text itself if it is no URL."""
    host = F.regexp_extract(F.lower(authority(c)), r"^(?:[^@]*@)?([^:]*)", 1)
    p = path(c)
    return F.when(host == "", c).otherwise(F.concat(host, F.when((p == "/") | (p == ""), "").otherwise(p)))
