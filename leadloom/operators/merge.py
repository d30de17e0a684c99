"""Joining and overlaying records of different sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import text, urls
from leadloom.operators import dedup

SCRAPED = ("emails", "phones", "socials", "hours", "description", "company", "address")


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _or_fill(own: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(other, F.lit("")), own)


def overlay_maps(base: Column, over: Column) -> Column:
    """Entries of both maps; ``over`` wins."""
    empty = F.create_map().cast("map<string,string>")
    b, o = F.coalesce(base, empty), F.coalesce(over, empty)
    return F.map_concat(F.map_filter(b, lambda k, _: ~F.map_contains_key(o, k)), o)


def overlay(df: DataFrame, prefix: str = "s_") -> DataFrame:
    """Scraped columns (``prefix``) laid over a record: emails united and sorted, links overlaid, the rest only where empty."""
    s = lambda c: F.col(prefix + c)
    out = {
        "emails": F.when(F.size(_list(prefix + "emails")) > 0, F.array_sort(F.array_union(_list("emails"), _list(prefix + "emails")))).otherwise(_list("emails")),
        "socials": overlay_maps(F.col("socials"), s("socials")),
        "phones": F.when(F.size(_list("phones")) > 0, F.col("phones")).otherwise(_list(prefix + "phones")),
        **{c: _or_fill(F.col(c), s(c)) for c in ("hours", "description", "company", "address")},
    }
    return df.withColumns(out).drop(*[prefix + c for c in SCRAPED])


def enrich_records(records: DataFrame, scraped: DataFrame, order: str) -> DataFrame:
    """records left joined on url to the last non-error scrape of that url, overlaid. Blank urls match nothing."""
    last = dedup.last_per_key(scraped.where("error is null and url <> ''"), F.col("url"), F.col(order))
    side = last.select(F.col("url"), *[F.col(c).alias("s_" + c) for c in SCRAPED])
    return overlay(records.join(side, "url", "left"))


def replace_by_url(leads: DataFrame, results: DataFrame, order: str) -> DataFrame:
    """Whole rows of ``leads`` replaced by the last row of ``results`` with their url (same columns)."""
    cols = leads.columns
    last = dedup.last_per_key(results, F.col("url"), F.col(order)).select(F.col("url").alias("_u"), F.struct(*cols).alias("_r"))
    both = leads.select(F.struct(*cols).alias("_l")).join(last, F.col("_l.url") == F.col("_u"), "left")
    return both.select(F.coalesce("_r", "_l").alias("x")).select("x.*")


def site_facts(lead: DataFrame, html: str, md: str) -> DataFrame:
    """A listing with what its website shows: emails and links replaced if found, phone and description if empty. Drops html and md."""
    both = F.concat_ws(" ", md, html)
    found_e, found_s, found_p = text.emails(both), text.social_links(both), text.phones(F.col(md))
    return lead.withColumns({
        "emails": F.when(F.size(found_e) > 0, found_e).otherwise(F.col("emails")),
        "socials": F.when(F.size(found_s) > 0, found_s).otherwise(F.col("socials")),
        "phone": F.coalesce(F.nullif("phone", F.lit("")), F.try_element_at(found_p, F.lit(1)), F.col("phone")),
        "description": F.coalesce(F.nullif("description", F.lit("")), text.description(F.col(md))),
    }).drop(html, md)


def directory_facts(lead: DataFrame, html: str, md: str) -> DataFrame:
    """A directory profile with what its website shows: lists united (sorted), links overlaid, description if empty."""
    shown = F.coalesce(F.nullif(md, F.lit("")), html)  # the text, else the page itself; links stand in the page only
    return lead.withColumns({
        "emails": F.array_sort(F.array_union(_list("emails"), text.emails(shown))),
        "phones": F.array_sort(F.array_union(_list("phones"), text.phones(shown))),
        "socials": overlay_maps(F.col("socials"), text.social_links(F.col(html))),
        "description": F.coalesce(F.nullif("description", F.lit("")), text.description(F.col(md))),
    }).drop(html, md)


def import_record(df: DataFrame) -> DataFrame:
    """Records of a listing export as leads."""
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    raw = F.trim(F.coalesce(F.nullif("website", F.lit("")), s("url")))
    url = F.when((raw != "") & ~raw.startswith("https://www.google.com/maps"), urls.normalize_url(raw)).otherwise("")
    phone = F.coalesce(F.nullif("phone", F.lit("")), s("phoneUnformatted"))
    parts = F.array_join(F.filter(F.array("street", "city", "postalCode"), lambda x: x.isNotNull() & (x != "")), ", ")
    return df.select(
        url.alias("url"), F.coalesce(F.nullif("title", F.lit("")), s("name")).alias("company"), s("description").alias("description"), F.array().cast("array<string>").alias("emails"), F.when(phone != "", F.array(phone)).otherwise(F.array().cast("array<string>")).alias("phones"),
        F.when(parts != "", parts).otherwise(s("address")).alias("address"), F.create_map().cast("map<string,string>").alias("socials"), s("openingHours").alias("hours"), s("categoryName").alias("category"),
        F.col("totalScore").try_cast("double").alias("rating"), F.col("totalScore").try_cast("double").alias("google_rating"), F.col("reviewsCount").try_cast("int").alias("google_reviews"), s("neighborhood").alias("neighborhood"),
    )


LISTING_DEFAULTS = {
    "category": "''", "address": "''", "phone": "''", "website": "''", "rating": "cast(null as double)", "review_count": "cast(null as int)", "review_distribution": "cast(map() as map<string,int>)", "hours": "''",
    "price_level": "''", "latitude": "cast(null as double)", "longitude": "cast(null as double)", "place_id": "''", "plus_code": "''", "is_temporarily_closed": "false", "is_permanently_closed": "false", "description": "''",
    "thumbnail_url": "''", "emails": "cast(array() as array<string>)", "socials": "cast(map() as map<string,string>)",
}


def listing_with_detail(listings: DataFrame, details: DataFrame) -> DataFrame:
    """listings left joined on maps_url to their details: a detail wins where it has the field; defaults fill the rest."""
    both = listings.alias("l").join(details.alias("d"), "maps_url", "left")
    have_l, have_d = set(listings.columns), set(details.columns)

    def col(c: str, default: str | None) -> Column:
        sides = [F.col(f"{s}.{c}") for s, have in (("d", have_d), ("l", have_l)) if c in have]
        return F.coalesce(*sides, *([F.expr(default)] if default else [F.lit(None)])).alias(c)

    names = ["name", *LISTING_DEFAULTS, *[c for c in ("city", "state", "zip_code") if c in have_d | have_l]]
    return both.select("maps_url", *[col(c, LISTING_DEFAULTS.get(c)) for c in names])


def listing_lead(df: DataFrame) -> DataFrame:
    """Detailed listings in the lead schema."""
    have = set(df.columns)
    opt = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    phone = F.nullif("phone", F.lit(""))
    keep = ["maps_url", "category", "description", "emails", "address", "hours", "review_distribution", "price_level", "latitude", "longitude", "place_id", "plus_code", "is_temporarily_closed", "is_permanently_closed", "thumbnail_url", "socials"]
    return df.select(F.col("name").alias("company"), F.col("website").alias("url"), *keep, F.when(phone.isNotNull(), F.array(phone)).otherwise(F.array().cast("array<string>")).alias("phones"), *[opt(c).alias(c) for c in ("city", "state", "zip_code")], F.col("rating").alias("google_rating"), F.col("review_count").alias("google_reviews"))
