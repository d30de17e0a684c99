"""Map listings, their detail pages, reviews and addresses as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import fixed, structured, text, urls
from leadloom.functions.structured import at
from leadloom.functions.text import blank_to_null, first, let

MAP_SITE = "https://www.google.com"



def coordinates(c: Column) -> Column:
    """Struct of latitude and longitude after @ in a map URL."""
    hit = lambda g: blank_to_null(F.regexp_extract(c, fixed.COORDINATES, g)).try_cast("double")
    return F.struct(hit(1).alias("latitude"), hit(2).alias("longitude"))


def place_id(c: Column) -> Column:
    return F.regexp_extract(c, fixed.PLACE_ID, 0)


def listing_key(maps_url: Column) -> Column:
    """What tells listings apart: the URL before ? and !."""
    return F.substring_index(F.substring_index(maps_url, "?", 1), "!", 1)


def build_listing(href: Column, name: Column) -> Column:
    """Struct of one listing."""
    full = F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(MAP_SITE), href))
    where = coordinates(href)
    return F.struct(F.trim(urls.unquote(name)).alias("name"), full.alias("maps_url"), where["latitude"].alias("latitude"), where["longitude"].alias("longitude"), place_id(href).alias("place_id"))


def listings(html: Column) -> Column:
    """Listings of a result page: injected JSON, else four ways to read the links, each only if those before found none. First per key."""
    none = F.array().cast("array<struct<h:string,n:string>>")
    row = lambda h, n: F.struct(h.alias("h"), n.alias("n"))

    def zipped(pattern: str, h: int, n: int, clean: bool = False) -> Column:
        hits = lambda g: F.coalesce(F.regexp_extract_all(html, F.lit(pattern), F.lit(g)), F.array().cast("array<string>"))
        pairs = F.zip_with(hits(h), hits(n), row)
        return F.transform(pairs, lambda p: row(p["h"], F.replace(F.replace(p["n"], F.lit("+"), F.lit(" ")), F.lit("%20"), F.lit(" ")))) if clean else pairs

    injected = F.filter(F.transform(at(structured.marked_json(html, "__gmaps_listings__"), "$", "array<variant>"), lambda v: row(at(v, "$.href"), F.coalesce(at(v, "$.name"), F.lit("")))), lambda p: F.contains(p["h"], F.lit("/maps/place/")))
    ways = [
        injected,
        zipped(r'(?is)<a\s[^>]*?href="(/maps/place/[^"]+)"[^>]*?aria-label="([^"]*)"', 1, 2),
        zipped(r'(?is)<a\s[^>]*?aria-label="([^"]*)"[^>]*?href="(/maps/place/[^"]+)"', 2, 1),
        zipped(r'(?i)href="(/maps/place/([^/]+)/[^"]*)"', 1, 2, True),
        zipped(r'(?i)/maps/place/([^/"]+)/[^"\s<>]+', 0, 1, True),
    ]
    found = F.coalesce(*[let(w, lambda x: F.when(F.size(x) > 0, x)) for w in ways], none)
    key = lambda x: listing_key(x["maps_url"])

    def first_each(built: Column) -> Column:
        return let(F.transform(built, key), lambda ks: F.filter(built, lambda x, i: F.array_position(ks, key(x)) == i + 1))

    return let(F.transform(found, lambda p: build_listing(p["h"], p["n"])), first_each)


def address_parts(address: Column) -> Column:
    """Struct of street, city, state, zip_code from comma-separated parts."""
    return let(F.transform(F.split(address, ","), lambda x: F.trim(x)), _parts)


def _parts(parts: Column) -> Column:
    n = F.size(parts)
    last = F.try_element_at(parts, F.lit(-1))
    state, code = F.regexp_extract(last, fixed.STATE_ZIP, 1), F.regexp_extract(last, fixed.STATE_ZIP, 2)
    return F.struct(
        F.when(n >= 2, parts[0]).alias("street"),
        F.when(n >= 3, F.try_element_at(parts, F.lit(-2))).when(n == 2, last).alias("city"),
        F.when(n >= 3, F.when(state != "", state).otherwise(last)).alias("state"),
        F.when((n >= 3) & (state != ""), code).alias("zip_code"),
    )


def reviews(c: Column) -> Column:
    """Struct of google_rating (0 to 5) and google_reviews (at most a million) read from text."""
    pair = lambda g: blank_to_null(F.regexp_extract(c, fixed.RATING_COUNT, g))
    rating, count = pair(1).try_cast("double"), F.replace(pair(2), F.lit(","), F.lit("")).try_cast("int")
    count = F.when(rating.isNotNull() | pair(1).isNull(), count)  # the count of an unreadable pair is not used
    count = F.coalesce(count, F.replace(first(c, fixed.REVIEW_COUNT), F.lit(","), F.lit("")).try_cast("int"))
    rating = F.coalesce(rating, first(c, fixed.RATING_OF_FIVE).try_cast("double"))
    return F.struct(F.when((rating >= 0) & (rating <= 5), rating).alias("google_rating"), F.when(count <= 1_000_000, count).alias("google_reviews"))


def location_hint(address: Column) -> Column:
    """The part of an address that names the town: the last but one, or the only one."""
    parts = F.transform(F.split(address, ","), lambda x: F.trim(x))
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(parts[0])


def review_distribution(html: Column, total: Column) -> Column:
    """stars -> number, from counts, else from percentages of ``total`` (half to even)."""
    hits = lambda p, g: F.coalesce(F.regexp_extract_all(html, F.lit(p), F.lit(g)), F.array().cast("array<string>"))
    counts, shares = r"(?i)(\d)\s*stars?,\s*(\d[\d,]*)\s*reviews?", r"(?i)(\d)\s*stars?\s*(\d+)%"

    def last_wins(k: Column, v: Column) -> Column:
        pairs = F.reverse(F.arrays_zip(k.alias("k"), v.alias("v")))
        keys = F.transform(pairs, lambda p: p["k"])
        return F.map_from_entries(F.reverse(F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)))

    by_count = last_wins(hits(counts, 1), F.transform(hits(counts, 2), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("int")))
    by_share = last_wins(hits(shares, 1), F.transform(hits(shares, 2), lambda x: F.bround(total * x.try_cast("int") / 100).cast("int")))
    return F.when(F.size(by_count) > 0, by_count).when((F.coalesce(total, F.lit(0)) > 0) & (F.size(by_share) > 0), by_share)


def injected_detail(html: Column) -> Column:
    """Struct of a detail page's injected JSON (all null without it)."""
    v = structured.marked_json(html, "__gmaps_detail__")
    text_ = lambda k: blank_to_null(at(v, f"$.{k}"))
    return F.struct(
        v.isNotNull().alias("present"), text_("title").alias("name"), at(v, "$.rating", "double").alias("rating"), at(v, "$.reviewCount", "int").alias("review_count"), text_("category").alias("category"), text_("address").alias("address"),
        text_("phone").alias("phone"), text_("website").alias("website"), text_("hours").alias("hours"), text_("priceLevel").alias("price_level"), at(v, "$.reviewDistribution", "map<string,int>").alias("review_distribution"), at(v, "$.latitude", "double").alias("latitude"),
        at(v, "$.longitude", "double").alias("longitude"), text_("placeId").alias("place_id"), at(v, "$.permanentlyClosed", "boolean").alias("is_permanently_closed"), at(v, "$.temporarilyClosed", "boolean").alias("is_temporarily_closed"), text_("plusCode").alias("plus_code"), text_("description").alias("description"),
    )


def detail(html: Column, md: Column, maps_url: Column) -> Column:
    """Struct of a listing's detail: injected JSON first, then the page's labels and text."""
    return let(injected_detail(html), lambda j: _detail(j, html, md, maps_url))


def _detail(j: Column, html: Column, md: Column, maps_url: Column) -> Column:
    both = F.concat_ws("\n", html, md)
    label = lambda what: first(html, rf'(?i)aria-label="{what}[:\s]*([^"]+)"')
    only = lambda c: F.when(~j["present"], c)  # fields that the page's text gives only where there is no JSON
    stars, in_text = r'aria-label="(\d\.?\d?)\s*stars?\s*(\d[\d,]*)\s*[Rr]eviews?"', r"(\d\.\d)\s*\((\d[\d,]*)\)"
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("int")
    rating = F.coalesce(first(html, stars), first(md, in_text), first(html, r"(?i)(\d\.?\d?)\s*stars?")).try_cast("double")
    count = F.coalesce(number(first(html, stars, 2)), number(first(md, in_text, 2)), number(first(html, r"\((\d[\d,]*)\s*(?:reviews?)?\)")))
    count = F.coalesce(j["review_count"], only(count))
    address = F.coalesce(j["address"], label("Address"), only(first(md, r"(?iU)(\d{1,5}\s+[\w\s.]+(?:St|Street|Ave|Avenue|Blvd|Dr|Drive|Rd|Road|Ln|Way|Ct|Pl)[.,]?\s*[\w\s]*,?\s*[A-Z]{2}\s*\d{5})")))
    parts, where = address_parts(address), coordinates(maps_url)
    phone = F.coalesce(j["phone"], label("Phone"), F.try_element_at(text.found(md, fixed.PHONE), F.lit(1)))
    linked = first(md, r"\]\((https?://(?!www\.google|maps\.google|play\.google)[^\s)]+)\)")
    linked = F.when(~urls.authority(linked).rlike(r"(google\.com|gstatic\.com|googleapis\.com|ggpht\.com)$") & F.contains(urls.authority(linked), F.lit(".")), linked)
    website = F.coalesce(j["website"], label("Website"), only(first(html, r'<a[^>]+data-item-id="authority"[^>]+href="([^"]+)"')), only(linked))
    rows = lambda g: text.found(html, r"(?is)<tr[^>]*>.*?<td[^>]*>(\w+day)</td>.*?<td[^>]*>([^<]+)</td>.*?</tr>", g)
    hours = F.coalesce(first(html, r'(?i)aria-label="([^"]*(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)[^"]*)"'), blank_to_null(F.array_join(F.zip_with(rows(1), rows(2), lambda d, h: F.concat(d, F.lit(": "), F.trim(h))), "; ")))
    category = F.coalesce(first(md, r"(?:^|\n)\s*([A-Z][a-z]+(?:\s+[a-z]+)*)\s*\n.*?(?:stars?|\d\.\d)"), first(html, r'(?i)<button[^>]*jsaction="[^"]*category[^"]*"[^>]*>([^<]+)</button>'))
    price = F.coalesce(first(both, r"(\${1,4})\s*·"), first(html, r'aria-label="[^"]*(\${1,4})\s*·'))
    spread = F.coalesce(j["review_distribution"], only(review_distribution(html, count)))
    closed = lambda how: F.when(j["present"], F.coalesce(j[f"is_{how}_closed"], F.lit(False))).otherwise(both.rlike(f"(?i){how} closed"))
    return F.struct(
        j["name"].alias("name"), F.coalesce(j["rating"], only(rating)).alias("rating"), count.alias("review_count"), F.coalesce(j["category"], only(category)).alias("category"), address.alias("address"), parts["street"].alias("street"), parts["city"].alias("city"), parts["state"].alias("state"), parts["zip_code"].alias("zip_code"),
        phone.alias("phone"), website.alias("website"), F.coalesce(j["hours"], only(hours)).alias("hours"), F.coalesce(j["price_level"], only(price)).alias("price_level"), spread.alias("review_distribution"), F.coalesce(j["latitude"], where["latitude"]).alias("latitude"), F.coalesce(j["longitude"], where["longitude"]).alias("longitude"),
        F.coalesce(j["place_id"], blank_to_null(place_id(maps_url))).alias("place_id"), F.coalesce(j["plus_code"], only(first(html, fixed.PLUS_CODE, 0))).alias("plus_code"), closed("temporarily").alias("is_temporarily_closed"), closed("permanently").alias("is_permanently_closed"),
        F.coalesce(j["description"], only(first(html, r'(?i)<div[^>]*class="[^"]*PYvSYb[^"]*"[^>]*>([^<]+)</div>'))).alias("description"), only(first(html, r'(?i)<img[^>]+class="[^"]*(?:p6VGsd|tactile-hero-image)[^"]*"[^>]+src="([^"]+)"')).alias("thumbnail_url"),
    )


def directory_page(html: Column, md: Column, page_url: Column) -> Column:
    """Lead struct of a directory profile: its state object, else what the rendered page shows."""
    known = let(structured.next_data(html), lambda s: structured.directory_company(structured.profile_node(s), page_url))
    body = F.coalesce(blank_to_null(md), html)
    slug = F.replace(F.regexp_extract(page_url, r"/companies/\d+-(.+?)(?:\?|$)", 1), F.lit("-"), F.lit(" "))
    rating = F.coalesce(first(html, r"(\d+\.?\d*)\s*/\s*10"), first(html, r"(?i)Star\s*Score[:\s]*(\d+\.?\d*)")).try_cast("double")
    shown = F.struct(
        F.coalesce(first(html, r"<h1[^>]*>([^<]+)</h1>"), F.initcap(slug)).alias("company"), F.lit("").alias("category"), F.lit("").alias("url"), text.emails(body).alias("emails"), text.phones(body).alias("phones"), F.lit("").alias("address"),
        F.round(rating, 1).alias("homestars_rating"), first(html, r"(?i)(\d+)\s*reviews?").try_cast("int").alias("homestars_reviews"), page_url.alias("homestars_url"), F.lit(False).alias("homestars_verified"), F.lit(None).cast("int").alias("homestars_years"),
        F.when(blank_to_null(md).isNotNull(), text.description(md)).otherwise("").alias("description"),
    )
    return F.coalesce(known, shown)
