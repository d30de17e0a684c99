"""Literal cases of the column functions."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadloom.functions import display, forms, geo, listing, scoring, structured, text, urls


def value(spark, column, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(column.alias("x")).first()["x"]


def on(spark, f, s):
    return value(spark, f(F.col("s")), s=s)


def test_emails(spark):
    s = "Info@Acme.ca, logo@2x.png noreply@acme.ca x@example.com a.b@shop.co"
    assert on(spark, text.emails, s) == ["a.b@shop.co", "info@acme.ca", "logo@2x.png"]
    assert on(spark, lambda c: text.emails(c, strict=True), s) == ["a.b@shop.co", "info@acme.ca"]
    assert spark.sql("select cast(null as string) s").select(text.emails(F.col("s")).alias("x")).first()["x"] == []


def test_phones(spark):
    assert on(spark, text.phones, "1-416-555-2671 or (416) 555-2671, +1 905.555.0199 id 94165552671") == ["(416) 555-2671", "(905) 555-0199"]


def test_social_links(spark):
    s = "https://www.facebook.com/a https://x.com/b https://netflix.com/c"
    assert on(spark, text.social_links, s) == {"facebook": "https://www.facebook.com/a", "twitter": "https://x.com/b"}
    assert on(spark, text.social_links, "https://netflix.com/c") == {"twitter": "https://netflix.com/c"}
    assert on(spark, lambda c: text.social_links(c, strict=True), "https://netflix.com/c") == {}


def test_address_text(spark):
    assert on(spark, text.street_address, "Visit 123 Main St, Denver, CO 80202 today") == "123 Main St, Denver, CO 80202"
    assert on(spark, text.street_address, "nothing here") is None


@pytest.mark.parametrize("html, md, url, want", [
    ("<title>Acme Plumbing | Home - Toronto</title>", "", "https://a.ca", "Acme Plumbing"),
    ("<title>AB</title>", "", "https://ab.ca/x", "ab.ca"),
    ('<meta property="og:site_name" content="Shop"><title>Other</title>', "", "https://a.ca", "Shop"),
    ("", "# Skip to content\n[x](y)\n## Best Roofers - Home\n", "https://a.ca", "Best Roofers"),
])
def test_company_name(spark, html, md, url, want):
    assert value(spark, text.company_name(F.col("h"), F.col("m"), F.col("u")), h=html, m=md, u=url) == want


def test_description_and_hours(spark):
    long = "x" * 61
    assert on(spark, text.description, f"# {long}\nshort\n {long} \nlater") == long
    assert on(spark, text.description, "short") == ""
    assert on(spark, text.business_hours, "Open: Mon to Fri 9am\n - 5pm!") == "Mon to Fri 9am - 5pm"


def test_page_text(spark):
    assert on(spark, text.page_text, "<p>A &amp; B</p><script>x</script><div>C<br>D</div><!-- n -->") == "A & B\nC\nD"


def test_urls(spark):
    assert on(spark, urls.normalize_url, " acme.ca ") == "https://acme.ca"
    assert on(spark, urls.normalize_url, "HTTP://a.ca") == "https://HTTP://a.ca"
    assert on(spark, urls.domain, "https://www.wework.com/") == "wework.com"
    assert on(spark, urls.loose_domain, "https://www.wework.com/") == "ework.com"
    assert on(spark, urls.email_domain, "a@b@C.ca ") == "c.ca"
    assert on(spark, urls.skipped, "https://plumbing.com/a") is True
    assert on(spark, lambda c: urls.skipped(c, strict=True), "https://plumbing.com/a") is False
    assert on(spark, urls.unquote, "a+b%20c%zz") == "a+b%20c%zz" and on(spark, urls.unquote, "a+b%20c") == "a+b c"


def test_json_ld(spark):
    item = {"@type": ["Dentist", "X"], "name": " A ", "openingHoursSpecification": [{"dayOfWeek": ["https://schema.org/Monday", "Tuesday"], "opens": "9", "closes": "5"}], "address": {"streetAddress": "1 A", "postalCode": "Z"}, "sameAs": "u"}
    html = f"<script type='application/ld+json'>{{no</script><script type=\"application/ld+json\">{json.dumps([{'@type': 5}, item, {'@type': 'store', 'name': 'B', 'telephone': '1'}])}</script>"
    x = on(spark, structured.json_ld, html)
    assert (x["name"], x["phone"], x["hours"], x["address"], x["same_as"]) == ("A", "1", "Monday, Tuesday: 9-5", "1 A, Z", ["u"])


def test_directory_company(spark):
    state = {"props": {"pageProps": {"name": "x", "pro": {"title": "Ace", "rating": "8.25", "totalReviews": "12", "website": "ace.ca", "trades": ["Roofing"], "verified": {"a": False, "b": True}, "city": "Ajax", "province": "ON"}}}}
    html = f'<script id="__NEXT_DATA__" type="j">{json.dumps(state)}</script>'
    x = value(spark, structured.directory_company(structured.profile_node(structured.next_data(F.col("h"))), F.lit("p")), h=html)
    assert (x["company"], x["homestars_reviews"], x["url"], x["category"], x["homestars_verified"], x["address"]) == ("Ace", 12, "https://ace.ca", "Roofing", True, "Ajax, ON")
    shown = value(spark, listing.directory_page(F.col("h"), F.lit(""), F.lit("https://d.example/companies/12-big-ace")), h="<p>9.4 / 10, 7 reviews (416) 555-2671</p>")
    assert (shown["company"], shown["homestars_rating"], shown["homestars_reviews"], shown["phones"]) == ("Big Ace", 9.4, 7, ["(416) 555-2671"])


def test_listings(spark):
    href = "/maps/place/Acme/@43.65,-79.38,17z/data=!4m5!1sChIJabc_1-x?hl=en"
    x = on(spark, listing.listings, f'<a href="{href}" aria-label="Acme %26 Co"><a href="/maps/place/Acme/@43.65,-79.38,17z/data=!9" aria-label="Again">')
    assert len(x) == 1 and (x[0]["name"], x[0]["latitude"], x[0]["longitude"], x[0]["place_id"]) == ("Acme & Co", 43.65, -79.38, "ChIJabc_1-x")
    js = "&quot;".join(["[{", "href", ": ", "/maps/place/B/", ", ", "name", ": ", "B", "}]"])
    assert [r["name"] for r in on(spark, listing.listings, f'<div id="__gmaps_listings__">{js}</div>')] == ["B"]


def test_detail_from_json(spark):
    html = '<div id="__gmaps_detail__">{"title": "A", "rating": 4.4, "reviewCount": 7, "address": "1 B, C, ON", "permanentlyClosed": true}</div><b aria-label="Phone: 416-555-2671">'
    x = value(spark, listing.detail(F.col("h"), F.lit(""), F.lit("u/@1.5,-2.5,3z ChIJq")), h=html)
    assert (x["name"], x["rating"], x["review_count"], x["city"], x["state"], x["phone"], x["latitude"], x["place_id"], x["is_permanently_closed"]) == ("A", 4.4, 7, "C", "ON", "416-555-2671", 1.5, "ChIJq", True)


@pytest.mark.parametrize("s, want", [("Acme 4.5 (1,238)", (4.5, 1238)), ("9.9 (12)", (None, 12)), ("230 Google reviews", (None, 230)), ("4.1 out of 5", (4.1, None)), ("none", (None, None))])
def test_reviews(spark, s, want):
    x = on(spark, listing.reviews, s)
    assert (x["google_rating"], x["google_reviews"]) == want


def test_address_parts(spark):
    x = on(spark, listing.address_parts, "123 Main St, Denver, CO 80202")
    assert tuple(x) == ("123 Main St", "Denver", "CO", "80202")
    x = on(spark, listing.address_parts, "145 Front St E Suite L3, Toronto, ON M5A 1E3, Canada")
    assert tuple(x) == ("145 Front St E Suite L3", "ON M5A 1E3", "Canada", None)


def test_review_distribution(spark):
    assert on(spark, lambda c: listing.review_distribution(c, F.lit(45)), "5 stars 50% 1 star 10%") == {"5": 22, "1": 4}


@pytest.mark.parametrize("lead, want", [
    (dict(emails=["info@x.ca"], phones=["1"], address="a", socials={"f": "u"}, google_reviews=30, google_rating=4.5), (8, "hot")),
    (dict(emails=["jane.d@x.ca"], phones=["1"]), (5, "warm")),
    (dict(google_reviews=0), (2, "cold")),
    (dict(google_reviews=5000, google_rating=2.5), (-2, "dead")),
    (dict(error="timeout"), (-2, "dead")),
])
def test_score(spark, lead, want):
    schema = "emails array<string>, phones array<string>, address string, socials map<string,string>, google_reviews int, google_rating double, error string"
    names = ["emails", "phones", "address", "socials", "google_reviews", "google_rating", "error"]
    r = scoring.annotate(spark.createDataFrame([tuple(lead.get(n) for n in names)], schema)).first()
    assert (r["score"], r["tier"]) == want


def test_order(spark):
    df = spark.createDataFrame([(5, None, 0), (5, 0, 1), (5, 9, 2), (7, None, 3)], "score int, google_reviews int, ord int")
    assert [r["ord"] for r in scoring.ranked(df, "ord").collect()] == [3, 2, 0, 1]


def test_display(spark):
    assert [value(spark, display.duration(F.col("s")), s=s) for s in (0.0, 42.4, 61.0, 3700.0)] == ["—", "42s", "1m 1s", "1h 1m"]
    assert value(spark, display.safe_label(F.col("s")), s="a b/ç-" + "x" * 50) == "a_b_ç-" + "x" * 34
    assert value(spark, display.cities_label(F.col("s")), s='["a", "b"]') == "2 cities"


def test_forms(spark):
    html = '<form><input name="company_name"><input type="email"><textarea></textarea></form><form><input type="email"><input type="tel"><textarea></textarea></form>'
    df = spark.createDataFrame([(1, html)], "k int, h string").select("k", forms.detect_forms("h").alias("f"))
    best = forms.best_forms(df, "k", "f").first()
    assert best["index"] == 1 and sorted(best["kinds"]) == ["email", "message", "phone"]
    assert value(spark, forms.render(F.lit("Hi {other} {city}"), *[F.lit("x")] * 6)) == "Hi {other} {city}"


def test_polygon(spark):
    square = '{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[4,0],[4,4],[0,4],[0,0]]]]}}'
    df = spark.createDataFrame([(2.0, 2.0), (5.0, 2.0), (None, None)], "x double, y double").select("*", geo.rings(F.lit(square)).alias("rings"))
    assert [r["x"] for r in geo.in_polygon(df, "x", "y", "rings").collect()] == [2.0, None]
    g = geo.grid(spark.range(1).select(geo.rings(F.lit(square)).alias("rings")), "rings", 111.32).collect()
    assert g and all(0 <= r["lat"] <= 4 and 0 <= r["lng"] <= 4 for r in g)
    assert on(spark, geo.rings, "nonsense") == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab1.@-( )5+", max_size=30), min_size=1, max_size=8))
def test_extraction_properties(spark, texts):
    df = spark.createDataFrame([(x,) for x in texts], "s string").select(text.emails(F.col("s")).alias("e"), text.phones(F.col("s")).alias("p"))
    for r in df.collect():
        assert r["e"] == sorted(set(r["e"])) and all(re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", p) for p in r["p"])
