"""The registered queries: one for each operator or family, over whole tables, with the same query in SQL.

Operators that read HTML get pages made from the tables (``site_pages``, ``profile_pages``), so that the SQL can say
what they must find again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import runtime
from leadloom.functions import display, fixed, forms, geo, listing, scoring, structured, text, urls
from leadloom.operators import catalog, dedup, enrich, expand, merge, pipeline
from leadloom.sources import readers, sinks
from leadloom.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = 1_790_000_000.0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return runtime.table(spark, d, name)


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def c(name: str):
    return F.coalesce(F.col(name), F.lit(""))


# --- text -------------------------------------------------------------------------------------------------------------

_EMAILS = f"""m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{fixed.EMAIL}')) AS m FROM documents)
SELECT DISTINCT doc_id, lower(m) AS email FROM m
WHERE lower(split_part(m, '@', 2)) NOT IN ({quoted(fixed.IGNORED_MAIL_HOSTS)}) AND lower(split_part(m, '@', 1)) NOT IN ({quoted(fixed.IGNORED_MAIL_NAMES)})
  AND NOT regexp_matches(lower(split_part(m, '@', 1)), '{fixed.IMAGE_NAME}')"""


@query("emails_documents", f"WITH {_EMAILS}")
def emails_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(text.emails(F.col("text"))).alias("email"))


@query("distinct_emails", f"WITH e AS (WITH {_EMAILS}) SELECT DISTINCT email FROM e")
def distinct_emails(spark, d):
    return sinks.distinct_emails(t(spark, d, "documents").select(text.emails(F.col("text")).alias("emails")))


@query("mailto_emails", r"""WITH e AS (SELECT lead_id, unnest(emails) AS e FROM leads)
SELECT lead_id, lower(e) AS email FROM e WHERE regexp_full_match(e, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}')""")
def mailto_emails(spark, d):
    html = F.array_join(F.transform(F.filter("emails", lambda e: e.rlike(f"^{fixed.EMAIL}$")), lambda e: F.concat(F.lit('<a href="MailTo:'), e, F.lit('">write</a>'))), "\n")
    return t(spark, d, "leads").select("lead_id", F.explode(text.mailto_emails(html)).alias("email"))


@query("phones_documents", r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^0-9])((?:\+?1[-.\s]?)?\(?[2-9][0-9]{2}\)?[-.\s]?[2-9][0-9]{2}[-.\s]?[0-9]{4})(?:[^0-9]|$)', 1)) AS m FROM documents),
n AS (SELECT doc_id, regexp_replace(m, '[^0-9]', '', 'g') AS n FROM m), k AS (SELECT DISTINCT doc_id, CASE WHEN length(n) = 11 THEN substr(n, 2) ELSE n END AS k FROM n)
SELECT doc_id, '(' || substr(k, 1, 3) || ') ' || substr(k, 4, 3) || '-' || substr(k, 7) AS phone FROM k WHERE length(k) = 10""")
def phones_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(text.phones(F.col("text"))).alias("phone"))


@query("description_documents", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]'), lambda x: trim(x, ' ')), lambda x: length(x) > 60 AND NOT starts_with(x, '#')) AS l FROM documents)
SELECT doc_id, coalesce(substr(l[1], 1, 300), '') AS description FROM l""")
def description_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", text.description(F.col("text")).alias("description"))


@query("social_links", """SELECT lead_id, 'facebook' AS network, 'https://www.facebook.com/' || lead_id AS link FROM leads
UNION ALL SELECT lead_id, 'twitter', CASE WHEN lead_id % 2 = 0 THEN 'https://netflix.com/' || lead_id ELSE 'http://x.com/' || lead_id END FROM leads""")
def social_links(spark, d):
    first = F.when(F.col("lead_id") % 2 == 0, F.concat(F.lit("https://netflix.com/"), "lead_id")).otherwise(F.concat(F.lit("http://x.com/"), "lead_id"))
    page = F.concat(F.lit("see (https://www.facebook.com/"), "lead_id", F.lit(") and "), first, F.lit(' or "https://twitter.com/later"> https://facebook.com/later https://w3.org/x'))
    return t(spark, d, "leads").select("lead_id", F.explode(text.social_links(page)).alias("network", "link"))


@query("street_address", "SELECT lead_id, (lead_id % 9000 + 1) || ' Main St, Denver, CO ' || (80000 + lead_id % 999) AS address FROM leads")
def street_address(spark, d):
    body = F.concat(F.lit("Find us: "), (F.col("lead_id") % 9000 + 1).cast("string"), F.lit(" Main St, Denver, CO "), (80000 + F.col("lead_id") % 999).cast("string"), F.lit(" today"))
    return t(spark, d, "leads").select("lead_id", text.street_address(body).alias("address"))


_NAME = "".join(f"WHEN contains(x, '{b}') THEN trim(split_part(x, '{b}', 1), ' ') " for b in fixed.TITLE_BREAKS)


@query("company_title", f"""WITH x AS (SELECT lead_id, trim(coalesce(company, '') || ' | Home', ' ') AS x, coalesce(url, '') AS url FROM leads), n AS (SELECT lead_id, url, CASE {_NAME} ELSE x END AS n FROM x)
SELECT lead_id, CASE WHEN length(n) >= 3 THEN substr(n, 1, 120) ELSE regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) END AS company FROM n""")
def company_title(spark, d):
    html = F.concat(F.lit("<head><title>"), F.translate(c("company"), "<", " "), F.lit(" | Home</title></head>"))
    return t(spark, d, "leads").select("lead_id", text.company_name(html, F.lit(""), c("url")).alias("company"))


@query("business_hours", "SELECT lead_id, 'Mon-Fri ' || (lead_id % 5 + 7) || 'am-5pm' AS hours FROM leads")
def business_hours(spark, d):
    body = F.concat(F.lit("# Shop\nHours:  Mon-Fri   "), (F.col("lead_id") % 5 + 7).cast("string"), F.lit("am-5pm"))
    return t(spark, d, "leads").select("lead_id", text.business_hours(body).alias("hours"))


# --- URLs -------------------------------------------------------------------------------------------------------------

_DOMAINS = r"""u AS (SELECT lead_id, CASE WHEN regexp_matches(trim(url, ' '), '^(http://|https://|file://|raw:)') THEN trim(url, ' ') ELSE 'https://' || trim(url, ' ') END AS u FROM leads WHERE trim(coalesce(url, ''), ' ') <> ''),
a AS (SELECT lead_id, u, lower(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS a FROM u)"""


def _urls(spark, d):
    return t(spark, d, "leads").where(F.trim(c("url")) != "").select("lead_id", urls.normalize_url(F.col("url")).alias("u"))


@query("page_domain", f"WITH {_DOMAINS} SELECT lead_id, u, nullif(regexp_replace(a, '^www\\.', ''), '') AS domain, ltrim(a, 'w.') AS loose FROM a")
def page_domain(spark, d):
    return _urls(spark, d).select("lead_id", "u", urls.domain(F.col("u")).alias("domain"), urls.loose_domain(F.col("u")).alias("loose"))


_SKIP = " OR ".join(f"ends_with(ltrim(a, 'w.'), '{h}')" for h in fixed.SKIPPED_HOSTS)


@query("filter_urls", f"WITH {_DOMAINS}, f AS (SELECT lead_id, u, row_number() OVER (PARTITION BY ltrim(a, 'w.') ORDER BY lead_id) AS n FROM a WHERE NOT ({_SKIP})) SELECT lead_id, u FROM f WHERE n = 1")
def filter_urls(spark, d):
    return dedup.business_urls(_urls(spark, d), "u", "lead_id")


@query("short_url", r"""WITH u AS (SELECT lead_id, url AS u, regexp_extract(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^(?:[^@]*@)?([^:]*)', 1) AS h, regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) AS p FROM leads)
SELECT lead_id, CASE WHEN h = '' THEN u ELSE h || CASE WHEN p IN ('/', '') THEN '' ELSE p END END AS shown FROM u""")
def short_url(spark, d):
    return t(spark, d, "leads").select("lead_id", urls.short_url(F.col("url")).alias("shown"))


@query("internal_links", f"""WITH {_DOMAINS}, r AS (SELECT lead_id, u, regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS r FROM u)
SELECT lead_id, row_number() OVER (PARTITION BY lead_id ORDER BY k) AS pos, link FROM (SELECT lead_id, u, 1 AS k, r || '/contact' AS link FROM r UNION ALL SELECT lead_id, u, 2, r || '/a' || lead_id FROM r) WHERE link <> u""")
def internal_links(spark, d):
    page = F.concat(F.lit('<a href="/a'), "lead_id", F.lit("\"><a href='/contact'><a href=\"/list.pdf\"><a href=\"mailto:x@y.example\"><a href=\"https://elsewhere.example/about\"><a href=\"/contact\"><a href=\""), "u", F.lit('"><a href="#top">'))
    links = urls.internal_links(page, F.regexp_replace("u", r"[#\"'].*$", ""))
    clean = _urls(spark, d)
    return clean.select("lead_id", F.posexplode(links).alias("pos", "link")).select("lead_id", (F.col("pos") + 1).cast("long").alias("pos"), "link")


@query("result_urls", """SELECT lead_id, kind, url FROM (SELECT lead_id, unnest(['redirect', 'listed', 'header', 'outside', 'outside']) AS kind, unnest(['https://a.example/?x=1+2&id=' || lead_id, 'https://b.example/' || lead_id, 'https://c.example/' || lead_id, 'https://d.example/' || lead_id, 'https://e.example/' || lead_id]) AS url FROM leads)""")
def result_urls(spark, d):
    i = F.col("lead_id").cast("string")
    pages = {
        "redirect": urls.redirect_urls(F.concat(F.lit('<a href="/l/?uddg=https%3A%2F%2Fa.example%2F%3Fx%3D1+2%26id%3D'), i, F.lit('&rut=1">')), F.lit("")),
        "listed": urls.listed_urls(F.concat(F.lit('<li class="b_algo" id="1"><h2><a href="https://b.example/'), i, F.lit('" h="x"></h2> <a href="https://no.example"></li>'))),
        "header": urls.header_urls(F.lit("<p>"), F.concat(F.lit("- [C](https://c.example/"), i, F.lit(") text"))),
        "outside": urls.outside_urls(F.concat(F.lit("https://www.google.com/x https://d.example/"), i, F.lit(" ")), F.concat(F.lit("[E](https://e.example/"), i, F.lit(") [G](https://maps.google.com/)"))),
    }
    e = F.flatten(F.array(*[_tagged(k, v) for k, v in pages.items()]))
    return t(spark, d, "leads").select("lead_id", F.explode(e).alias("e")).select("lead_id", "e.*")


def _tagged(kind, found):
    return F.transform(found, lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("url")))


@query("directory_urls", "SELECT DISTINCT profile_id, 'https://homestars.com/companies/' || profile_id || '-x' AS page FROM directory_profiles")
def directory_urls(spark, d):
    link = F.concat(F.lit("https://www.homestars.com/companies/"), "profile_id", F.lit("-x"))
    return t(spark, d, "directory_profiles").select("profile_id", F.explode(urls.directory_urls(F.concat_ws(" ", link, link, F.lit("http://homestars.com/")))).alias("page"))


@query("engines_union", r"""WITH a AS (SELECT url, 0 AS e, profile_id AS p FROM directory_profiles WHERE url LIKE 'http%' UNION ALL SELECT url, 1, rec_id FROM lead_batches WHERE url LIKE 'http%'),
h AS (SELECT url, row_number() OVER (PARTITION BY ltrim(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), 'w.') ORDER BY e, p) AS n FROM a) SELECT url FROM h WHERE n = 1""")
def engines_union(spark, d):
    a = t(spark, d, "directory_profiles").where("url like 'http%'").select("url", (F.col("profile_id") - 5_000_000_000).alias("pos"))
    b = t(spark, d, "lead_batches").where("url like 'http%'").select("url", F.col("rec_id").alias("pos"))
    return readers.engines(a, b).select("url")


# --- structured pages -------------------------------------------------------------------------------------------------


def site_pages(spark, d) -> DataFrame:
    """A page for each lead with a company: JSON-LD, title, mail links."""
    leads = t(spark, d, "leads").where("error is null and company is not null")
    ld = F.to_json(F.struct(F.lit("LocalBusiness").alias("@type"), F.trim("company").alias("name"), F.try_element_at("phones", F.lit(1)).alias("telephone"), F.struct(F.trim("address").alias("streetAddress"), F.col("state").alias("addressRegion")).alias("address"), F.array(F.lit("Mo-Fr"), F.lit("Sa")).alias("openingHours"), F.lit("https://sn.example/a").alias("sameAs")))
    mails = F.array_join(F.transform(F.coalesce("emails", F.array().cast("array<string>")), lambda e: F.concat(F.lit('<a href="mailto:'), e, F.lit('">m</a>'))), "")
    html = F.concat(F.lit("<html><head><title>t</title><script type='application/ld+json'>{\"@graph\": [{\"@type\": \"WebPage\"}, "), ld, F.lit("]}</script><script type='application/ld+json'>{broken</script></head><body>"), mails, F.lit("</body></html>"))
    return leads.select("lead_id", F.concat(F.lit("https://s"), "lead_id", F.lit(".example/")).alias("url"), html.alias("html"))


@query("json_ld", r"""SELECT lead_id, nullif(trim(company, ' '), '') AS name, nullif(trim(phones[1], ' '), '') AS phone, 'Mo-Fr, Sa' AS hours,
nullif(concat_ws(', ', nullif(trim(address, ' '), ''), nullif(state, '')), '') AS address FROM leads WHERE error IS NULL AND company IS NOT NULL""")
def json_ld(spark, d):
    return site_pages(spark, d).select("lead_id", structured.json_ld(F.col("html")).alias("x")).select("lead_id", "x.name", "x.phone", "x.hours", "x.address")


def profile_pages(spark, d) -> DataFrame:
    p = t(spark, d, "directory_profiles")
    company = F.to_json(F.struct(F.col("company").alias("companyName"), F.col("homestars_rating").alias("starScore"), F.col("homestars_reviews").cast("string").alias("numReviews"), F.try_element_at("phones", F.lit(1)).alias("phoneNumber"), F.col("url").alias("websiteUrl"), F.col("address").alias("street"), F.col("city"), F.array(F.struct(F.col("category").alias("name"))).alias("services"), F.col("homestars_verified").alias("isVerified"), F.col("homestars_years").alias("experience")))
    html = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"professional": '), company, F.lit("}}}</script>"))
    return p.select("profile_id", "source_city", F.col("homestars_url").alias("url"), html.alias("html"), F.lit("").alias("text"))


@query("directory_companies", r"""WITH p AS (SELECT profile_id, homestars_rating, homestars_years, nullif(trim(company, ' '), '') AS company, coalesce(nullif(trim(category, ' '), ''), '') AS category, nullif(trim(url, ' '), '') AS url, nullif(trim(phones[1], ' '), '') AS phone, nullif(trim(address, ' '), '') AS address, nullif(trim(city, ' '), '') AS city, homestars_reviews, homestars_verified FROM directory_profiles)
SELECT profile_id, company, category, coalesce(CASE WHEN regexp_matches(CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://' || url END, '^(http://|https://)') THEN CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://' || url END ELSE 'https://' || url END, '') AS url,
coalesce(phone, '') AS phone, concat_ws(', ', address, city) AS address, round(homestars_rating, 1) AS rating, homestars_reviews AS reviews, coalesce(homestars_verified, false) AS verified, homestars_years AS years FROM p WHERE company IS NOT NULL""")
def directory_companies(spark, d):
    x = profile_pages(spark, d).select("profile_id", structured.directory_company(structured.profile_node(structured.next_data(F.col("html"))), F.col("url")).alias("x"))
    return x.where("x is not null").select("profile_id", "x.company", "x.category", "x.url", F.array_join("x.phones", "").alias("phone"), "x.address", F.col("x.homestars_rating").alias("rating"), F.col("x.homestars_reviews").alias("reviews"), F.col("x.homestars_verified").alias("verified"), F.col("x.homestars_years").alias("years"))


@query("directory_leads", r"""WITH p AS (SELECT homestars_url, profile_id, trim(company, ' ') AS company, source_city FROM directory_profiles WHERE trim(coalesce(company, ''), ' ') <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY homestars_url ORDER BY profile_id) AS n FROM p)
SELECT homestars_url, company, source_city FROM n WHERE n = 1 OR coalesce(homestars_url, '') = ''""")
def directory_leads(spark, d):
    pages = profile_pages(spark, d)
    named = t(spark, d, "directory_profiles").where(F.trim(c("company")) != "").select("profile_id")
    return pipeline.directory_leads(pages.join(named, "profile_id", "left_semi"), "profile_id").select("homestars_url", "company", "source_city")


_MAPS = "maps_url LIKE 'https://maps.example/place/%'"


@query("listings", f"""WITH m AS (SELECT lead_id, latitude, longitude, coalesce(place_id, '') AS place_id, maps_url FROM leads WHERE {_MAPS} AND latitude IS NOT NULL)
SELECT lead_id, 'Shop ' || lead_id AS name, 'https://www.google.com/maps/place/Shop+' || lead_id || '/@' || printf('%.6f', latitude) || ',' || printf('%.6f', longitude) || ',17z' AS maps_url, CAST(printf('%.6f', latitude) AS DOUBLE) AS latitude, CAST(printf('%.6f', longitude) AS DOUBLE) AS longitude FROM m""")
def listings(spark, d):
    m = t(spark, d, "leads").where(_MAPS).where("latitude is not null")
    href = F.concat(F.lit("/maps/place/Shop+"), "lead_id", F.lit("/@"), F.format_string("%.6f", "latitude"), F.lit(","), F.format_string("%.6f", "longitude"), F.lit(",17z"))
    html = F.concat(F.lit('<a class="x" href="'), href, F.lit('">'), F.lit('<a href="'), href, F.lit('?hl=en">'))
    return m.select("lead_id", F.explode(listing.listings(html)).alias("l")).select("lead_id", "l.name", "l.maps_url", "l.latitude", "l.longitude")


@query("listing_detail", r"""SELECT lead_id, 4.5 AS rating, CAST(lead_id % 3000 AS INTEGER) AS review_count, lead_id || ' Oak Rd, Denver, CO 80202' AS address, 'Denver' AS city, 'CO' AS state, '80202' AS zip_code, '(416) 555-' || lpad(CAST(lead_id % 10000 AS VARCHAR), 4, '0') AS phone, 'https://s' || lead_id || '.example' AS website, lead_id % 2 = 0 AS is_permanently_closed FROM leads""")
def listing_detail(spark, d):
    i = F.col("lead_id").cast("string")
    html = F.concat(F.lit('<div aria-label="4.5 stars '), (F.col("lead_id") % 3000).cast("string"), F.lit(' Reviews"></div><button aria-label="Address: '), i, F.lit(' Oak Rd, Denver, CO 80202"></button><a data-item-id="authority" href="https://s'), i, F.lit('.example">w</a>'), F.when(F.col("lead_id") % 2 == 0, "Permanently closed").otherwise(""))
    md = F.concat(F.lit("call (416) 555-"), F.lpad((F.col("lead_id") % 10000).cast("string"), 4, "0"))
    x = t(spark, d, "leads").select("lead_id", listing.detail(html, md, F.lit("https://www.google.com/maps/place/A/@1.5,2.5,17z")).alias("x"))
    return x.select("lead_id", *[f"x.{k}" for k in ("rating", "review_count", "address", "city", "state", "zip_code", "phone", "website", "is_permanently_closed")])


@query("review_distribution", "SELECT lead_id, '5' AS stars, CAST(lead_id % 700 AS INTEGER) AS n FROM leads UNION ALL SELECT lead_id, '1', 3 FROM leads")
def review_distribution(spark, d):
    html = F.concat(F.lit('<tr aria-label="5 stars, '), (F.col("lead_id") % 700).cast("string"), F.lit(' reviews"><tr aria-label="1 star, 3 reviews">'))
    return t(spark, d, "leads").select("lead_id", F.explode(listing.review_distribution(html, F.lit(0))).alias("stars", "n"))


@query("reviews_parse", r"""WITH x AS (SELECT lead_id, google_rating AS g, CASE WHEN google_reviews IS NOT NULL THEN google_reviews END AS n FROM leads WHERE google_rating IS NOT NULL AND google_rating >= 0)
SELECT lead_id, CASE WHEN g <= 5 THEN g END AS rating, n AS reviews FROM x""")
def reviews_parse(spark, d):
    x = t(spark, d, "leads").where("google_rating is not null and not isnan(google_rating) and google_rating >= 0")
    body = F.when(F.col("google_reviews").isNotNull(), F.concat(F.lit("Rated "), F.col("google_rating").cast("string"), F.lit(" ("), F.format_number("google_reviews", 0), F.lit(") by guests"))).otherwise(F.concat(F.col("google_rating").cast("string"), F.lit(" out of 5")))
    return x.select("lead_id", listing.reviews(body).alias("r")).select("lead_id", F.col("r.google_rating").alias("rating"), F.col("r.google_reviews").alias("reviews"))


@query("address_parts", r"""WITH p AS (SELECT lead_id, address, list_transform(string_split(address, ','), lambda x: trim(x, ' ')) AS p FROM leads WHERE address IS NOT NULL), n AS (SELECT *, len(p) AS n, regexp_extract(p[-1], '^([A-Z]{2})\s*(\d{5}(?:-\d{4})?)?', 1) AS s, regexp_extract(p[-1], '^([A-Z]{2})\s*(\d{5}(?:-\d{4})?)?', 2) AS z FROM p)
SELECT lead_id, CASE WHEN n >= 2 THEN p[1] END AS street, CASE WHEN n >= 3 THEN p[-2] WHEN n = 2 THEN p[-1] END AS city, CASE WHEN n >= 3 THEN CASE WHEN s <> '' THEN s ELSE p[-1] END END AS state, CASE WHEN n >= 3 AND s <> '' THEN z END AS zip_code, CASE WHEN n >= 2 THEN p[-2] ELSE p[1] END AS hint FROM n""")
def address_parts(spark, d):
    a = t(spark, d, "leads").where("address is not null")
    return a.select("lead_id", listing.address_parts(F.col("address")).alias("x"), listing.location_hint(F.col("address")).alias("hint")).select("lead_id", "x.*", "hint")


# --- scoring, ranking, export -----------------------------------------------------------------------------------------

_SCORE = f"""s AS (SELECT lead_id, url, company, google_reviews, error, CASE WHEN error IS NOT NULL THEN -2 ELSE
  CASE WHEN len(emails) > 0 THEN CASE WHEN len(list_filter(emails, lambda e: contains(split_part(e, '@', 1), '.') OR lower(split_part(e, '@', 1)) NOT IN ({quoted(fixed.GENERIC_MAIL_NAMES)}))) > 0 THEN 3 ELSE 2 END ELSE 0 END
  + CASE WHEN len(phones) > 0 THEN 2 ELSE 0 END + CASE WHEN coalesce(address, '') <> '' THEN 1 ELSE 0 END + CASE WHEN cardinality(socials) > 0 THEN 1 ELSE 0 END
  + CASE WHEN google_reviews <= 50 THEN 2 WHEN google_reviews <= 200 THEN 1 WHEN google_reviews > 1000 THEN -1 ELSE 0 END + CASE WHEN google_rating < 3 THEN -1 ELSE 0 END END AS score FROM leads),
k AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'dead' WHEN score >= 7 THEN 'hot' WHEN score >= 4 THEN 'warm' WHEN score >= 1 THEN 'cold' ELSE 'dead' END AS tier FROM s)"""


def _scored(spark, d):
    return scoring.annotate(t(spark, d, "leads").drop("score", "tier"))


@query("ranked_leads", f"WITH {_SCORE} SELECT row_number() OVER (ORDER BY score DESC, coalesce(google_reviews, 0) DESC, lead_id) AS place, lead_id, company, CAST(score AS INTEGER) AS score, tier FROM k")
def ranked_leads(spark, d):
    """Score, tier and place. Places come from a distributed sort, so no task holds all rows: range partitions are numbered and shifted."""
    rows = _scored(spark, d).select("lead_id", "company", "score", "tier", F.coalesce("google_reviews", F.lit(0)).alias("r"))
    keys = [F.col("score").desc(), F.col("r").desc(), F.col("lead_id")]
    parts = runtime.materialize(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ranked")
    from pyspark.sql import Window as W

    own = parts.withColumn("n", F.row_number().over(W.partitionBy("part").orderBy(*keys)))
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.size"), F.lit(0)).alias("before"))
    return own.join(F.broadcast(before), "part").select((F.col("before") + F.col("n")).alias("place"), "lead_id", "company", "score", "tier")


@query("tier_breakdown", f"WITH {_SCORE} SELECT tier, count(*) AS leads FROM k GROUP BY tier")
def tier_breakdown(spark, d):
    return _scored(spark, d).groupBy(F.coalesce("tier", F.lit("unknown")).alias("tier")).agg(F.count("*").alias("leads")).orderBy("tier")


@query("status_counts", "SELECT coalesce(event_type, 'unknown') AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, d):
    return t(spark, d, "events").groupBy(F.coalesce("event_type", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n")).orderBy("status")


@query("enriched_count", "SELECT count(*) AS leads, count(*) FILTER (WHERE len(emails) > 0 OR cardinality(socials) > 0) AS enriched, count(*) FILTER (WHERE error IS NULL AND url <> '' AND coalesce(len(emails), 0) = 0) AS needs_outreach FROM leads")
def enriched_count(spark, d):
    some = lambda x: F.coalesce(F.size(x), F.lit(0)) > 0
    return t(spark, d, "leads").agg(F.count("*").alias("leads"), F.count_if(some("emails") | some("socials")).alias("enriched"), F.count_if(F.col("error").isNull() & (F.col("url") != "") & ~some("emails")).alias("needs_outreach"))


@query("export_web", """SELECT coalesce(tier, '') AS tier, coalesce(CAST(score AS VARCHAR), '') AS score, coalesce(url, '') AS url, coalesce(company, '') AS company, coalesce(array_to_string(emails, '; '), '') AS emails, coalesce(array_to_string(phones, '; '), '') AS phones, coalesce(address, '') AS address, coalesce(city, '') AS city,
coalesce(CAST(google_reviews AS VARCHAR), '') AS google_reviews, '' AS neighborhood, coalesce(place_id, '') AS place_id, '' AS is_closed, coalesce(source_city, '') AS source_city FROM leads WHERE error IS NULL""")
def export_web(spark, d):
    shown = ["tier", "score", "url", "company", "emails", "phones", "address", "city", "google_reviews", "neighborhood", "place_id", "is_closed", "source_city"]
    return sinks.export(t(spark, d, "leads")).select(*shown)


@query("export_cli", "SELECT coalesce(tier, '') AS tier, coalesce(url, '') AS url, coalesce(array_to_string(emails, '; '), '') AS emails, '' AS hours FROM leads")
def export_cli(spark, d):
    return sinks.export(t(spark, d, "leads"), "cli").select("tier", "url", "emails", "hours")


@query("node_items", "SELECT company, url, address, category, score, tier, 'job-1' AS \"_jobId\", CAST(NULL AS VARCHAR) AS message FROM leads WHERE error IS NULL")
def node_items(spark, d):
    return sinks.node_items(t(spark, d, "leads"), "job-1").drop("emails", "phones")


@query("workflow_rows", "SELECT coalesce(company, '') AS company, coalesce(array_to_string(phones, '; '), '') AS phones, coalesce(CAST(score AS VARCHAR), '') AS score FROM leads")
def workflow_rows(spark, d):
    one = t(spark, d, "leads").select(F.array(F.struct("*")).alias("leads"))
    return sinks.workflow_rows(one).select("company", "phones", "score")


@query("source_counts", "SELECT source_city, count(*) AS leads FROM leads GROUP BY source_city")
def source_counts(spark, d):
    return pipeline.new_per_city(t(spark, d, "leads"))


@query("display_fields", """SELECT lead_id, CASE WHEN google_reviews IS NULL THEN '—' WHEN google_reviews = 0 THEN '—' WHEN google_reviews >= 3600 THEN (google_reviews // 3600) || 'h ' || (google_reviews % 3600 // 60) || 'm' WHEN google_reviews < 60 THEN google_reviews || 's' ELSE (google_reviews // 60) || 'm ' || (google_reviews % 60) || 's' END AS took,
CASE WHEN coalesce(source_city, '') = '' THEN '—' ELSE source_city END AS label, '3 cities' AS cities, substr(regexp_replace(coalesce(source_city, ''), '[^\\p{L}\\p{N}_-]', '_', 'g'), 1, 40) AS file FROM leads""")
def display_fields(spark, d):
    return t(spark, d, "leads").select("lead_id", display.duration(F.col("google_reviews")).alias("took"), display.cities_label(F.col("source_city")).alias("label"), display.cities_label(F.lit("[1, 2, 3]")).alias("cities"), display.safe_label(c("source_city")).alias("file"))


@query("shown_rating", "SELECT lead_id, google_rating IS NOT NULL AS by_map, coalesce(google_rating, homestars_rating) AS value FROM leads")
def shown_rating(spark, d):
    x = t(spark, d, "leads").select("lead_id", display.shown_rating(F.col("google_rating"), F.col("homestars_rating")).alias("s"), "google_rating", "homestars_rating")
    return x.select("lead_id", F.col("google_rating").isNotNull().alias("by_map"), F.regexp_replace("s", "/10$", "").cast("double").alias("value"))


# --- joins and merges -------------------------------------------------------------------------------------------------

_VALID = "SELECT DISTINCT d AS domain, length(d) % 3 <> 0 AS valid FROM (SELECT trim(lower(split_part(e, '@', -1))) AS d FROM (SELECT unnest(emails) AS e FROM leads) WHERE contains(e, '@')) WHERE length(d) % 5 <> 0"
_MAIL = f"v AS ({_VALID}), e AS (SELECT lead_id, unnest(emails) AS email FROM leads), m AS (SELECT lead_id, email, coalesce(valid, true) AS ok FROM e LEFT JOIN v ON contains(email, '@') AND v.domain = trim(lower(split_part(email, '@', -1))))"


def _validated(spark, d):
    leads = t(spark, d, "leads").select("lead_id", "emails")
    dom = leads.select(F.explode("emails").alias("e")).select(urls.email_domain(F.col("e")).alias("domain")).where("domain is not null and length(domain) % 5 <> 0").distinct()
    return enrich.validate_emails(leads, "lead_id", dom.withColumn("valid", F.length("domain") % 3 != 0))


@query("mx_valid", f"WITH {_MAIL} SELECT lead_id, email FROM m WHERE ok")
def mx_valid(spark, d):
    return _validated(spark, d).select("lead_id", F.explode("emails").alias("email"))


@query("mx_invalid", f"WITH {_MAIL} SELECT lead_id, email FROM m WHERE NOT ok")
def mx_invalid(spark, d):
    return _validated(spark, d).select("lead_id", F.explode("invalid_emails").alias("email"))


@query("import_merge", r"""WITH l AS (SELECT url, company, phones, address, emails, row_number() OVER (PARTITION BY url ORDER BY lead_id DESC) AS n FROM leads WHERE error IS NULL AND url <> ''),
p AS (SELECT profile_id, coalesce(company, '') AS company, coalesce(CASE WHEN trim(coalesce(url, ''), ' ') = '' THEN '' WHEN regexp_matches(trim(url, ' '), '^(http://|https://|file://|raw:)') THEN trim(url, ' ') ELSE 'https://' || trim(url, ' ') END, '') AS url, coalesce(phones[1], '') AS phone, coalesce(address, '') AS address FROM directory_profiles)
SELECT p.profile_id, p.url, CASE WHEN p.company <> '' THEN p.company ELSE coalesce(nullif(l.company, ''), p.company) END AS company, CASE WHEN p.phone <> '' THEN p.phone ELSE coalesce(array_to_string(l.phones, '|'), '') END AS phones, CASE WHEN p.address <> '' THEN p.address ELSE coalesce(nullif(l.address, ''), p.address) END AS address, coalesce(array_to_string(list_sort(list_distinct(l.emails)), '|'), '') AS emails
FROM p LEFT JOIN l ON p.url = l.url AND l.n = 1""")
def import_merge(spark, d):
    p = t(spark, d, "directory_profiles")
    text_ = lambda n: F.lit(None).cast("string").alias(n)
    records = p.select("profile_id", F.col("company").alias("title"), F.col("url").alias("website"), text_("url"), F.try_element_at("phones", F.lit(1)).alias("phone"), "address", *[text_(n) for n in ("name", "phoneUnformatted", "street", "city", "postalCode", "description", "openingHours", "categoryName", "totalScore", "reviewsCount", "neighborhood")])
    own = merge.import_record(records.withColumn("neighborhood", F.col("profile_id").cast("string")))
    scraped = t(spark, d, "leads").withColumn("hours", F.lit(None).cast("string"))
    x = merge.enrich_records(own, scraped, "lead_id")
    return x.select(F.col("neighborhood").cast("long").alias("profile_id"), "url", "company", F.array_join("phones", "|").alias("phones"), "address", F.array_join("emails", "|").alias("emails"))


@query("replace_by_url", "WITH r AS (SELECT url, domain, max_by(rec_id, rec_id) AS rec_id FROM (SELECT url, rec_id, 'b' AS domain FROM lead_batches WHERE url <> '') GROUP BY url, domain) SELECT l.url, coalesce(r.rec_id, l.lead_id) AS id FROM leads l LEFT JOIN r ON l.url = r.url")
def replace_by_url(spark, d):
    leads = t(spark, d, "leads").select("url", F.col("lead_id").alias("id"))
    results = t(spark, d, "lead_batches").where("url <> ''").select("url", F.col("rec_id").alias("id"))
    return merge.replace_by_url(leads, results, "id")


@query("listing_join", "SELECT l.maps_url, coalesce(p.company, l.company) AS name, coalesce(p.address, l.address, '') AS address, coalesce(p.homestars_rating, l.google_rating) AS rating FROM (SELECT any_value(company) AS company, min(address) AS address, min(google_rating) AS google_rating, maps_url FROM (SELECT * FROM leads WHERE maps_url <> '' AND lead_id IN (SELECT min(lead_id) FROM leads GROUP BY maps_url)) GROUP BY maps_url) l LEFT JOIN (SELECT company, address, homestars_rating, 'https://maps.example/place/' || profile_id AS maps_url FROM directory_profiles) p ON l.maps_url = p.maps_url")
def listing_join(spark, d):
    ls = dedup.first_per_key(t(spark, d, "leads").select("lead_id", "maps_url", F.col("company").alias("name"), "address", F.col("google_rating").alias("rating"), "place_id").where("maps_url <> ''"), F.col("maps_url"), F.col("lead_id")).drop("lead_id")
    details = t(spark, d, "directory_profiles").select(F.concat(F.lit("https://maps.example/place/"), "profile_id").alias("maps_url"), F.col("company").alias("name"), "address", F.col("homestars_rating").alias("rating"))
    return merge.listing_with_detail(ls, details).select("maps_url", "name", "address", "rating")


@query("cross_city_dedup", "WITH n AS (SELECT lead_id, place_id, row_number() OVER (PARTITION BY place_id ORDER BY lead_id) AS n FROM leads) SELECT lead_id FROM n WHERE n = 1 OR coalesce(place_id, '') = ''")
def cross_city_dedup(spark, d):
    return dedup.first_per_key(t(spark, d, "leads").select("lead_id", "place_id"), F.col("place_id"), F.col("lead_id"), keep_blank=True).select("lead_id")


@query("two_key_dedup")
def two_key_dedup(spark, d):
    return dedup.two_key_greedy(t(spark, d, "leads").select("lead_id", "place_id", "url"), "place_id", "url", "lead_id")


# --- catalog ----------------------------------------------------------------------------------------------------------


@query("cache_fresh", f"SELECT domain, scraped_at FROM leads_cache WHERE scraped_at >= {AS_OF} - {200 * catalog.DAY}")
def cache_fresh(spark, d):
    return catalog.fresh(t(spark, d, "leads_cache"), "scraped_at", AS_OF, 200 * catalog.DAY).select("domain", "scraped_at")


@query("cache_lookup", rf"""WITH {_DOMAINS}, k AS (SELECT lead_id, nullif(regexp_replace(a, '^www\.', ''), '') AS domain FROM a) SELECT k.lead_id, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.company') END AS company FROM k LEFT JOIN (SELECT * FROM leads_cache WHERE scraped_at >= {AS_OF} - {300 * catalog.DAY}) c ON k.domain = c.domain""")
def cache_lookup(spark, d):
    x = catalog.cached(_urls(spark, d).withColumnRenamed("u", "url"), t(spark, d, "leads_cache"), AS_OF, 300 * catalog.DAY)
    return x.select("lead_id", structured.at(F.col("payload"), "$.company").alias("company"))


@query("cache_upsert", r"""WITH n AS (SELECT lead_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS domain FROM leads WHERE error IS NULL), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY lead_id DESC) AS k FROM n WHERE domain <> '')
SELECT domain, url FROM r WHERE k = 1 UNION ALL SELECT domain, url FROM leads_cache WHERE domain NOT IN (SELECT domain FROM r)""")
def cache_upsert(spark, d):
    new = t(spark, d, "leads").select("lead_id", "url", "error", F.lit("{}").alias("payload"), F.lit(AS_OF).alias("scraped_at"))
    return catalog.upsert(t(spark, d, "leads_cache"), new, "lead_id").select("domain", "url")


@query("cache_stats", "SELECT (SELECT count(*) FROM leads_cache) AS cached_leads, (SELECT count(*) FROM lead_batches) AS batch_records, (SELECT count(*) FROM leads) AS leads")
def cache_stats(spark, d):
    return catalog.counts(cached_leads=t(spark, d, "leads_cache"), batch_records=t(spark, d, "lead_batches"), leads=t(spark, d, "leads"))


_RUNS = "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN '' ELSE 'u' || (o_custkey % 5) END AS user_id, o_orderdate AS created_at, o_orderstatus AS status FROM orders"


def _runs(spark, d):
    user = F.when(F.col("o_custkey") % 3 == 0, None).when(F.col("o_custkey") % 3 == 1, "").otherwise(F.concat(F.lit("u"), (F.col("o_custkey") % 5).cast("string")))
    return t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), user.alias("user_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))


@query("run_history", f"SELECT run_id, status FROM ({_RUNS}) WHERE user_id = 'u2' OR user_id IS NULL OR user_id = '' ORDER BY created_at DESC, run_id LIMIT 100")
def run_history(spark, d):
    return catalog.run_history(_runs(spark, d), "u2").select("run_id", "status")


@query("run_detail", f"SELECT run_id, status, NOT EXISTS (SELECT 1 FROM lead_batches b WHERE CAST(b.rec_id AS VARCHAR) = r.run_id) AS backup_expired FROM ({_RUNS}) r WHERE run_id = '33'")
def run_detail(spark, d):
    b = t(spark, d, "lead_batches").select(F.col("rec_id").cast("string").alias("job_id"))
    return catalog.run_detail(_runs(spark, d), b, "33").select("run_id", "status", "backup_expired")


@query("provinces", "SELECT DISTINCT province_id, province_name FROM cities WHERE status = 'success' AND polygon_geojson IS NOT NULL")
def provinces(spark, d):
    return catalog.provinces(t(spark, d, "cities"))


@query("cities_list", "SELECT id, city, population FROM cities WHERE status = 'success' AND polygon_geojson IS NOT NULL AND province_id = 'ES' AND population >= 10000")
def cities_list(spark, d):
    return catalog.list_cities(t(spark, d, "cities"), "ES", 10_000).select("id", "city", "population")


@query("cities_by_id", "SELECT id, city FROM cities WHERE id IN (290, 420, 570, 1101, 7) AND polygon_geojson IS NOT NULL")
def cities_by_id(spark, d):
    return catalog.cities_by_id(t(spark, d, "cities"), [290, 420, 570, 1101, 7]).select("id", "city")


@query("live_jobs", "SELECT domain FROM leads_cache WHERE scraped_at >= 1760000000 - 3600")
def live_jobs(spark, d):
    return catalog.live_jobs(t(spark, d, "leads_cache").withColumnRenamed("scraped_at", "created_at"), 1_760_000_000.0).select("domain")


@query("lead_search", """SELECT lead_id FROM leads WHERE contains(lower(concat_ws(' ', coalesce(company, ''), coalesce(url, ''), coalesce(category, ''), coalesce(array_to_string(emails, ' '), ''), coalesce(array_to_string(phones, ' '), ''), coalesce(address, ''))), 'bay')""")
def lead_search(spark, d):
    return catalog.lead_search(t(spark, d, "leads"), "BAY", detail_view=True).select("lead_id")


@query("sorted_by_company")
def sorted_by_company(spark, d):
    return catalog.sort_by_text(t(spark, d, "leads").select("lead_id", "company"), "company", True, "lead_id")


@query("import_stats", "SELECT count(*) AS records, count(*) FILTER (WHERE coalesce(url, '') <> '') AS with_url FROM leads")
def import_stats(spark, d):
    return readers.import_stats(t(spark, d, "leads").select("url", F.lit(None).cast("string").alias("website")))


# --- search plans, geometry -------------------------------------------------------------------------------------------


@query("query_variations", f"""WITH k(keyword) AS (VALUES ('HVAC '), ('plumber'), ('hay delivery')), tt(no, trade, term_no, term) AS (VALUES {", ".join(f"({i}, '{k}', {j}, '{w}')" for i, (k, ws) in enumerate(fixed.TRADE_TERMS.items()) for j, w in enumerate(ws))}),
sx(s) AS (VALUES {", ".join(f"('{s}')" for s in fixed.SUFFIXES)}), kw AS (SELECT keyword, lower(trim(keyword)) AS kw FROM k), m AS (SELECT keyword, min(no) AS no FROM kw, tt WHERE contains(kw, trade) OR contains(trade, kw) GROUP BY keyword),
b AS (SELECT keyword, kw AS term FROM kw UNION ALL SELECT kw.keyword, term FROM kw JOIN m ON kw.keyword = m.keyword JOIN tt ON tt.no = m.no WHERE term <> kw)
SELECT DISTINCT keyword, CASE WHEN s = '' THEN term ELSE term || ' ' || s END AS query FROM b, sx WHERE s = '' OR NOT contains(term, s)""")
def query_variations(spark, d):
    kw = spark.createDataFrame([("HVAC ",), ("plumber",), ("hay delivery",)], "keyword string")
    return expand.variations(kw, expand.trade_terms(spark)).select("keyword", "query")


@query("expand_areas", "SELECT CASE WHEN id % 2 = 0 THEN city || ' north' ELSE city END AS area FROM cities UNION SELECT city || ' south' FROM cities WHERE id % 2 = 0")
def expand_areas(spark, d):
    c_ = t(spark, d, "cities").select(F.concat("city", F.lit("|"), "id").alias("city"), F.col("id").alias("ord"), F.col("city").alias("name"))
    near = c_.where("ord % 2 = 0").select("city", F.array(F.concat("name", F.lit(" north")), F.concat("name", F.lit(" south"))).alias("areas"))
    out = expand.areas(c_.select("city", "ord"), near)
    return out.select(F.regexp_replace("area", r"\|\d+$", "").alias("area")).distinct()


@query("searches", "SELECT q || ' ' || city AS text FROM (VALUES ('hvac'), ('plumber')) v(q), (SELECT DISTINCT city FROM cities)")
def searches(spark, d):
    q = spark.createDataFrame([("hvac",), ("plumber",)], "query string")
    return expand.searches(q, t(spark, d, "cities").select(F.col("city").alias("area")).distinct()).select("text")


_RING = "r AS (SELECT id, city, province_name, CAST(json_extract(polygon_geojson, '$.coordinates[0]') AS DOUBLE[][]) AS ring FROM cities WHERE polygon_geojson IS NOT NULL AND json_extract_string(polygon_geojson, '$.type') = 'Polygon')"


@query("polygon_filter", f"""WITH {_RING}, p AS (SELECT lead_id, longitude AS x, latitude AS y, ring FROM leads JOIN r ON source_city = r.city || ', ' || province_name),
e AS (SELECT lead_id, x, y, unnest(range(1, len(ring) + 1)) AS i, ring FROM p WHERE x IS NOT NULL AND y IS NOT NULL),
g AS (SELECT lead_id, x, y, ring[i] AS a, ring[CASE WHEN i = 1 THEN len(ring) ELSE i - 1 END] AS b FROM e),
k AS (SELECT lead_id, count(*) FILTER (WHERE (a[2] > y) <> (b[2] > y) AND x < (b[1] - a[1]) * (y - a[2]) / nullif(b[2] - a[2], 0) + a[1]) % 2 AS odd FROM g GROUP BY lead_id)
SELECT lead_id FROM k WHERE odd = 1 UNION ALL SELECT lead_id FROM p WHERE x IS NULL OR y IS NULL""")
def polygon_filter(spark, d):
    cities = t(spark, d, "cities").where("polygon_geojson is not null and get_json_object(polygon_geojson, '$.type') = 'Polygon'").select(F.concat_ws(", ", "city", "province_name").alias("source_city"), geo.rings(F.col("polygon_geojson")).alias("rings"))
    j = t(spark, d, "leads").select("lead_id", "latitude", "longitude", "source_city").join(cities, "source_city")
    return geo.in_polygon(j, "longitude", "latitude", "rings").select("lead_id")


@query("grid_points")
def grid_points(spark, d):
    cities = t(spark, d, "cities").where("polygon_geojson is not null").select("id", geo.rings(F.col("polygon_geojson")).alias("rings"))
    return geo.grid(cities, "rings", 2.0)


# --- forms, templates -------------------------------------------------------------------------------------------------


@query("best_form", "SELECT lead_id, CAST(1 AS INTEGER) AS index, 'company,email,message,name,phone' AS kinds FROM leads")
def best_form(spark, d):
    html = F.concat(F.lit('<form action="/s"><input name="q"></form><form action="/c" method="POST"><label for="n">Your name</label><input id="n"><input type="email" name="e"><input name="firm" placeholder="Business name"><input type="tel"><textarea></textarea><input type="hidden" name="subject"></form><!--'), "lead_id", F.lit("-->"))
    pages = t(spark, d, "leads").select("lead_id", forms.detect_forms(html).alias("forms"))
    return forms.best_forms(pages, "lead_id", "forms").select("lead_id", "index", F.array_join(F.array_sort("kinds"), ",").alias("kinds"))


@query("render_template", "SELECT lead_id, 'Dear ' || coalesce(company, 'your company') || ' of ' || coalesce(city, address, '') || ', me@x.example' AS message FROM leads")
def render_template(spark, d):
    msg = forms.render(F.lit("Dear {company_name} of {city}, {sender_email}"), F.col("company"), F.col("city"), F.col("address"), F.lit("me@x.example"), F.lit(""), F.lit(""))
    return t(spark, d, "leads").select("lead_id", msg.alias("message"))


@query("contact_page", """SELECT r || '/' AS url, CASE lead_id % 9 WHEN 0 THEN r || '/contact' WHEN 1 THEN r || '/contact-us' WHEN 2 THEN r || '/get-in-touch' WHEN 3 THEN r || '/get-a-quote' WHEN 4 THEN r || '/reach-out'
  WHEN 5 THEN r || '/send-message' WHEN 6 THEN r || '/' END AS contact_url FROM (SELECT lead_id, 'https://q' || lead_id || '.example' AS r FROM leads)""")
def contact_page(spark, d):
    """Forms at each contact path (and at /about, which is none), behind a telling link, on the home page, nowhere."""
    k, root = F.col("lead_id") % 9, F.concat(F.lit("https://q"), "lead_id", F.lit(".example"))
    home = F.when(k == 5, F.lit('<a href="/prices">p</a> <a href="/send-message">m</a>')).when(k == 6, F.lit("<FORM>")).otherwise(F.lit('<a href="/prices">p</a>'))
    sites = t(spark, d, "leads").select("lead_id", F.concat(root, F.lit("/")).alias("url"), home.alias("html"))
    path = F.element_at(F.array(*map(F.lit, ("/contact", "/contact-us", "/get-in-touch", "/get-a-quote", "/reach-out", "/prices", "/prices", "/about", "/contact"))), (k + 1).cast("int"))
    html = F.when(k == 8, F.lit("no form")).otherwise(F.lit("<p><Form>"))
    more = t(spark, d, "leads").select(F.concat(root, path).alias("url"), html.alias("html"))
    return pipeline.contact_page(sites.select("url"), sites.select("url", "html").unionByName(more))


@query("directory_enrich", """SELECT profile_id, CASE WHEN profile_id % 2 = 0 THEN 'info' ELSE 'page' END || profile_id || '@shop.example' AS email,
  CASE WHEN profile_id % 2 = 0 THEN '(416) 555-0100;(416) 555-0199' ELSE '(416) 555-0100;(416) 555-0198' END AS phones, 'https://facebook.com/p' || profile_id AS facebook FROM directory_profiles""")
def directory_enrich(spark, d):
    """Contacts come from the text, only without one from the page; links from the page only."""
    i = F.col("profile_id").cast("string")
    rows = t(spark, d, "directory_profiles").select(
        "profile_id", F.array().cast("array<string>").alias("emails"), F.array(F.lit("(416) 555-0100")).alias("phones"), F.create_map().cast("map<string,string>").alias("socials"), "description",
        F.when(F.col("profile_id") % 2 == 0, F.concat(F.lit("Write to info"), i, F.lit("@shop.example or 416-555-0199, see https://twitter.com/no"))).otherwise("").alias("md"),
        F.concat(F.lit('<a href="https://facebook.com/p'), i, F.lit('">f</a> page'), i, F.lit("@shop.example 416-555-0198")).alias("html"),
    )
    out = merge.directory_facts(rows, "html", "md").where(~F.array_contains(F.map_keys("socials"), "twitter"))
    return out.select("profile_id", F.array_join("emails", ";").alias("email"), F.array_join("phones", ";").alias("phones"), F.col("socials")["facebook"].alias("facebook"))


@query("form_fields", """SELECT lead_id, CASE WHEN lead_id % 3 = 0 THEN 'Your email' WHEN lead_id % 3 = 1 THEN 'E-mail ' || lead_id ELSE '' END AS label, CASE WHEN lead_id % 3 = 2 THEN '#m' || lead_id ELSE 'form:nth-of-type(1) [name="f"]' END AS selector,
  lead_id % 2 = 0 AS captcha, 1 AS forms FROM leads""")
def form_fields(spark, d):
    """Labels around a field and for its id, selectors, captchas anywhere in the page; forms without fields are left out."""
    k, i = F.col("lead_id") % 3, F.col("lead_id").cast("string")
    field = F.when(k == 0, F.lit('<label>Your\n <b>email</b> <input name="f"></label>')).when(k == 1, F.concat(F.lit('<input name="f"><label>x</label>'))).otherwise(F.concat(F.lit('<input id="m'), i, F.lit('">')))
    field = F.when(k == 1, F.concat(F.lit("<label>E-mail "), i, F.lit(' <input name="f"></label>'))).otherwise(field)
    html = F.concat(F.lit("<form>"), field, F.lit("</form><form></form>"), F.when(F.col("lead_id") % 2 == 0, F.lit('<div class="a cf-turnstile"></div>')).otherwise(F.lit('<div class="captcha-free"></div>')))
    found = t(spark, d, "leads").select("lead_id", forms.detect_forms(html).alias("forms"))
    one = F.col("forms")[0]["fields"][0]
    return found.select("lead_id", one["label"].alias("label"), one["selector"].alias("selector"), F.col("forms")[0]["captcha"].alias("captcha"), F.size("forms").alias("forms"))


@query("discover_limited", """WITH s AS (SELECT id, least(10, id % 17) AS n FROM cities), c AS (SELECT id, n, coalesce(sum(n) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
g AS (SELECT id, least(n, greatest(0, 200 - before)) AS take FROM c) SELECT 'https://h' || id || 'x' || i || '.example/' AS url FROM (SELECT id, unnest(range(0, CAST(take AS BIGINT))) AS i FROM g)""")
def discover_limited(spark, d):
    """200 results from searches of which each may give ten, by two engines in turn."""
    c_ = t(spark, d, "cities").withColumn("n", F.col("id") % 17)
    plan = c_.select(F.col("id").alias("ord"), F.concat(F.lit("hvac "), "id").alias("text"), F.col("id").alias("area"))
    url = lambda i: F.concat(F.lit('<a class="result-header" href="https://h'), F.col("id").cast("string"), F.lit("x"), i.cast("string"), F.lit('.example/">'))
    page = lambda engine, own: c_.select(F.concat(F.lit("hvac "), "id").alias("text"), F.lit(engine).alias("engine"), F.lit("header").alias("kind"), F.array_join(F.transform(own, url), "").alias("html"), F.lit("").alias("md"))
    every = F.filter(F.sequence(F.lit(0), F.lit(16)), lambda i: i < F.col("n"))
    return pipeline.discover(plan, page(0, F.filter(every, lambda i: i < 4)).unionByName(page(1, every)), pipeline.Options(most=200)).select("url")


# --- pipelines --------------------------------------------------------------------------------------------------------


@query("extract_leads", r"""WITH e AS (SELECT lead_id, len(list_distinct(list_filter(list_transform(coalesce(emails, []), lambda e: lower(regexp_extract(e, '^([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})', 1))), lambda e: e <> '' AND split_part(e, '@', 1) NOT IN ('noreply', 'no-reply', 'mailer-daemon', 'postmaster', 'webmaster', 'hostmaster', 'abuse')))) AS n, company FROM leads WHERE error IS NULL AND company IS NOT NULL)
SELECT 'https://s' || lead_id || '.example/' AS url, n FROM e""")
def extract_leads(spark, d):
    return pipeline.extract_leads(site_pages(spark, d).select("url", "html")).select("url", F.size("emails").cast("long").alias("n"))


@query("sub_page_emails", "SELECT 'https://s' || lead_id || '.example/' AS url, 'owner.' || lead_id || '@shop.ca' AS email FROM leads WHERE error IS NULL AND company IS NOT NULL AND lead_id % 2 = 0")
def sub_page_emails(spark, d):
    home = t(spark, d, "leads").where("error is null and company is not null").select(F.concat(F.lit("https://s"), "lead_id", F.lit(".example/")).alias("url"), F.lit("<title>Home of a shop</title>").alias("html"), F.lit(True).alias("main"), "lead_id")
    about = home.select(F.concat("url", F.lit("about")).alias("url"), F.when(F.col("lead_id") % 2 == 0, F.concat(F.lit("<p>owner."), "lead_id", F.lit("@Shop.ca</p>"))).otherwise("<p>About the shop</p>").alias("html"), F.lit(False).alias("main"))
    return pipeline.extract_leads(home.drop("lead_id").unionByName(about)).select("url", F.explode("emails").alias("email"))


@query("deep_crawl_phones", "SELECT 'https://s' || lead_id || '.example/' AS url, '(416) 555-' || lpad(CAST(lead_id % 10000 AS VARCHAR), 4, '0') AS phone FROM leads WHERE error IS NULL AND lead_id % 3 = 0")
def deep_crawl_phones(spark, d):
    home = t(spark, d, "leads").where("error is null").select(F.concat(F.lit("https://s"), "lead_id", F.lit(".example/")).alias("url"), F.lit('<a href="/team/us.html">').alias("html"), F.lit(True).alias("main"), "lead_id")
    team = home.select(F.concat("url", F.lit("team/us.html")).alias("url"), F.when(F.col("lead_id") % 3 == 0, F.concat(F.lit("<p>416 555 "), F.lpad((F.col("lead_id") % 10000).cast("string"), 4, "0"), F.lit("</p>"))).otherwise("<p>Our team</p>").alias("html"), F.lit(False).alias("main"))
    return pipeline.extract_leads(home.drop("lead_id").unionByName(team), depth=1).select("url", F.explode("phones").alias("phone"))


@query("review_lookup", "SELECT 'https://s' || lead_id || '.example/' AS url, CAST(lead_id % 900 AS INTEGER) AS google_reviews, 4.5 AS google_rating FROM leads WHERE error IS NULL AND company IS NOT NULL")
def review_lookup(spark, d):
    pages = site_pages(spark, d)
    found = pages.select("url", F.concat(F.lit("Shop 4.5 stars ("), (F.col("lead_id") % 900).cast("string"), F.lit(")")).alias("text"))
    return pipeline.extract_leads(pages.select("url", "html"), found).select("url", "google_reviews", "google_rating")


@query("discover_urls", """WITH f AS (SELECT url, id, e, row_number() OVER (PARTITION BY ltrim(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), 'w.') ORDER BY id, e) AS n FROM (SELECT 'https://c' || (id % 50) || '.example/' || id AS url, id, 0 AS e FROM cities UNION ALL SELECT 'https://d' || id || '.example/', id, 1 FROM cities))
SELECT url FROM f WHERE n = 1""")
def discover_urls(spark, d):
    c_ = t(spark, d, "cities")
    plan = c_.select(F.col("id").alias("ord"), F.concat(F.lit("hvac "), "id").alias("text"))
    a = c_.select(F.concat(F.lit("hvac "), "id").alias("text"), F.lit(0).alias("engine"), F.lit("redirect").alias("kind"), F.concat(F.lit('<a href="?uddg=https%3A%2F%2Fyelp.com%2Fx"><a href="?uddg=https%3A%2F%2Fc'), (F.col("id") % 50).cast("string"), F.lit(".example%2F"), "id", F.lit('">')).alias("html"), F.lit("").alias("md"))
    b = c_.select(F.concat(F.lit("hvac "), "id").alias("text"), F.lit(1).alias("engine"), F.lit("header").alias("kind"), F.concat(F.lit('<a class="result-header" href="https://d'), "id", F.lit('.example/">')).alias("html"), F.lit("").alias("md"))
    return pipeline.discover(plan, a.unionByName(b)).select("url")


@query("cache_split", rf"""WITH {_DOMAINS}, k AS (SELECT lead_id, nullif(regexp_replace(a, '^www\.', ''), '') AS domain FROM a), c AS (SELECT domain FROM leads_cache WHERE scraped_at >= {AS_OF} - {catalog.LEAD_TTL * 10} AND json_valid(payload)) SELECT lead_id, domain IN (SELECT domain FROM c) AS hit FROM k WHERE domain IS NOT NULL""")
def cache_split(spark, d):
    asked = _urls(spark, d).withColumnRenamed("u", "url").where(urls.domain(F.col("url")).isNotNull())
    hit, miss = pipeline.fresh_or_cached(asked, t(spark, d, "leads_cache"), pipeline.Options(as_of=AS_OF, lead_ttl=catalog.LEAD_TTL * 10))
    return hit.select("lead_id", F.lit(True).alias("hit")).unionByName(miss.select("lead_id", F.lit(False).alias("hit")))


@query("area_leads", f"SELECT DISTINCT 'Shop ' || lead_id AS company FROM leads WHERE {_MAPS} AND latitude IS NOT NULL")
def area_leads(spark, d):
    m = t(spark, d, "leads").where(_MAPS).where("latitude is not null")
    href = F.concat(F.lit("/maps/place/Shop+"), "lead_id", F.lit("/@"), F.format_string("%.6f", "latitude"), F.lit(","), F.format_string("%.6f", "longitude"), F.lit(",17z"))
    cells = m.select(F.col("lead_id").alias("cell"), F.concat(F.lit('<a href="'), href, F.lit('">')).alias("html"))
    details = m.select(F.concat(F.lit(listing.MAP_SITE), href).alias("maps_url"), F.lit("x").alias("category"))
    return pipeline.area_leads(cells, details).select("company")


# --- streams ----------------------------------------------------------------------------------------------------------


@query("event_counts", "SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def event_counts(spark, d):
    return jobs.event_counts(t(spark, d, "events"))


@query("event_counts_stream", "SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def event_counts_stream(spark, d):
    schema = t(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return jobs.run_to_memory(jobs.event_counts(stream), f"event_counts_{abs(hash(d)) % 10**8}", "complete")


@query("latest_status", "SELECT user_id, max_by(event_type, (ts, event_type)) AS status FROM events GROUP BY user_id")
def latest_status(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("time"), F.col("event_type").alias("status"))
    return jobs.latest_status(e).select(F.col("job_id").alias("user_id"), "status")


@query("event_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark, d):
    return t(spark, d, "events").select("event_id", structured.at(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
