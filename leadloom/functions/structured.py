"""Facts from embedded JSON, read as VARIANT in the JVM; broken JSON gives nulls, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import fixed
from leadloom.functions.text import blank_to_null, let
from leadloom.functions.urls import normalize_url


def at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column, path: str) -> Column:
    """Type name of the value at a path; null if there is none."""
    return F.schema_of_variant(at(v, path, "variant"))


def text_at(v: Column, path: str) -> Column:
    """The value at a path if it is a non-empty string, trimmed."""
    return F.when(_kind(v, path) == "STRING", blank_to_null(F.trim(at(v, path))))


def first_text(v: Column, *names: str) -> Column:
    return F.coalesce(*[text_at(v, f"$.{n}") for n in names])


def unescape(c: Column) -> Column:
    """The HTML entities that occur in embedded JSON."""
    for entity, char in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def parse_loose(c: Column) -> Column:
    """JSON, else JSON after resolving entities."""
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(unescape(c)))


def json_ld_items(html: Column) -> Column:
    """All business objects of all JSON-LD blocks, in order, as an array of VARIANT."""
    blocks = F.coalesce(F.regexp_extract_all(html, F.lit(fixed.JSON_LD), F.lit(1)), F.array().cast("array<string>"))

    def members(v: Column) -> Column:
        graph = at(v, "$['@graph']", "variant")
        return F.coalesce(at(v, "$", "array<variant>"), at(graph, "$", "array<variant>"), F.when(graph.isNotNull(), F.array(graph)), F.when(v.isNotNull(), F.array(v)), F.array().cast("array<variant>"))

    def business(v: Column) -> Column:
        kind = F.coalesce(at(v, "$['@type'][0]"), F.when(_kind(v, "$['@type']") == "STRING", at(v, "$['@type']")))
        return F.coalesce(F.lower(kind).isin(fixed.BUSINESS_TYPES), F.lit(False))

    return F.filter(F.flatten(F.transform(F.transform(blocks, lambda b: F.try_parse_json(b)), members)), business)


def json_ld(html: Column) -> Column:
    """Struct of name, phone, email, hours, address, same_as: for each the first item that has it."""
    return let(json_ld_items(html), _json_ld)


def _json_ld(items: Column) -> Column:
    def pick(f) -> Column:
        return F.try_element_at(F.filter(F.transform(items, lambda v: blank_to_null(f(v))), lambda x: x.isNotNull()), F.lit(1))

    def hours(v: Column) -> Column:
        listed = F.array_join(at(v, "$.openingHours", "array<string>"), ", ")
        specs = F.coalesce(at(v, "$.openingHoursSpecification", "array<variant>"), F.array().cast("array<variant>"))

        def one(s: Column) -> Column:
            days = F.coalesce(F.array_join(F.transform(at(s, "$.dayOfWeek", "array<string>"), lambda d: F.substring_index(d, "/", -1)), ", "), at(s, "$.dayOfWeek"))
            opens = at(s, "$.opens")
            return F.when(blank_to_null(days).isNotNull() & blank_to_null(opens).isNotNull(), F.concat(days, F.lit(": "), opens, F.lit("-"), F.coalesce(at(s, "$.closes"), F.lit(""))))

        spec = F.array_join(F.filter(F.transform(specs, one), lambda x: x.isNotNull()), "; ")
        return F.coalesce(blank_to_null(listed), F.when(_kind(v, "$.openingHours") == "STRING", blank_to_null(at(v, "$.openingHours"))), spec)

    def place(v: Column) -> Column:
        parts = [at(v, f"$.address.{k}") for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode")]
        return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), ", ")

    same = F.try_element_at(F.filter(F.transform(items, lambda v: F.coalesce(at(v, "$.sameAs", "array<string>"), F.when(_kind(v, "$.sameAs") == "STRING", F.array(at(v, "$.sameAs"))))), lambda x: x.isNotNull() & (F.size(x) > 0)), F.lit(1))
    text = lambda k: pick(lambda v: F.trim(at(v, f"$.{k}")))
    return F.struct(text("name").alias("name"), text("telephone").alias("phone"), text("email").alias("email"), pick(hours).alias("hours"), pick(place).alias("address"), same.alias("same_as"))


def marked_json(html: Column, element_id: str) -> Column:
    """VARIANT of the JSON inside the div with this id."""
    return parse_loose(blank_to_null(F.trim(F.regexp_extract(html, rf'(?s)id="{element_id}"[^>]*>(.*?)</div>', 1))))


def next_data(html: Column, element_id: str = "__hs_next_data__") -> Column:
    """VARIANT of a page's state: from the injected div, else from its script."""
    div = F.try_parse_json(blank_to_null(F.regexp_extract(html, rf'(?s)<div\s+id="{element_id}"[^>]*>(.*?)</div>', 1)))
    script = F.try_parse_json(blank_to_null(F.regexp_extract(html, r'(?s)<script\s+id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)))
    return F.coalesce(div, script)


def profile_node(state: Column) -> Column:
    """The object of a page state that describes the company."""
    return let(state, _profile_node)


def _profile_node(state: Column) -> Column:
    base = "$.props.pageProps"
    inner = [F.when(_kind(state, f"{base}.{k}").startswith("OBJECT"), at(state, f"{base}.{k}", "variant")) for k in ("company", "professional", "profile", "companyData", "pro")]
    named = F.coalesce(*[_kind(state, f"{base}.{k}") for k in ("name", "companyName", "title")]).isNotNull()
    return F.coalesce(*inner, F.when(named, at(state, base, "variant")))


def directory_company(v: Column, page_url: Column) -> Column:
    """A directory's company object as a lead struct; null without a name."""
    return let(v, lambda x: _company(x, page_url))


def _company(v: Column, page_url: Column) -> Column:
    number = lambda kind, *names: F.coalesce(*[at(v, f"$.{n}", kind) for n in names])
    name = first_text(v, "name", "companyName", "company_name", "title", "displayName", "businessName")
    site = first_text(v, "website", "websiteUrl", "website_url", "websiteLink")
    site = F.when(site.startswith("http"), site).otherwise(F.concat(F.lit("https://"), site))
    phone = first_text(v, "phone", "phoneNumber", "phone_number", "contactPhone")
    street = first_text(v, "address", "streetAddress", "street_address", "street")
    city = first_text(v, "city", "cityName", "city_name")
    province = first_text(v, "province", "provinceName", "state")
    listed = F.coalesce(*[F.coalesce(text_at(v, f"$.{k}[0].name"), text_at(v, f"$.{k}[0].title"), text_at(v, f"$.{k}[0]")) for k in ("categories", "services", "trades")])
    category = F.coalesce(listed, first_text(v, "category", "primaryCategory", "trade", "profession"), F.lit(""))

    def yes(path: str) -> Column:
        kind = _kind(v, path)
        flag = F.when(kind.startswith("OBJECT"), F.exists(F.map_values(at(v, path, "map<string,string>")), lambda x: x.isNotNull() & ~x.isin("", "false", "0"))).when(kind == "STRING", at(v, path) != "").otherwise(at(v, path, "boolean"))
        return F.when(flag, True)

    lead = F.struct(
        name.alias("company"),
        category.alias("category"),
        F.coalesce(normalize_url(site), F.lit("")).alias("url"),
        F.array().cast("array<string>").alias("emails"),
        F.when(phone.isNotNull(), F.array(phone)).otherwise(F.array().cast("array<string>")).alias("phones"),
        F.array_join(F.array_compact(F.array(street, city, province)), ", ").alias("address"),
        F.round(number("double", "starScore", "star_score", "rating", "averageRating", "score", "overallRating"), 1).alias("homestars_rating"),
        number("int", "reviewCount", "review_count", "numReviews", "reviewsCount", "totalReviews").alias("homestars_reviews"),
        page_url.alias("homestars_url"),
        F.coalesce(*[yes(f"$.{k}") for k in ("verified", "isVerified", "is_verified")], F.lit(False)).alias("homestars_verified"),
        number("int", "yearsInBusiness", "years_in_business", "experience").alias("homestars_years"),
        F.coalesce(first_text(v, "description", "about", "bio", "companyDescription"), F.lit("")).alias("description"),
    )
    return F.when(name.isNotNull(), lead)
