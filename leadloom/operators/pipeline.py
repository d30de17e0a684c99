"""Whole pipelines: pages to ranked leads, imports to enriched leads, map areas and directories to leads."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import runtime
from leadloom.functions import fixed, geo, listing, scoring, structured, text, urls
from leadloom.operators import catalog, dedup, expand, merge

MAX_POLYGONS = 10_000


@dataclass(frozen=True)
class Options:
    """What a run may choose."""

    depth: int = 0
    spacing_km: float = 1.0
    most: int | None = None
    strict_hosts: bool = False
    as_of: float | None = None
    lead_ttl: float = catalog.LEAD_TTL


def discover(searches: DataFrame, results: DataFrame, options: Options = Options()) -> DataFrame:
    """Lead URLs of a search plan from a corpus of result pages.

    searches: ord, text (see expand.searches). results: text, engine (rank), kind (redirect, listed, header), html, md.
    URLs come in the order of search, engine and place; skipped hosts fall, the first URL of a host stays. With
    ``options.most`` a search gives ``expand.per_query`` URLs at most (of the number of areas: the column area, else one a
    search), a further engine is asked only while it is short, and all ends at ``most``. That choice depends on
    all before it, so one task folds the ordered URLs; a search plan is one request, of a bounded size.
    """
    by_kind = {"redirect": urls.redirect_urls(F.col("html"), F.col("md")), "listed": urls.listed_urls(F.col("html")), "header": urls.header_urls(F.col("html"), F.col("md")), "map": urls.outside_urls(F.col("html"), F.col("md"))}
    found = F.lit(None).cast("array<string>")
    for kind, u in by_kind.items():
        found = F.when(F.col("kind") == kind, u).otherwise(found)
    each = searches.join(results, "text").select("ord", "engine", F.posexplode(found).alias("pos", "url"))
    order = F.struct("ord", "engine", "pos")
    fit = each.where(~urls.skipped(F.col("url"), options.strict_hosts))
    if options.most is not None:
        areas = searches.select("area").distinct().count() if "area" in searches.columns else searches.count()
        fold = _fold_searches(options.most, expand.per_query(options.most, areas))
        hosts = fit.withColumn("host", urls.loose_domain(F.col("url"))).select("url", "host", F.col("ord").cast("long").alias("ord"), F.col("engine").cast("long").alias("engine"), "pos")
        return hosts.coalesce(1).sortWithinPartitions("ord", "engine", "pos").mapInPandas(fold, "url string, ord long, engine long, pos int")
    return fit.groupBy(urls.loose_domain(F.col("url")).alias("host")).agg(F.min_by("url", order).alias("url"), F.min(order).alias("o")).orderBy("o").select("url", "o.ord", "o.engine", "o.pos")


def _fold_searches(most: int, each: int):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()  # at most ``most`` hosts
        search, room = None, 0
        for pdf in batches:
            keep = []
            for host, ord_ in zip(pdf["host"], pdf["ord"]):
                if ord_ != search:
                    search, room = ord_, min(each, most - len(seen))
                keep.append(room > 0 and host not in seen)
                if keep[-1]:
                    seen.add(host)
                    room -= 1
            yield pdf[keep][["url", "ord", "engine", "pos"]]

    return fold


def fresh_or_cached(asked: DataFrame, cache: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(URLs with a fresh readable cache entry and its payload, URLs to read anew)."""
    if options.as_of is None:
        raise ValueError("as_of is needed: results must not depend on the clock")
    both = catalog.cached(asked, cache, options.as_of, options.lead_ttl)
    return both.where("payload is not null"), both.where("payload is null").select(*asked.columns)


def extract_leads(pages: DataFrame, reviews: DataFrame | None = None, depth: int = 0) -> DataFrame:
    """Leads of the pages (url, html, text or null, main: whether the URL was asked for).

    Sub-pages are joined from the same corpus only for leads without an email; with ``depth`` also up to five internal
    links are followed. Text is made once and kept, as several facts come from it. reviews: url, text of a review search.
    """
    have = "text" in pages.columns
    p = pages.withColumn("text", F.coalesce("text", text.page_text("html")) if have else text.page_text("html"))
    p = runtime.materialize(p.select("url", "html", "text", *(["main"] if "main" in p.columns else [])), "pages")
    main = p.where("main") if "main" in p.columns else p
    facts = main.select("url", "html", "text", text.emails(F.concat_ws(" ", "text", F.array_join(text.mailto_emails(F.col("html")), " "))).alias("emails"))
    corpus = p.select(F.lower(F.col("url")).alias("at"), F.col("text").alias("more")).where(F.length(F.trim("more")) > 0)
    root = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    targets = facts.where(F.size("emails") == 0).select("url", F.posexplode(F.transform(F.array(*map(F.lit, fixed.SUB_PAGES)), lambda s: F.concat(root, s))).alias("i", "to"))
    if depth:
        linked = facts.select("url", F.posexplode(urls.internal_links(F.col("html"), F.col("url"), 5)).alias("i", "to"))
        targets = targets.unionByName(linked.withColumn("i", F.col("i") + 100))
    extra = targets.join(corpus, F.lower("to") == F.col("at")).groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "more"))), lambda x: x["more"]), "\n").alias("more"))
    facts = facts.join(extra, "url", "left")
    full = F.concat_ws("\n", "text", "more")
    ld = structured.json_ld(F.col("html"))
    own = facts.withColumns({"ld": ld, "full": full})
    leads = own.select(
        "url",
        text.company_name(F.col("html"), F.col("text"), F.col("url"), F.col("ld.name")).alias("company"),
        text.description(F.col("text")).alias("description"),
        F.when(F.size("emails") > 0, F.col("emails")).otherwise(text.emails(F.col("full"))).alias("emails"),
        text.phones(F.col("full")).alias("phones"),
        text.social_links(F.col("full")).alias("socials"),
        F.coalesce("ld.address", text.street_address(F.col("full"))).alias("address"),
        F.coalesce("ld.hours", text.business_hours(F.col("full"))).alias("hours"),
    )
    if reviews is not None:
        r = reviews.select("url", listing.reviews(F.col("text")).alias("r"))
        leads = leads.join(r, "url", "left").select("*", "r.google_reviews", "r.google_rating").drop("r")
    else:
        leads = leads.withColumns({"google_reviews": F.lit(None).cast("int"), "google_rating": F.lit(None).cast("double")})
    return scoring.annotate(leads.withColumn("error", F.lit(None).cast("string")))


def import_leads(records: DataFrame, scraped: DataFrame, order: str) -> DataFrame:
    """Imported records with what their sites show, scored."""
    leads = merge.enrich_records(merge.import_record(records), scraped, order)
    return scoring.annotate(leads.withColumn("error", F.lit(None).cast("string")))


def area_leads(cells: DataFrame, details: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """Leads of the result pages of grid cells (cell, html): greedy two-key dedup in (cell, place) order, details, polygon, lead schema, score.

    rings: the polygons of the area, column rings; a row stays if it lies in any, or has no coordinates.
    """
    found = cells.select("cell", F.posexplode(listing.listings(F.col("html"))).alias("i", "l")).select((F.col("cell").cast("long") * 1_000_000 + F.col("i")).alias("ord"), "l.*")
    found = found.withColumn("key", listing.listing_key(F.col("maps_url")))
    kept = dedup.two_key_greedy(found, "place_id", "key", "ord").drop("key", "ord")
    full = merge.listing_with_detail(kept, details)
    if rings is not None:
        if (n := rings.limit(MAX_POLYGONS + 1).count()) > MAX_POLYGONS:
            raise ValueError(f"an area has at most {MAX_POLYGONS} polygons ({n})")
        every = rings.agg(F.flatten(F.collect_list("rings")).alias("rings"))
        full = geo.in_polygon(full.crossJoin(F.broadcast(every)), "longitude", "latitude", "rings").drop("rings")
    return scoring.annotate(merge.listing_lead(full).withColumn("error", F.lit(None).cast("string")))


def directory_leads(profiles: DataFrame, order: str) -> DataFrame:
    """Leads of directory profile pages (url, html, text, source_city, ``order``): the first per profile, scored."""
    rows = profiles.select(order, "source_city", listing.directory_page(F.col("html"), F.col("text"), F.col("url")).alias("x")).select(order, "source_city", "x.*").where("company is not null")
    kept = dedup.first_per_key(rows, F.col("homestars_url"), F.col(order), keep_blank=True)
    none = {"socials": F.create_map().cast("map<string,string>"), "google_reviews": F.lit(None).cast("int"), "google_rating": F.lit(None).cast("double"), "error": F.lit(None).cast("string")}
    return scoring.annotate(kept.withColumns(none))


def new_per_city(leads: DataFrame) -> DataFrame:
    """How many deduplicated leads each source city gave."""
    return leads.groupBy("source_city").agg(F.count("*").alias("leads"))


def contact_page(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """url -> url, contact_url: the page itself if its path says so, the first contact path that has a form, the page if it has a form, the first telling one of five internal links."""
    has = lambda words: "|".join(words)
    corpus = pages.select(F.lower("url").alias("at"), F.contains(F.lower("html"), F.lit("<form")).alias("form"), "html")
    root = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    tries = sites.select("url", F.posexplode(F.transform(F.array(*map(F.lit, fixed.CONTACT_PATHS)), lambda s: F.concat(root, s))).alias("i", "to"))
    by_path = tries.join(corpus.where("form"), F.lower("to") == F.col("at")).groupBy("url").agg(F.min_by("to", "i").alias("by_path"))
    home = sites.join(corpus, F.lower("url") == F.col("at"), "left").select("url", F.when(F.col("form"), F.col("url")).alias("by_form"), F.try_element_at(F.filter(urls.internal_links(F.col("html"), F.col("url"), 5), lambda u: F.lower(urls.path(u)).rlike(has(fixed.CONTACT_LINK_WORDS))), F.lit(1)).alias("by_link"))
    own = F.when(F.lower(urls.path(F.col("url"))).rlike(has(fixed.CONTACT_PAGE_WORDS)), F.col("url"))
    return home.join(by_path, "url", "left").select("url", F.coalesce(own, "by_path", "by_form", "by_link").alias("contact_url"))
