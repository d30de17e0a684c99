"""Lookups over the service tables: cities, lead cache, run history, backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import urls
from leadloom.operators import dedup

DAY = 24 * 3600
LEAD_TTL, MX_TTL, JOB_TTL = 30 * DAY, 7 * DAY, 3600


def provinces(cities: DataFrame) -> DataFrame:
    ok = cities.where("status = 'success' and polygon_geojson is not null")
    return ok.select("province_id", "province_name").distinct().orderBy("province_name", "province_id")


def list_cities(cities: DataFrame, province: str | None = None, least: int | None = None) -> DataFrame:
    """Cities by population, largest first; without their polygons."""
    df = cities.where("status = 'success' and polygon_geojson is not null").drop("polygon_geojson")
    if province:
        df = df.where(F.col("province_id") == province)
    if least is not None:
        df = df.where(F.col("population") >= least)
    return df.orderBy(F.col("population").desc(), "id")


def cities_by_id(cities: DataFrame, ids: list[int], with_polygon: bool = True) -> DataFrame:
    df = cities.where(F.col("id").isin(ids))
    return df.where("polygon_geojson is not null") if with_polygon else df


def fresh(df: DataFrame, at: str, as_of: float | Column, ttl: float) -> DataFrame:
    """Rows not older than ``ttl`` seconds at ``as_of`` (epoch seconds)."""
    return df.where(F.col(at) >= (as_of if isinstance(as_of, Column) else F.lit(as_of)) - ttl)


def cached(urls_: DataFrame, cache: DataFrame, as_of: float, ttl: float = LEAD_TTL) -> DataFrame:
    """url -> url, payload (VARIANT, null on a miss, a stale or an unreadable entry), joined on the URL's domain."""
    ok = fresh(cache, "scraped_at", as_of, ttl).select("domain", F.try_parse_json("payload").alias("payload"))
    return urls_.withColumn("domain", urls.domain(F.col("url"))).join(ok, "domain", "left")


def upsert(cache: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """cache with the last of the new entries of each domain; entries of error leads are left out before."""
    new = new.where("error is null").withColumn("domain", urls.domain(F.col("url"))).where("domain is not null")
    last = dedup.last_per_key(new, F.col("domain"), F.col(order)).select(*cache.columns)
    return cache.join(last.select("domain"), "domain", "left_anti").select(*cache.columns).unionByName(last)


def mail_validity(emails: DataFrame, cache: DataFrame, as_of: float) -> DataFrame:
    """email -> email, valid: true, false, or null where the cache does not know."""
    ok = fresh(cache, "checked_at", as_of, MX_TTL).select(F.lower("domain").alias("domain"), F.col("valid").cast("boolean").alias("valid"))
    return emails.withColumn("domain", urls.email_domain(F.col("email"))).join(ok, "domain", "left").select("email", "valid")


def run_history(runs: DataFrame, user: str, most: int = 100) -> DataFrame:
    """A user's runs and those of nobody, newest first."""
    mine = (F.col("user_id") == user) | F.col("user_id").isNull() | (F.col("user_id") == "")
    return runs.where(mine).orderBy(F.col("created_at").desc(), F.col("run_id")).limit(most)


def run_detail(runs: DataFrame, backups: DataFrame, run_id: str) -> DataFrame:
    """One run with ``backup_expired``: whether none of its backups is left."""
    b = backups.select(F.col("job_id").alias("run_id")).distinct().withColumn("_have", F.lit(True))
    return runs.where(F.col("run_id") == run_id).join(b, "run_id", "left").withColumn("backup_expired", F.col("_have").isNull()).drop("_have")


def finish_runs(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """runs with status, lead_count, duration (one decimal), finished_at (from epoch seconds) and error of their updates; an update without error clears it."""
    new = {"status": F.col("status"), "lead_count": F.col("lead_count"), "duration_seconds": F.round("duration_seconds", 1), "error": F.nullif("error", F.lit(""))}
    if "finished_at" in updates.columns:
        new["finished_at"] = iso(F.col("finished_at"))
    both = runs.join(updates.select("run_id", F.struct(*[v.alias(c) for c, v in new.items()]).alias("_u")), "run_id", "left")
    return both.withColumns({c: F.when(F.col("_u").isNotNull(), F.col("_u")[c]).otherwise(F.col(c)) for c in new}).select(*runs.columns)


def iso(seconds: Column) -> Column:
    """Epoch seconds as UTC text."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def start_runs(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """runs and a row for each new job (id, user_id, mode, keyword, city_ids, city, grid_spacing_km, max_results, created_at in epoch seconds)."""
    cities = F.when(F.size(F.coalesce("city_ids", F.array().cast("array<int>"))) > 0, F.to_json("city_ids")).otherwise(F.coalesce("city", F.lit("")))
    new = jobs.select(
        F.col("id").alias("run_id"), "user_id", F.coalesce("mode", F.lit("")).alias("mode"), F.coalesce("keyword", F.lit("")).alias("keyword"), cities.alias("cities"), F.lit("running").alias("status"), F.lit(0).alias("lead_count"),
        iso(F.col("created_at")).alias("created_at"), "grid_spacing_km", "max_results",
    )
    return runs.unionByName(new, allowMissingColumns=True).select(*runs.columns)


def live_jobs(jobs: DataFrame, as_of: float) -> DataFrame:
    """Jobs not older than an hour."""
    return fresh(jobs, "created_at", as_of, JOB_TTL)


def counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def text_search(df: DataFrame, query: str, columns: list[Column]) -> DataFrame:
    """Rows whose joined columns hold the query in any case; all rows for an empty query."""
    if not query:
        return df
    joined = F.lower(F.array_join(F.array(*[F.coalesce(c, F.lit("")) for c in columns]), " "))
    return df.where(F.contains(joined, F.lit(query.lower())))


def lead_search(df: DataFrame, query: str, detail_view: bool = False) -> DataFrame:
    lists = [F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ") for c in ("emails", "phones")]
    cols = [F.col("company"), F.col("url"), F.col("category"), *lists, F.col("address")]
    more = [] if detail_view else [F.col(c) for c in ("hours", "price_level") if c in df.columns] + [F.array_join(F.map_keys(F.coalesce("socials", F.create_map().cast("map<string,string>"))), " ")]
    return text_search(df, query, cols + more)


def sort_by_text(df: DataFrame, column: str, ascending: bool = True, *ties: str) -> DataFrame:
    """Rows ordered by a column as lower-case text in the order of the Unicode collation; blank first. Lists count as joined text."""
    kind = dict(df.dtypes)[column]
    text = F.array_join(column, "; ") if kind.startswith("array") else F.col(column).cast("string")
    key = F.collate(F.coalesce(F.lower(text), F.lit("")), "UNICODE")
    return df.orderBy(key.asc() if ascending else key.desc(), *ties)
