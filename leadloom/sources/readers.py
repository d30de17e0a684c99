"""Readers of URL lists, listing exports, backups, page corpora and the service tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions import urls
from leadloom.functions.structured import at

EXPORT = "type STRING, title STRING, name STRING, address STRING, neighborhood STRING, street STRING, postalCode STRING, city STRING, website STRING, url STRING, phone STRING, phoneUnformatted STRING, totalScore STRING, reviewsCount STRING, categoryName STRING, openingHours STRING, description STRING"
LEAD = (
    "url STRING, company STRING, description STRING, emails ARRAY<STRING>, phones ARRAY<STRING>, socials MAP<STRING,STRING>, address STRING, city STRING, state STRING, zip_code STRING, hours STRING, category STRING, rating DOUBLE, neighborhood STRING, google_reviews INT, google_rating DOUBLE, review_distribution MAP<STRING,INT>, "
    "homestars_rating DOUBLE, homestars_reviews INT, homestars_url STRING, homestars_verified BOOLEAN, homestars_years INT, price_level STRING, maps_url STRING, latitude DOUBLE, longitude DOUBLE, place_id STRING, plus_code STRING, thumbnail_url STRING, is_temporarily_closed BOOLEAN, is_permanently_closed BOOLEAN, source_city STRING, score INT, tier STRING, error STRING"
)
BACKUP = f"job_id STRING, user_id STRING, created_at DOUBLE, finished_at DOUBLE, duration DOUBLE, status STRING, lead_count INT, leads ARRAY<STRUCT<{', '.join(x.strip().replace(' ', ': ', 1) for x in LEAD.split(', '))}>>, _corrupt_record STRING"


def conform(df: DataFrame) -> DataFrame:
    """df with exactly the lead columns; those it lacks are null."""
    schema = T.StructType.fromDDL(LEAD)
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def url_list(spark: SparkSession, target: str) -> DataFrame:
    """URLs of a .txt file, one a line: trimmed, without blank lines and lines that begin with #; any other target is one URL."""
    if not target.endswith(".txt"):
        return spark.range(1).select(urls.normalize_url(F.lit(target)).alias("url"))
    return spark.read.text(target).where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.trim("value").alias("url"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records of export files: {"records": [...]}, a bare array, or one record with website or url. Other files give none. One file is one JSON text."""
    v = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    one = at(F.col("v"), "$", "variant")
    single = F.when(F.coalesce(at(F.col("v"), "$.website"), at(F.col("v"), "$.url")).isNotNull(), F.array(one))
    rows = v.select(F.posexplode(F.coalesce(at(F.col("v"), "$.records", "array<variant>"), at(F.col("v"), "$", "array<variant>"), single)).alias("ord", "r"))
    return rows.select("ord", *[at(F.col("r"), f"$.{f.name}", "string").alias(f.name) for f in T.StructType.fromDDL(EXPORT)])


def import_stats(df: DataFrame) -> DataFrame:
    """Number of records and of those with a website or URL."""
    has = (F.coalesce("website", F.lit("")) != "") | (F.coalesce("url", F.lit("")) != "")
    return df.agg(F.count("*").alias("records"), F.count_if(has).alias("with_url"))


def backups(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Backup envelopes with their file names, newest name first; unreadable files are left out."""
    df = spark.read.schema(BACKUP).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", pattern).json(folder)
    return df.withColumn("filename", F.element_at(F.split(F.input_file_name(), "/"), -1)).where("_corrupt_record is null and job_id is not null").drop("_corrupt_record").orderBy(F.desc("filename"))


def backup_leads(envelopes: DataFrame, run_id: str) -> DataFrame:
    """The leads of a run's backup, in order."""
    return envelopes.where(F.col("job_id") == run_id).select(F.posexplode("leads").alias("ord", "l")).select("ord", "l.*")


def safe_name(name: str) -> bool:
    """Whether a backup name is a plain .json file name."""
    return name.endswith(".json") and "/" not in name and "\\" not in name and ".." not in name


def pages(spark: SparkSession, path: str) -> DataFrame:
    """A page corpus at rest (url, html[, text]); spread over tasks if it has fewer splits than the cluster has cores."""
    df = spark.read.parquet(path)
    return df if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else df.repartition(spark.sparkContext.defaultParallelism)


def union(*sources: DataFrame) -> DataFrame:
    """Leads of several sources in one schema."""
    out = conform(sources[0])
    for s in sources[1:]:
        out = out.unionByName(conform(s))
    return out


def engines(*found: DataFrame, most: int | None = None) -> DataFrame:
    """URLs (url, pos) of several engines in order of engine and place; see dedup.business_urls."""
    from leadloom.operators.dedup import business_urls

    all_ = None
    for rank, df in enumerate(found):
        one = df.select("url", (F.lit(rank).cast("long") * 1_000_000_000 + F.col("pos")).alias("ord"))
        all_ = one if all_ is None else all_.unionByName(one)
    return business_urls(all_, "url", "ord", most)
