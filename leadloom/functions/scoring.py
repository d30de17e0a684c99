"""Score and tier of a lead as one expression, and the order of ranked leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import fixed


def _filled(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def personal(email: Column) -> Column:
    name = F.substring_index(email, "@", 1)
    return F.contains(name, F.lit(".")) | ~F.lower(name).isin(fixed.GENERIC_MAIL_NAMES)


def score(emails: str = "emails", phones: str = "phones", address: str = "address", socials: str = "socials", reviews: str = "google_reviews", rating: str = "google_rating", error: str = "error") -> Column:
    c = F.col
    points = (
        F.when(_filled(c(emails)), F.when(F.exists(emails, personal), 3).otherwise(2)).otherwise(0)
        + F.when(_filled(c(phones)), 2).otherwise(0)
        + F.when(c(address).isNotNull() & (c(address) != ""), 1).otherwise(0)
        + F.when(_filled(c(socials)), 1).otherwise(0)
        + F.when(c(reviews) <= 50, 2).when(c(reviews) <= 200, 1).when(c(reviews) > 1000, -1).otherwise(0)
        + F.when(c(rating) < 3.0, -1).otherwise(0)
    )
    return F.when(c(error).isNotNull(), -2).otherwise(points).cast("int")


def tier(score: Column, error: str = "error") -> Column:
    return F.when(F.col(error).isNotNull(), "dead").when(score >= 7, "hot").when(score >= 4, "warm").when(score >= 1, "cold").otherwise("dead")


def annotate(df: DataFrame) -> DataFrame:
    """df with score and tier."""
    return df.withColumn("score", score()).withColumn("tier", tier(F.col("score")))


def ranked(df: DataFrame, ord_col: str) -> DataFrame:
    """Best first: score, then reviews; equal leads keep the order of ``ord_col``."""
    return df.orderBy(F.coalesce("score", F.lit(0)).desc(), F.coalesce("google_reviews", F.lit(0)).desc(), F.col(ord_col).asc())
