"""Keeping one row per key, in an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import runtime
from leadloom.functions import urls


def first_per_key(df: DataFrame, key: Column, *order: Column, keep_blank: bool = False) -> DataFrame:
    """The first row of each key by ``order``: an aggregate with map-side combine, so a hot key costs one row a task.

    Null keys, and with ``keep_blank`` also blank ones, are not compared and stay.
    """
    cols = df.columns
    own = df.withColumn("_k", key)
    free = F.col("_k").isNull() | ((F.col("_k") == "") if keep_blank else F.lit(False))
    row = F.struct(*cols)
    kept = own.where(~free).groupBy("_k").agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")
    return kept.unionByName(own.where(free).drop("_k"))


def last_per_key(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The last row of each key by ``order``; rows with a null key are dropped."""
    own = df.withColumn("_k", key).where(F.col("_k").isNotNull())
    return own.groupBy("_k").agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def business_urls(df: DataFrame, url: str, ord_col: str, most: int | None = None, strict: bool = False) -> DataFrame:
    """URLs off the skipped hosts, the first per loose domain, the first ``most`` in order."""
    fit = df.where(F.col(url).isNotNull() & ~urls.skipped(F.col(url), strict))
    kept = first_per_key(fit, urls.loose_domain(F.col(url)), F.col(ord_col))
    return kept.orderBy(ord_col).limit(most) if most is not None else kept


def two_key_greedy(df: DataFrame, place: str, url: str, ord_col: str) -> DataFrame:
    """Rows in order, each kept unless a kept row before it has its place (if any) or its URL.

    Exact and distributed: in every round the undecided rows that are first of both their keys among the undecided
    are kept, and the rows that share a key with a kept row fall. Each round is two aggregates and decides the first row
    at least; the number of rounds is the longest chain of rows that decide each other, small in practice.
    """
    spark = df.sparkSession
    rows = df.select(F.col(ord_col).alias("o"), F.nullif(F.col(place), F.lit("")).alias("p"), F.coalesce(url, F.lit("")).alias("u"))
    open_ = runtime.materialize(rows, "greedy")
    kept = spark.createDataFrame([], open_.select("o").schema)
    while not open_.isEmpty():
        by_u = open_.groupBy("u").agg(F.min("o").alias("fu"))
        by_p = open_.where("p is not null").groupBy("p").agg(F.min("o").alias("fp"))
        marked = open_.join(by_u, "u").join(by_p, "p", "left")
        win = runtime.materialize(marked.where("o = fu and (p is null or o = fp)").select("o", "p", "u"), "winners")
        kept = kept.unionByName(win.select("o"))
        left = open_.join(win.select("o"), "o", "left_anti").join(win.select("u"), "u", "left_anti")
        left = left.join(win.where("p is not null").select("p").distinct(), "p", "left_anti")
        open_ = runtime.materialize(left.select("o", "p", "u"), "undecided")
    return df.join(kept.withColumnRenamed("o", ord_col), ord_col, "left_semi")
