"""Search plans: term variations, areas, and their product."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import fixed


def trade_terms(spark: SparkSession) -> DataFrame:
    """trade_no, trade, term_no, term: the fixed table of related terms."""
    rows = [(i, k, j, t) for i, (k, ts) in enumerate(fixed.TRADE_TERMS.items()) for j, t in enumerate(ts)]
    return spark.createDataFrame(rows, "trade_no int, trade string, term_no int, term string")


def variations(keywords: DataFrame, terms: DataFrame) -> DataFrame:
    """keyword -> keyword, no, query: the keyword and the terms of the first trade that matches it, each with every suffix it lacks; first of equals kept."""
    kw = keywords.select("keyword", F.lower(F.trim("keyword")).alias("kw")).distinct()
    # a keyword meets a table of fixed size: its trade is a substring match, which no equi-join can express
    match = kw.join(F.broadcast(terms), F.contains(F.col("kw"), F.col("trade")) | F.contains(F.col("trade"), F.col("kw")))
    listed = match.groupBy("keyword", "kw").agg(F.min("trade_no").alias("trade_no")).join(F.broadcast(terms), "trade_no").where("term <> kw").select("keyword", "kw", "term_no", "term")
    base = kw.select("keyword", F.lit(-1).alias("term_no"), F.col("kw").alias("term")).unionByName(listed.select("keyword", "term_no", "term"))
    sfx = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(fixed.SUFFIXES)])
    each = base.select("keyword", "term_no", "term", F.explode(F.filter(sfx, lambda x: (x["s"] == "") | ~F.contains(F.col("term"), x["s"]))).alias("x"))
    each = each.select("keyword", F.struct("term_no", "x.i").alias("o"), F.when(F.col("x.s") == "", F.col("term")).otherwise(F.concat_ws(" ", "term", "x.s")).alias("query"))
    return each.groupBy("keyword", "query").agg(F.min("o").alias("o")).select("keyword", F.col("o.term_no").alias("term_no"), F.col("o.i").alias("suffix_no"), "query")


def areas(cities: DataFrame, neighbourhoods: DataFrame) -> DataFrame:
    """city, ord -> area, ord, pos: the city's areas where the table (city, areas) has it, else the city; the first of equals."""
    c = cities.withColumn("k", F.lower(F.trim("city")))
    n = neighbourhoods.select(F.lower(F.trim("city")).alias("k"), "areas")
    each = c.join(n, "k", "left").select("ord", F.posexplode(F.coalesce("areas", F.array("city"))).alias("pos", "area"))
    first = each.groupBy(F.lower("area").alias("k")).agg(F.min_by(F.struct("area", "ord", "pos"), F.struct("ord", "pos")).alias("r"))
    return first.select("r.area", "r.ord", "r.pos")


def search_areas(cities: DataFrame, neighbourhoods: DataFrame, most: int) -> DataFrame:
    """The areas to search for ``most`` results: neighbourhoods for more than 50, else the cities themselves."""
    return areas(cities, neighbourhoods) if most > 50 else cities.select(F.col("city").alias("area"), "ord", F.lit(0).alias("pos"))


def per_query(n: int, areas: int) -> int:
    """Results to ask of each query."""
    return min(30, max(10, n // max(1, areas * 2)))


def import_concurrency(n: int) -> int:
    return min(12, max(4, n // 10))


def searches(queries: DataFrame, areas_: DataFrame) -> DataFrame:
    """Every query in every area, in order of query and area. Both sides are search plans of a bounded size, and the product is the result."""
    return queries.crossJoin(areas_).select("query", "area", F.concat_ws(" ", "query", "area").alias("text"))
