"""Problem 7: the best representative of each duplicate group, field by field.

``survivors`` folds every group with one aggregate per field: the greatest (rank, time, place in the order, -id) with
the value, so there is map-side combine and no group is ever collected, whatever its size.

Missing timestamps are handled by currency reasoning over values. A ``Signal`` classes a value of a row (how many
reviews it has, its tier, which contacts it has; at most MAX_CLASSES classes). ``learn_precedence`` counts which class
follows which between successive timestamped rows of a group and keeps a -> b where that is seen clearly more often than
b -> a. The kept edges form a small graph; strongly connected classes are merged and the topological level of a class
is its place in every group's partial order. The signal whose changes run most steadily along its own order is used.
``estimate_times`` puts a row without a timestamp into its group's order: beside the latest timestamped row with the very
same contacts and address, else behind the last timestamped row that is not above it in level, and before those above;
among rows of one time the higher level is the later.
``missing="oldest"`` is the rule that TESTDATA.md fixes for p7_found: the order is learnt and every row placed as always,
and as the last step a row without a timestamp counts as oldest; the place then decides only between rows of one id.

Hot groups: the rows of a key that holds more than a thousandth of the rows (at most 1,000 such keys) are cut into
contiguous time ranges; the one transition across each bound is added, so every successive pair counts once.

Defined cases: blank keys are left out; groups of one row are left out; a field without any usable value gives
id 0 and a null value; ties go to the later time, then to the smaller id; repeated rows count as rows; an
empty table gives an empty result; columns beyond those named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom import runtime
from leadloom.llm import keys

MAX_CLASSES = 64


@dataclass(frozen=True)
class Field:
    name: str
    #: the value that survives
    value: Column
    #: how good the value is: a long, 0 for unusable
    rank: Column


def lead_fields() -> list[Field]:
    emails = keys.entries(F.col("emails"), keys.usable_email)
    phones = keys.usable_phones(F.col("phones"))
    google, stars = F.col("google_rating"), F.col("homestars_rating")
    return [
        Field("emails", emails, F.size(emails).cast("long")),
        Field("phones", phones, F.size(phones).cast("long")),
        Field("google", google, F.when((google > 0) & (google <= 5), 1).otherwise(0).cast("long")),
        Field("homestars", stars, F.when((stars > 0) & (stars <= 10), 1).otherwise(0).cast("long")),
    ]


@dataclass(frozen=True)
class Signal:
    name: str
    #: class of a row's value, an int below MAX_CLASSES; null where the row says nothing
    cls: Column


def contact_class(fields: list[Field]) -> Column:
    """The ranks of the list fields, cut at 3, and which ratings a row has."""
    c = F.lit(0)
    for f, base in zip(fields, (4, 4, 2, 2)):
        c = c * base + F.least(f.rank, F.lit(base - 1)).cast("int")
    return c.cast("int")


def lead_signals() -> list[Signal]:
    reviews = F.when(F.col("google_reviews") >= 0, F.least(F.floor(F.log2(F.col("google_reviews") + F.lit(1.0)) * 4), F.lit(MAX_CLASSES - 1)).cast("int"))
    tier = F.nullif(F.array_position(F.array(*map(F.lit, ("dead", "cold", "warm", "hot"))), F.col("tier")), F.lit(0)).cast("int")
    return [Signal("contacts", contact_class(lead_fields())), Signal("reviews", reviews), Signal("tier", tier)]


def lead_identity() -> Column:
    """Contacts and address of a row as one hash; null if it has none."""
    f = lead_fields()
    where = keys.alnum(F.col("address"))
    return F.when((f[0].rank > 0) | (f[1].rank > 0) | (where != ""), F.xxhash64(f[0].value, f[1].value, where))


def hot_steps(timed: DataFrame) -> DataFrame:
    """(before, c) of successive rows (k, id, t, c) of each of a few keys: in ranges of (k, t, id), and across the bounds of the ranges."""
    spark = timed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = runtime.materialize(timed.repartitionByRange(parts, "k", "t", "id", "c").withColumn("part", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("before", F.lag("c").over(W.partitionBy("k", "part").orderBy("t", "id", "c"))).select("before", "c")
    at = F.struct("t", "id", "c")
    ends = ranged.groupBy("k", "part").agg(F.min(at).alias("first"), F.max(at).alias("last"))  # at most parts + keys rows
    across = ends.select(F.lag("last.c").over(W.partitionBy("k").orderBy("part")).alias("before"), F.col("first.c").alias("c"))
    return inside.unionByName(across)


def learn_precedence(rows: DataFrame, share: float = 0.6, least: int = 20) -> tuple[int, dict[int, int]]:
    """(signal, topological level of each of its classes), from rows (k, id, t, c); c: the classes of a row, one a signal.

    ``share``: of the changes between two classes that go one way; ``least``: changes seen at all. (-1, {}) if no signal has an order.
    """
    n = rows.count()
    hot = rows.groupBy("k").agg(F.count("*").alias("m")).where(F.col("m") * 1000 > n).select("k", F.lit(True).alias("hot"))
    timed = rows.where("t is not null").join(F.broadcast(hot), "k", "left")
    w = W.partitionBy("k").orderBy("t", "id", "c")
    cold = timed.where("hot is null").withColumn("before", F.lag("c").over(w)).select("before", "c")
    steps = cold.unionByName(hot_steps(timed.where("hot").drop("hot"))).where("before is not null")
    each = steps.select(F.posexplode(F.arrays_zip(F.col("before").alias("a"), F.col("c").alias("b"))).alias("signal", "x")).select("signal", "x.*")
    counts = each.toDF("signal", "a", "b").where("a is not null and b is not null and a <> b").groupBy("signal", "a", "b").count()
    seen: dict[int, dict[tuple[int, int], int]] = {}
    for r in counts.collect():  # at most MAX_CLASSES squared rows a signal
        seen.setdefault(r["signal"], {})[r["a"], r["b"]] = r["count"]
    best: tuple[float, int, dict[int, int]] = (0.0, -1, {})
    for signal, m in sorted(seen.items()):
        edges = {(a, b) for (a, b), up in m.items() if up + (down := m.get((b, a), 0)) >= least and up > share * (up + down)}
        lv = levels(edges)
        along = sum(x for (a, b), x in m.items() if lv.get(a, 0) < lv.get(b, 0))
        against = sum(x for (a, b), x in m.items() if lv.get(a, 0) > lv.get(b, 0))
        if edges and (steady := along / (along + against)) > best[0]:
            best = (steady, signal, lv)
    return best[1:]


def levels(edges: set[tuple[int, int]]) -> dict[int, int]:
    """Longest-path level of each node; nodes on a common cycle share a level."""
    nodes = sorted({x for e in edges for x in e})
    reach = {a: {b for x, b in edges if x == a} for a in nodes}
    for k in nodes:
        for a in nodes:
            if k in reach[a]:
                reach[a] |= reach[k]
    group = {a: min([a, *(b for b in reach[a] if a in reach[b])]) for a in nodes}
    level = {g: 0 for g in group.values()}
    for _ in level:
        for a, b in edges:
            if group[a] != group[b]:
                level[group[b]] = max(level[group[b]], level[group[a]] + 1)
    return {a: level[group[a]] for a in nodes}


def estimate_times(rows: DataFrame, level: dict[int, int]) -> DataFrame:
    """rows (k, id, t, c, v and others; c: class of the signal, v: identity) with ``est``, the time for the order, and ``above``.

    est is t where that is known. Else it is the latest time in the group of a row with the same v; failing that the latest
    at or below the row's level, and ``above`` is 1 if that level is truly below the row's own.
    """
    spark = rows.sparkSession
    lv = spark.createDataFrame(list(level.items()) or [(-1, 0)], "c int, lv int")
    rows = rows.join(F.broadcast(lv), "c", "left").withColumn("lv", F.when(F.col("c").isNotNull(), F.coalesce("lv", F.lit(0))))
    dated = rows.where("t is not null")
    lacking = rows.where("t is null")
    tops = dated.where("lv is not null").groupBy("k", "lv").agg(F.max("t").alias("top"))  # at most MAX_CLASSES rows a group
    at = F.struct("top", F.col("lv2").alias("lv2"))
    below = lacking.select("k", "lv").distinct().join(tops.withColumnRenamed("lv", "lv2"), "k").where("lv2 <= lv").groupBy("k", "lv").agg(F.max(at).alias("at"))
    # (k, v) of rows that lack a time, with the latest time of the same value: one row each
    same = dated.where("v is not null").join(lacking.select("k", "v").distinct(), ["k", "v"], "left_semi").groupBy("k", "v").agg(F.max("t").alias("own"))
    placed = lacking.join(below, ["k", "lv"], "left").join(same, ["k", "v"], "left")
    placed = placed.withColumn("est", F.coalesce("own", "at.top")).withColumn("above", F.when(F.col("own").isNull() & (F.col("at.lv2") < F.col("lv")), 1).otherwise(0))
    return dated.withColumn("est", F.col("t")).withColumn("above", F.lit(0)).unionByName(placed.drop("own", "at")).drop("lv")


def placed_rows(df: DataFrame, key: str, id_col: str, time: str, fields: list[Field], signals: list[Signal], identity: Column) -> DataFrame:
    """k, id, t, est, above and the rank and value of each field, of the rows with a key that is not blank."""
    rows = df.where(F.length(F.regexp_replace(key, r"(?U)\s+", "")) > 0).select(
        F.col(key).alias("k"), F.col(id_col).cast("long").alias("id"), F.col(time).alias("t"), F.array(*[s.cls for s in signals]).alias("cs"), identity.alias("v"), *[x.alias(f"{f.name}_{what}") for f in fields for what, x in (("rank", f.rank), ("val", f.value))]
    )
    rows = runtime.materialize(rows, "states")
    signal, level = learn_precedence(rows.select("k", "id", "t", F.col("cs").alias("c")))
    return estimate_times(rows.withColumn("c", F.col("cs")[signal] if signal >= 0 else F.lit(0)).drop("cs"), level)


def survivors(df: DataFrame, key: str, id_col: str, time: str, fields: list[Field], signals: list[Signal], identity: Column, missing: str = "estimate") -> DataFrame:
    """One row per key in at least two rows: key, n, and for each field <name>_id (0: none usable) and <name>_value."""
    rows = placed_rows(df, key, id_col, time, fields, signals, identity)
    own = (-F.col("id")).alias("i")
    place = [F.col("est").isNotNull().alias("placed"), F.col("est").alias("est"), F.col("above").alias("above")]
    order = [*place, own] if missing == "estimate" else [F.col("t").isNotNull().alias("dated"), F.col("t").alias("t"), own, *place]
    best = [F.max(F.when(F.col(f"{f.name}_rank") > 0, F.struct(F.col(f"{f.name}_rank").alias("r"), *order, F.col(f"{f.name}_val").alias("v")))).alias(f.name) for f in fields]
    out = rows.groupBy("k").agg(F.count("*").alias("n"), *best).where("n > 1")
    return out.select(F.col("k").alias(key), "n", *[x for f in fields for x in (F.coalesce(-F.col(f"{f.name}.i"), F.lit(0)).cast("long").alias(f"{f.name}_id"), F.col(f"{f.name}.v").alias(f"{f.name}_value"))])


def _leads(spark: SparkSession, sf_dir: str, missing: str) -> DataFrame:
    return survivors(runtime.table(spark, sf_dir, "leads"), "place_id", "lead_id", "scraped_at", lead_fields(), lead_signals(), lead_identity(), missing)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leads(spark, sf_dir, "oldest").select("place_id", *[F.col(f"{f}_id").alias(f"{f}_lead_id") for f in ("emails", "phones", "google", "homestars")])


def p7_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving values, with the order of undated rows estimated by currency."""
    return _leads(spark, sf_dir, "estimate").select("place_id", "n", *[F.col(f"{f}_value").alias(f) for f in ("emails", "phones", "google", "homestars")])


P7_SQL = r"""
WITH r AS (SELECT place_id, lead_id, scraped_at,
    len(list_distinct(list_filter(list_transform(coalesce(emails, []), lambda e: lower(trim(e, E' \t\n\r '))), lambda e: regexp_full_match(e, '[^@\s]+@[^@\s.]+(\.[^@\s.]+)+')))) AS e,
    len(list_distinct(list_filter(list_transform(list_transform(coalesce(phones, []), lambda p: regexp_replace(p, '[^0-9]+', '', 'g')),
      lambda d: CASE WHEN length(d) = 11 AND d LIKE '1%' THEN substr(d, 2) ELSE d END),
      lambda d: length(d) = 10 AND d <> repeat(substr(d, 1, 1), 10)))) AS p,
    CASE WHEN google_rating > 0 AND google_rating <= 5 THEN 1 ELSE 0 END AS g,
    CASE WHEN homestars_rating > 0 AND homestars_rating <= 10 THEN 1 ELSE 0 END AS h
  FROM leads WHERE trim(coalesce(place_id, ''), E' \t\n\r') <> ''),
o AS (SELECT *, count(*) OVER (PARTITION BY place_id) AS n,
    row_number() OVER (PARTITION BY place_id ORDER BY e DESC, scraped_at DESC NULLS LAST, lead_id) AS re,
    row_number() OVER (PARTITION BY place_id ORDER BY p DESC, scraped_at DESC NULLS LAST, lead_id) AS rp,
    row_number() OVER (PARTITION BY place_id ORDER BY g DESC, scraped_at DESC NULLS LAST, lead_id) AS rg,
    row_number() OVER (PARTITION BY place_id ORDER BY h DESC, scraped_at DESC NULLS LAST, lead_id) AS rh FROM r)
SELECT place_id, coalesce(max(CASE WHEN re = 1 AND e > 0 THEN lead_id END), 0) AS emails_lead_id,
  coalesce(max(CASE WHEN rp = 1 AND p > 0 THEN lead_id END), 0) AS phones_lead_id,
  coalesce(max(CASE WHEN rg = 1 AND g > 0 THEN lead_id END), 0) AS google_lead_id,
  coalesce(max(CASE WHEN rh = 1 AND h > 0 THEN lead_id END), 0) AS homestars_lead_id
FROM o WHERE n > 1 GROUP BY place_id
"""
