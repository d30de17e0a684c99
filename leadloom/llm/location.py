"""Problem 4: address texts that denote the same location, by a set-containment join.

1. Distinct texts are taken apart (``address.py``). A town left out, or misread, is filled from the forward
   area of the postal code where one town clearly holds it among all addresses (at most 6,760 areas).
2. Texts with equal parts (without the unit) are one *base*. Its tokens are house number + piece of the street name
   (``pieces``: one typo leaves at least one intact) + town, the same without town, and house number + postal code. How many
   bases have each token is counted; for each piece of its name a base is indexed by the rarest token it has. Fuller
   bases probe with all their tokens, so a text that leaves parts out meets every text that contains it.
3. A candidate pair is verified: no component may contradict (a street name may differ by one typo, if one of
   the two spellings is rare), and the weights (log of rarity) of the shared parts must reach ``CONTAINED`` of
   the sparser base's weight.
4. Each base goes to the fullest base it agrees with, over as many steps as it takes. If it agrees with two that
   contradict each other, the parts it leaves out do not tell them apart and it stays without a location.
5. Units: where a location has several units, a text without a unit stays apart; where it has one, it is filled.

Bases are few for a location however many rows it has (spellings, not copies or units), so the join of step 3
is not a product over copies. The pairs of ``p4_found`` are joined in salted blocks of ``BLOCK`` rows.

Defined cases: null and blank addresses, and texts without a house number or street, have no location; texts
that are byte for byte equal make no pair; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import runtime
from leadloom.llm import address

CONTAINED = 0.7
#: A town holds a forward area if it has this share of its addresses.
AREA_SHARE = 0.8
#: Of two spellings a typo apart, one must be this many times rarer than the other, or this rare.
RARER, RARE = 5, 2
BLOCK = 2000
PARTS = ("num", "name", "kind", "dir", "city", "prov", "postal")


def fill_towns(parts: DataFrame) -> DataFrame:
    """parts with city and prov filled from the forward area of the postal code."""
    area = F.substring("postal", 1, 3)
    seen = parts.where("postal <> '' and city <> '' and prov <> ''").groupBy(area.alias("area"), "city", "prov").agg(F.count("*").alias("n"))
    per = seen.groupBy("area").agg(F.max_by(F.struct("city", "prov"), F.struct("n", "city", "prov")).alias("t"), F.max("n").alias("top"), F.sum("n").alias("all"))
    held = per.where(F.col("top") >= AREA_SHARE * F.col("all")).select("area", F.col("t.city").alias("a_city"), F.col("t.prov").alias("a_prov"))
    # the areas are letter-digit-letter: at most 26 * 10 * 26 rows, whatever the input
    j = parts.withColumn("area", area).join(F.broadcast(held), "area", "left").drop("area")
    return j.withColumn("city", F.coalesce("a_city", "city")).withColumn("prov", F.coalesce("a_prov", "prov")).drop("a_city", "a_prov")


#: From this length on, first and last 4 letters are so far apart that one typo spares one of them.
LONG_NAME = 9


def pieces(name: Column) -> Column:
    """Names that differ by one edit, or a swap of neighbours, share an entry: both ends of a long name; a short one itself and without each letter."""
    ends = F.array(F.concat(F.lit("<"), F.substring(name, 1, 4)), F.concat(F.substring(name, -4, 4), F.lit(">")))
    less = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
    short = F.array_distinct(F.concat(F.array(name), less))
    # between the two kinds of length one name may be long and the other short: those have both
    return F.when(F.length(name) > LONG_NAME, ends).when(F.length(name) >= LONG_NAME - 1, F.concat(ends, short)).otherwise(short)


def _same_or_missing(c: str) -> Column:
    a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
    return (a == b) | (a == "") | (b == "")


def _candidates(base: DataFrame) -> DataFrame:
    """(x, y): bases that may contain one another: each is indexed by its rarest tokens and probes with all."""
    token = lambda *c: F.xxhash64(*[F.lit(x) if x in "tcp" else F.col(x) for x in c])
    # the token of the postal code is the same for every piece of the name: it counts as one
    t = lambda own, weight: F.struct(own.alias("token"), weight.cast("double").alias("w"))
    tokens = F.filter(F.array(t(F.when(F.col("city") != "", token("t", "num", "piece", "city")), F.lit(1)), t(token("c", "num", "piece"), F.lit(1)), t(F.when(F.col("postal") != "", token("p", "num", "postal")), 1 / F.col("of"))), lambda x: x["token"].isNotNull())
    each = base.select("id", "num", "city", "postal", pieces(F.col("name")).alias("all"))
    keyed = each.select("id", "num", "city", "postal", F.size("all").alias("of"), F.posexplode("all").alias("pos", "piece")).select("id", "pos", F.explode(tokens).alias("t")).select("id", F.col("pos").cast("byte").alias("pos"), "t.*")
    keyed = runtime.materialize(keyed, "tokens")
    counts = runtime.materialize(keyed.groupBy("token").agg(F.count("*").alias("m"), F.sum("w").alias("df")), "counts")
    rare = runtime.join_hot(keyed.select("id", "pos", "token"), counts, ["token"], "m", keyed.count())
    index = rare.groupBy("id", "pos").agg(F.min(F.struct("df", "token")).alias("best")).select("id", F.col("best.token").alias("token")).distinct()
    probe = keyed.where("w = 1 or pos = 0").select(F.col("id").alias("to"), "token")
    return index.join(probe, "token").where("id <> to").select(F.least("id", "to").alias("x"), F.greatest("id", "to").alias("y")).distinct()


def _edges(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lo, hi) of the pairs that agree: the sparser and the fuller base."""
    small = F.lit(1.0)
    a, b = base.alias("a"), base.alias("b")
    close = F.levenshtein("a.name", "b.name", 2)
    swapped = (F.length("a.name") == F.length("b.name")) & (F.array_sort(F.split("a.name", "")) == F.array_sort(F.split("b.name", ""))) & (close == 2)
    rare = F.least("a.name_df", "b.name_df")
    typo = ((close == 1) | swapped) & ((rare <= RARE) | (rare * RARER <= F.greatest("a.name_df", "b.name_df")))
    agree = (F.col("a.num") == F.col("b.num")) & ((F.col("a.name") == F.col("b.name")) | typo)
    for c in PARTS[2:]:
        agree = agree & _same_or_missing(c)
    shared = F.least("a.w_num", "b.w_num") + F.least("a.w_name", "b.w_name") + sum(F.when((F.col(f"a.{c}") == F.col(f"b.{c}")) & (F.col(f"a.{c}") != ""), small).otherwise(0.0) for c in PARTS[2:])
    contained = shared >= CONTAINED * F.least("a.w", "b.w")
    rank = lambda t: F.struct(F.col(f"{t}.full"), F.col(f"{t}.name_df"), F.col(f"{t}.support"), F.col(f"{t}.id"))
    good = pairs.join(a, F.col("x") == F.col("a.id")).join(b, F.col("y") == F.col("b.id")).where(agree & contained)
    up = rank("a") < rank("b")
    return good.select(F.when(up, F.col("x")).otherwise(F.col("y")).alias("lo"), F.when(up, F.col("y")).otherwise(F.col("x")).alias("hi"))


def locate(texts: DataFrame, cities: DataFrame) -> DataFrame:
    """address -> location (long, null if none) and unit ('' if none or told by none), for distinct ``texts``."""
    parts = runtime.materialize(fill_towns(runtime.materialize(address.parse_addresses(texts, cities), "parts")).where("num <> '' and name <> ''"), "filled")
    base = parts.groupBy(*PARTS).agg(F.count("*").alias("support"))
    base = base.withColumn("id", F.xxhash64(*PARTS)).withColumn("full", sum((F.col(c) != "").cast("int") for c in PARTS))
    n = F.lit(float(max(parts.count(), 1)))
    names = base.groupBy("name").agg(F.sum("support").alias("name_df"))
    nums = base.groupBy("num").agg(F.sum("support").alias("num_df"))
    base = base.join(names, "name").join(nums, "num")
    small = F.lit(1.0)  # weight of a part that says little beside number and street
    base = base.withColumn("w_num", F.log1p(n / F.col("num_df"))).withColumn("w_name", F.log1p(n / F.col("name_df")))
    base = base.withColumn("w", F.col("w_num") + F.col("w_name") + sum(F.when(F.col(c) != "", small).otherwise(0.0) for c in PARTS[2:]))
    base = runtime.materialize(base, "bases")

    edges = runtime.scoped("edges", lambda: _edges(base, _candidates(base)))

    # roots: bases that agree with none fuller; every other base takes its root if it has just one
    roots = base.select("id").join(edges.select(F.col("lo").alias("id")).distinct(), "id", "left_anti")
    direct = edges.join(roots.withColumnRenamed("id", "hi"), "hi").groupBy("lo").agg(F.min("hi").alias("r1"), F.max("hi").alias("r2"))
    direct = runtime.materialize(direct, "direct")
    # bases that meet their root only through others (a typo on each side): every round places those one step further away
    reached = direct
    while True:
        late = edges.join(reached.select("lo"), "lo", "left_anti").join(reached.withColumnRenamed("lo", "hi"), "hi").groupBy("lo").agg(F.min("r1").alias("r1"), F.max("r2").alias("r2"))
        late = runtime.materialize(late, "late")
        if late.isEmpty():
            break
        reached = reached.unionByName(late)
    owner = roots.select("id", F.col("id").alias("location")).unionByName(reached.where("r1 = r2").select(F.col("lo").alias("id"), F.col("r1").alias("location")))
    placed = parts.withColumn("id", F.xxhash64(*PARTS)).join(owner, "id").select("address", "unit", "location")
    units = placed.where("unit <> ''").groupBy("location").agg(F.min("unit").alias("u1"), F.max("unit").alias("u2"))
    filled = F.when((F.col("unit") == "") & (F.col("u1") == F.col("u2")), F.col("u1")).otherwise(F.col("unit"))
    return placed.join(units, "location", "left").select("address", "location", filled.alias("unit"))


def locations(df: DataFrame, id_col: str, address_col: str, cities: DataFrame) -> DataFrame:
    """id, address, location (class of the place, told by unit), for rows that have one."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(address_col).alias("address")).where(~address.blank("address"))
    found = locate(runtime.materialize(rows.select("address").distinct(), "texts"), cities).select("address", F.xxhash64("location", "unit").alias("location"))
    return rows.join(runtime.materialize(found, "located"), "address")


def same_location_pairs(rows: DataFrame) -> DataFrame:
    """All pairs (id_a < id_b) of rows of one location with different texts, in salted blocks: no task holds a whole hot class."""
    size = rows.groupBy("location").agg(F.count("*").alias("n"), F.min("address").alias("a1"), F.max("address").alias("a2")).where("n > 1 and a1 <> a2")
    rows = rows.join(size.select("location", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "location")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    right = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a, b = left.alias("a"), right.alias("b")
    same = (F.col("a.location") == F.col("b.location")) & (F.col("a.salt") == F.col("b.salt"))
    return a.join(b, same & (F.col("a.id") < F.col("b.id")) & (F.col("a.address") != F.col("b.address"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.materialize(locations(runtime.table(spark, sf_dir, "leads"), "lead_id", "address", runtime.table(spark, sf_dir, "cities")), "locations")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_location_pairs(_leads(spark, sf_dir)).select(F.col("id_a").alias("lead_id_a"), F.col("id_b").alias("lead_id_b"))


def p4_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lead with a location: its class (smallest lead of it) and the number of leads there."""
    classes = _leads(spark, sf_dir)
    first = classes.groupBy("location").agg(F.min("id").alias("first_lead_id"), F.count("*").alias("leads"))
    return classes.join(first, "location").select(F.col("id").alias("lead_id"), "first_lead_id", "leads")
