from pyspark.sql import functions as F

from leadloom.llm import batches

#: Spark jobs of loading and of three small batches.
MOST_JOBS = 160
RAW = "batch_no long, id long, place string, domain string, url string, company string, phones array<string>"


def run(spark, cache, new):
    df = spark.createDataFrame([(0, -1, *c) for c in cache] + list(new), RAW)
    norm = batches.normalized(df, F.col("id"), F.col("place"), F.col("domain"), F.col("url"), F.col("company"), F.col("phones"), F.col("batch_no"))
    return {r["id"]: r["known"] for r in batches.classify(norm.where("id = -1").drop("batch_no"), norm.where("id <> -1")).collect()}


def test_known_and_new(spark):
    host = [("ChIJhost%d" % i, f"s{i}.yard.example", None, f"Shop {i}", [f"41655510{i:02d}"]) for i in range(8)]
    cache = [("ChIJabc", "acme.example", None, "Acme Ltd", ["416-555-2671"]), (None, "board.example:8443", None, None, None), *host]
    new = [
        (1, 1, "!1sChIJabc!8m2", None, None, None, None), (1, 2, "ChIJABC", None, None, None, None), (1, 3, None, "https://WWW.Board.example./x", None, None, None), (1, 4, " ", "shop.acme.example", None, None, None),
        (1, 5, None, "acmme.example", None, "The ACME, Ltd.", ["+1 416 555 2671"]), (1, 6, None, "acnne.example", None, "Other Ltd", ["4165552671"]), (1, 7, None, "yard.example", None, None, None), (1, 8, None, "s99.yard.example", None, None, None),
        (1, 9, None, "s1.yard.example", None, None, None), (1, 10, None, None, None, "x", None), (2, 11, "ChIJABC", None, None, None, None), (2, 12, None, "", "https://s99.yard.example/a", None, None), (2, 13, "ChIJnew\n", None, None, None, None),
        (2, 14, "ChIJnew", None, None, None, None), (2, 15, None, "localhost", None, None, None),
    ]
    got = run(spark, cache, new)
    assert {i for i, k in got.items() if k} == {1, 3, 4, 5, 9, 11, 12, 14} and len(got) == 15


def test_empty(spark):
    assert run(spark, [(None, None, None, None, None)], []) == {}


def entry_rows(spark, a, b, kind="P"):
    return spark.range(a, b).select(F.lit(kind).alias("kind"), F.concat(F.lit("k"), "id").alias("key"), F.lit("").alias("site"), F.lit(1).cast("long").alias("n"))


def test_levels_keep_all(spark, monkeypatch):
    monkeypatch.setattr(batches, "RANGE_ROWS", 40)
    h = batches.History(spark)
    written = []
    keep = h._write
    h._write = lambda df, level: written.append(level) or keep(df, level)
    for i in range(26):
        h.append(entry_rows(spark, i * 10, i * 10 + 12))  # two of each batch are repeated
    got = h.read()
    assert got.select("key").distinct().count() == 262 and got.agg(F.sum("n")).first()[0] == 26 * 12
    assert {r["level"] for r in h.runs} <= {0, 1, 2} and all(sum(r["level"] == k for r in h.runs) <= batches.COMPACT_EVERY for k in range(3))
    assert written.count(1) == 5 and written.count(2) == 1  # each entry is written once a level


def test_opened_again_and_untouched_ranges_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(batches, "RANGE_ROWS", 200)
    h = batches.History(spark)
    h.append(entry_rows(spark, 0, 4000))
    again = batches.History(spark, h.path)
    assert again.runs == h.runs and len(again.runs[0]["bounds"]) > 10
    some = again.read(entry_rows(spark, 700, 701))
    assert some.where("key = 'k700'").count() == 1 and len(some.inputFiles()) < len(again.read().inputFiles()) or some.count() < 600
    assert some.count() < 600


def test_batches_in_two_sessions_equal_one(spark):
    cache = [("ChIJa%d" % i, f"shop{i}.example", None, f"Shop {i}", [f"41655510{i:02d}"]) for i in range(30)]
    new = [(b, 100 * b + i, f"ChIJa{b * 7 + i}" if i % 3 else None, f"shop{b * 5 + i}.example", None, f"Shop {b * 5 + i}", [f"41655510{(b * 5 + i) % 90:02d}"]) for b in (1, 2, 3) for i in range(12)]
    whole = run(spark, cache, new)
    norm = lambda rows: batches.normalized(spark.createDataFrame(rows, RAW), F.col("id"), F.col("place"), F.col("domain"), F.col("url"), F.col("company"), F.col("phones"), F.col("batch_no"))
    known = norm([(0, -1, *c) for c in cache]).drop("batch_no")
    path = batches.runtime.fresh_path(spark, "kept")
    got = {}
    for b in (1, 2, 3):
        got |= {r["id"]: r["known"] for r in batches.classify(known if b == 1 else known.limit(0), norm([r for r in new if r[0] == b]), path=path).collect()}
    assert got == whole and any(got.values()) and not all(got.values())


def test_website_found_though_its_parent_is_shared_later(spark):
    cache = [("ChIJz", "z.yard.example", None, "Zed", ["4165551000"])]
    new = [(1, i, f"ChIJ{i}", f"s{i}.yard.example", None, f"Shop {i}", [f"41655520{i:02d}"]) for i in range(8)]
    new += [(2, 20, None, "z.yard.example", None, None, None), (2, 21, None, "y.yard.example", None, None, None), (2, 22, None, "yard.example", None, None, None)]
    got = run(spark, cache, new)
    assert [got[i] for i in (20, 21, 22)] == [True, False, False]


def test_short_and_long_keys(spark):
    cache = [(None, "joes.ca", None, "Joes Garage", ["4165551000"]), (None, "mega.example", None, "M" * 60_000, ["4165551001"])]
    new = [(1, 1, None, "joess.ca", None, "Joes Garage", ["4165551000"]), (1, 2, None, "jxxs.ca", None, "Joes Garage", ["4165551000"]), (1, 3, None, "mega.exampel", None, "m" * 60_000, ["4165551001"])]
    assert run(spark, cache, new) == {1: True, 2: False, 3: True}


def test_batch_takes_few_queries_and_leaves_little_in_the_driver(spark, monkeypatch):
    # broadcasts and plans of past batches stay in the driver until its garbage is collected
    tidied = []
    monkeypatch.setattr(batches.runtime, "tidy", lambda s: tidied.append(s), raising=False)
    cache = [("ChIJa%d" % i, f"shop{i}.example", None, f"Shop {i}", [f"41655510{i:02d}"]) for i in range(30)]
    new = [(b, 100 * b + i, f"ChIJa{b * 7 + i}", f"shop{b * 5 + i}.example", None, f"Shop {b * 5 + i}", None) for b in (1, 2, 3) for i in range(12)]
    spark.sparkContext.setJobGroup("batches", "counted")
    try:
        got = run(spark, cache, new)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("batches"))
    assert len(got) == 36 and len(tidied) == 4 and jobs <= MOST_JOBS, jobs
