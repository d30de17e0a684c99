import random

from pyspark.sql import functions as F

from leadloom import runtime
from leadloom.llm import topn

SCHEMA = "id long, g string, s int, t int, rank int, path string"


def brute(rows, n):
    out = {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (-(r[2] or 0), -(r[3] or 0), r[0])):
        out.setdefault(r[1], []).append(r[0])
    return {(g, i) for g, v in out.items() for i in v[:n]}


def test_equals_brute_and_skips(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", None, "", "é", *map(str, range(20))]), rng.choice([None, 0, 1, 2, 50]) if i % 5 else rng.randint(-5, 900), rng.choice([None, 3, 3, 4]), 1, "x") for i in range(3000)]
    path = runtime.fresh_path(spark, "t")
    topn.cluster(spark.createDataFrame(rows, SCHEMA), "g", "s", [("t", True)], "id", path, rows_per_file=400, row_group_rows=100)
    got, report = topn.top_n(spark, path, 5, 1)
    assert {(r["g"], r["id"]) for r in got.collect()} == brute(rows, 5)
    assert report.where("wave is null").count() > 0


def test_all_ties_and_empty(spark):
    rows = [(i, "a", 7, 7, 0, "") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    got, _ = topn.top_n_per_group(df, "g", "s", [("t", True)], "id", 3)
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 2]
    got, _ = topn.top_n_per_group(df.limit(0), "g", "s", [("t", True)], "id", 3)
    assert got.count() == 0


def test_fewer_rows_than_n(spark):
    got, _ = topn.top_n_per_group(spark.createDataFrame([(1, "a", None, None, 0, ""), (2, "a", 0, None, 0, "")], SCHEMA), "g", "s", [("t", True)], "id", 5)
    assert [(r["id"], r["rank"]) for r in got.orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_batches_are_added_beside(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot", "hot", "a", "b"]), rng.randint(0, 400), rng.choice([None, 3, 4]), 1, "x") for i in range(2400)]
    path = runtime.fresh_path(spark, "t")
    for k in range(3):
        topn.cluster(spark.createDataFrame(rows[k::3], SCHEMA), "g", "s", [("t", True)], "id", path, rows_per_file=300, row_group_rows=50, mode="append")
    got, report = topn.top_n(spark, path, 5, 1)
    assert {(r["g"], r["id"]) for r in got.collect()} == brute(rows, 5)
    assert report.where("wave is null").count() > report.where("wave is not null").count()
