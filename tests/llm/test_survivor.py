from datetime import datetime

from pyspark.sql import functions as F

from leadloom.llm import survivor

SCHEMA = "place_id string, lead_id long, scraped_at timestamp_ntz, emails array<string>, phones array<string>, google_rating double, homestars_rating double, google_reviews int, tier string, address string, n int, k string, id string"


def best(spark, rows, **kw):
    df = spark.createDataFrame([(*r[:7], *(r[7:] or (None, None, None)), 1, "x", "y") for r in rows], SCHEMA)
    return {r["place_id"]: r for r in survivor.survivors(df, "place_id", "lead_id", "scraped_at", survivor.lead_fields(), survivor.lead_signals(), survivor.lead_identity(), **kw).collect()}


T = lambda d: datetime(2025, 1, d)


def test_fields(spark):
    rows = [
        ("a", 1, T(1), ["x@y.example", "X@Y.example ", "none@"], ["0000000000", "416-555-2671"], 0.0, 11.0), ("a", 2, T(2), ["x@y.example"], ["1 416 555 2671"], 4.0, None), ("a", 3, T(2), ["z@y.example"], [], 5.0, float("nan")), ("a", 4, None, ["x@y.example", "q@y.example"], None, 5.1, 10.0),
        ("b", 5, None, None, None, None, None), ("b", 6, None, [], [""], None, None), ("c", 7, T(1), [], [], 1.0, 1.0), (" ", 8, T(1), [], [], 1.0, 1.0), (" ", 9, T(1), [], [], 1.0, 1.0), (None, 10, T(1), [], [], 1.0, 1.0), (None, 11, T(1), [], [], 1.0, 1.0),
    ]
    got = best(spark, rows, missing="oldest")
    assert set(got) == {"a", "b"}
    assert [got["a"][f"{f}_id"] for f in ("emails", "phones", "google", "homestars")] == [4, 2, 2, 4]
    assert [got["b"][f"{f}_id"] for f in ("emails", "phones", "google", "homestars")] == [0, 0, 0, 0] and got["b"]["emails_value"] is None
    assert best(spark, rows[:0]) == {} and best(spark, rows[:0], missing="oldest") == {}


def test_levels():
    assert survivor.levels({(1, 2), (2, 3), (1, 3)}) == {1: 0, 2: 1, 3: 2}
    assert survivor.levels({(1, 2), (2, 1), (2, 3)}) == {1: 0, 2: 0, 3: 1}
    assert survivor.levels(set()) == {}


def test_currency_places_undated_rows(spark):
    # no rating -> rating is learnt from dated groups; the undated row with a rating is then later than the dated one without
    rows = [r for i in range(30) for r in ((f"g{i}", 10 * i, T(1), ["a@b.example"], None, None, None), (f"g{i}", 10 * i + 1, T(2), ["c@b.example"], None, 3.0, None))]
    rows += [("u", 1000, T(5), ["a@b.example"], None, None, None), ("u", 1001, None, ["c@b.example"], None, 3.0, None)]
    rows += [("v", 1002, T(5), ["a@b.example"], None, 3.0, None), ("v", 1003, None, ["c@b.example"], None, None, None)]
    dated = best(spark, rows)
    assert dated["v"]["emails_id"] == 1002  # the undated row is below
    assert dated["u"]["emails_id"] == 1001  # the undated row is above, although its id is larger
    assert best(spark, rows, missing="oldest")["u"]["emails_id"] == 1000
    df = spark.createDataFrame([("u", 1, T(5), 0, 7), ("u", 2, None, 1, 8), ("u", 3, None, 0, None), ("u", 4, None, 1, 7), ("u", 5, None, None, None)], "k string, id long, t timestamp_ntz, c int, v long")
    place = lambda lv: {r["id"]: (r["est"], r["above"]) for r in survivor.estimate_times(df, lv).collect()}
    assert place({0: 0, 1: 1}) == {1: (T(5), 0), 2: (T(5), 1), 3: (T(5), 0), 4: (T(5), 0), 5: (None, 0)}
    assert place({0: 1, 1: 0}) == {1: (T(5), 0), 2: (None, 0), 3: (T(5), 0), 4: (T(5), 0), 5: (None, 0)}


def test_precedence_is_learnt_alike_at_any_size(spark):
    # reviews grow, contacts and ratings stay: hot keys (few groups) and cold ones (many) teach the same
    for groups in (30, 400, 1500):
        rows = [r for i in range(groups) for r in ((f"g{i}", 10 * i, T(1), ["a@b.example"], None, None, None, 10, "cold", None), (f"g{i}", 10 * i + 1, T(2), ["c@b.example"], None, None, None, 40, "cold", None))]
        rows += [("u", 90001, T(5), ["a@b.example"], None, None, None, 10, None, None), ("u", 90002, None, ["c@b.example"], None, None, None, 41, None, None), ("w", 90003, None, ["a@b.example"], None, None, None, 10, None, None), ("w", 90004, T(5), ["c@b.example"], None, None, None, 41, None, None)]
        rows += [("x", 90005, None, ["a@b.example"], None, None, None, 10, None, "1 Elm"), ("x", 90006, T(3), ["a@b.example"], None, None, None, 40, None, "1 elm"), ("x", 90007, T(5), ["c@b.example"], None, None, None, 40, None, None)]
        got = best(spark, rows)
        assert [got[k]["emails_id"] for k in "uwx"] == [90002, 90004, 90007], groups


def test_learnt_edge_changes_the_survivor(spark):
    # all keys are hot here; the undated row without rating is older than the dated one with it, so the smaller id doesn't win
    rows = [r for i in range(30) for r in ((f"g{i}", 10 * i, T(1), ["a@b.example"], None, None, None), (f"g{i}", 10 * i + 1, T(2), ["c@b.example"], None, 3.0, None))]
    rows += [("w", 3000, None, ["a@b.example"], None, None, None), ("w", 3001, T(5), ["c@b.example"], None, 3.0, None)]
    assert best(spark, rows)["w"]["emails_id"] == 3001


def test_repeated_rows_of_one_id(spark):
    rows = [("a", 1, None, ["p@b.example"], None, None, None), ("a", 1, None, ["q@b.example"], None, None, None)]
    assert best(spark, rows, missing="oldest")["a"]["emails_id"] == 1 and best(spark, rows)["a"]["emails_id"] == 1


def test_every_step_of_a_hot_group_counts_once(spark):
    df = spark.createDataFrame([("h", i, datetime(2025, 1, 1, i // 60, i % 60), i % 5) for i in range(1200)], "k string, id long, t timestamp_ntz, c int")
    assert survivor.hot_steps(df).where("before is not null").groupBy("before", "c").count().count() == 5
    assert survivor.hot_steps(df).where("before is not null").count() == 1199
