from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from leadloom.llm import copies

SCHEMA = "id long, company string, url string, phones array<string>, emails array<string>, k int, maybe string"


def rows(spark, data):
    return spark.createDataFrame([(*r, 7, "clash") for r in data], SCHEMA)


def test_formatting_is_disregarded(spark):
    data = [
        (1, "Acme, Inc.", "https://www.acme.example:443/a/?x=1&y=2", ["1-416-555-2671", "call us"], ["A@b.example", ""]),
        (2, " ACME inc", "http://acme.example/a?y=2&x=1", ["call us", "(416) 555-2671", "416.555.2671"], [" a@B.example "]),
        (3, "Acme Inc", "acme.example/a?x=1&y=2", ["tel: 416 555 2671"], ["a@b.example"]),
        (4, None, "", None, None), (5, "", None, [], [""]), (6, " ", " ", [None], [None]),
        (7, "x" * 100_000, "", None, None), (8, "X" * 100_000, "", None, None),
    ]
    got = {r["id"]: (r["first"], r["copies"]) for r in copies.group_copies(rows(spark, data), copies.canonical(), "id").collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 3), 5: (4, 3), 6: (4, 3), 7: (7, 2), 8: (7, 2)}


def test_hot_key_and_empty(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).cast("string").alias("key"))
    want = defaultdict(list)
    for i in range(3000):
        want["0" if i % 3 == 0 else str(i % 700)].append(i)
    got = {r["id"]: (r["first"], r["copies"]) for r in copies.group_copies(df, F.col("key"), "id").collect()}
    assert got == {i: (min(v), len(v)) for v in want.values() for i in v}
    assert copies.group_copies(df.limit(0), F.col("key"), "id").count() == 0


def test_filter_holds_every_repeat(spark):
    df = spark.range(4000).repartition(7).select(F.xxhash64(F.col("id") % 2500).alias("h"))
    bits = copies.filter_bits(4000)
    again = copies.repeat_filter(df, bits, fan_in=2)
    h = np.array([r["h"] for r in spark.range(2500).select(F.xxhash64("id").alias("h")).collect()])
    pos = copies._positions(h, bits)
    hit = ((again[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1).all(1)
    assert hit[:1500].all() and hit[1500:].mean() < 0.1


def test_slices_change_nothing(spark, monkeypatch):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1100).cast("string").alias("key")).repartition(3)
    rows = lambda: {(r["id"], r["first"], r["copies"]) for r in copies.group_copies(df, F.col("key"), "id").collect()}
    one = rows()
    monkeypatch.setattr(copies, "SLICE_BITS", 1 << 13)
    parts = copies.slices(4000)
    assert len(parts) == 6 and parts[0][0] == -(1 << 63) and parts[-1][1] == (1 << 63) - 1 and all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))
    assert rows() == one and len(one) == 4000


def test_rate_is_the_same_at_every_size():
    rng = np.random.default_rng(2)
    for n in (90_000, 900_000):
        bits = copies.filter_bits(n)
        h = rng.integers(-(1 << 63), (1 << 63) - 1, n)
        table = np.zeros(bits, bool)
        table[copies._positions(h, bits).ravel()] = True
        other = rng.integers(-(1 << 63), (1 << 63) - 1, 100_000)
        assert table[copies._positions(h, bits)].all() and table[copies._positions(other, bits)].all(1).mean() < 0.01
