import random

import numpy as np
from pyspark.sql import functions as F

from leadloom.llm import canonmap

REF = [(1, "Deck Repair"), (2, "Desk Repair"), (3, "Boat Repair"), (3, "Marine Mechanic"), (4, "Book Binding"), (5, "Tree Removal"), (6, "Septic Tank Pumping"), (7, "Elevator Maintenance"), (8, "Bicycle Repair"), (9, "Bicycle Rental"), (10, "Auto Glass Shop")]


def distance(a, b):
    """Unrestricted Damerau-Levenshtein, the plain way."""
    d = {(-1, -1): (inf := len(a) + len(b))}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = inf, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = inf, j
    last = {}
    for i in range(1, len(a) + 1):
        same = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), same
            cost = a[i - 1] != b[j - 1]
            if not cost:
                same = j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_distance_and_tree():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(150)})
    codes, lengths = canonmap.encode(words)
    for a in words[:30]:
        assert list(canonmap.dl_batch(a, codes, lengths)) == [distance(a, b) for b in words]
    tree = canonmap.BKTree({w: i for i, w in enumerate(words)})
    asked = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    got = {(q, tree.texts[e], d) for q, e, d in tree.search(asked, np.full(len(asked), 2))}
    assert got == {(q, w, distance(a, w)) for q, a in enumerate(asked) for w in words if distance(a, w) <= 2}


def test_meanings():
    typed = {"deck repair": 1, "Desk Rpr": 2, "marine mehcanic": 3, "Binding, Book": 4, "Removal of trees": 5, "TreeRemoval": 5, "SEPTIC TANK PUMPINGS near me": 6, "Elevator Mtce": 7, "Bicycle Ren...": 9, "Bicycle Re.": 0, "Auto Glass Shop services": 10, "Scuba Charter": 0, "$$": 0, "Local company": 0, "⋅ Book  Binding (24h)": 4}
    got = canonmap.Matcher(REF).match(list(typed))
    assert {t: g[0] for t, g in zip(typed, got)} == typed


def test_shards_equal_broadcast_and_edges(spark, monkeypatch):
    ref = spark.createDataFrame([*REF, (11, None), (None, "x"), (1, "Deck Repair")], "id long, text string")
    values = ["deck repair", "Dekc Repair", "  ", "", "x" * 5000, "Bicycle Re.", "book bindig", "Planetarium", "İstanbul 😀"]
    df = spark.createDataFrame([(v, 1) for v in values], "value string, entry int").select("value")
    a = {r["value"]: r["entry"] for r in canonmap.map_values(df, ref).collect()}
    monkeypatch.setattr(canonmap, "SHARD_ENTRIES", 4)
    b = {r["value"]: r["entry"] for r in canonmap.map_values(df, ref).collect()}
    assert a == b and a["deck repair"] == 1 and a["Planetarium"] == 0 and len(a) == len(values)
    monkeypatch.undo()
    assert {r["entry"] for r in canonmap.map_values(df, ref.limit(0)).collect()} == {0}
    assert canonmap.map_values(df.limit(0), ref).count() == 0


def test_number_of_shards_changes_nothing(spark, monkeypatch):
    texts = ["Decking Repair", "Deck Building", "Boat Cleaning", "Roof Cleaning", "Auto Glass", "AUTO-GLASS", "Deck Rebuilding", "Very Long Trade Name With Seven Words"]
    ref = spark.createDataFrame(list(enumerate(texts, 1)), "id long, text string")
    values = ["deck repair", "deck bldg", "Dek Building", "boat clng", "auto glas", "Roof, cleaning", "clean", "v. long trade name with 7 words", "Very Lng Trade Nme With Seven Words", "deck"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = []
    for n in (50_000, 3, 2, 1):
        monkeypatch.setattr(canonmap, "SHARD_ENTRIES", n)
        got.append(sorted(tuple(r) for r in canonmap.map_values(df, ref).collect()))
    assert got[0] == got[1] == got[2] == got[3] and any(e == 8 for _, e, _ in got[0])


def test_tie_is_told_from_no_match(spark):
    ref = spark.createDataFrame([(1, "Deck Repair"), (2, "Desk Repair")], "id long, text string")
    df = spark.createDataFrame([("Dexk Repair",), ("Planetarium",)], "value string")
    assert {(r["value"], r["entry"], r["tie"]) for r in canonmap.map_values(df, ref).collect()} == {("Dexk Repair", 0, True), ("Planetarium", 0, False)}
