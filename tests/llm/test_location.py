from leadloom.llm import address, location

CITIES = [("Ashbury", "HB", "Harbren"), ("Ashbury Falls", "HB", "Harbren"), ("Yarmouth", "AM", "Aldermark"), ("Yarmouth", "GT", "Granthia"), ("Kelport", "NV", "New Velland")]


def test_parser():
    p = address.AddressParser(CITIES).parse
    want = ("4474", "wrenview", "avenue", "e", "328", "ashbury", "hb", "a7w4a0")
    for s in ("4474 Wrenview Avenue E #328, Ashbury, HB A7W4A0", "a7w-4a0 - Ashbury - HB - Unit 328, 4474 E. Wrenview Ave", "328-4474 wrenview ave. east\nAshbruy\nHarbren a7w 4a0 canada", "No. 4474 Wrenview Av E Suite#328 Ashbury Harbren A7W 4A0"):
        assert tuple(p(s)) == want, s
    assert p("12 Oak St, Ashbury Fals")[5] == "ashbury falls"
    assert p("12 Oak St, Yarmouth")[5:7] == ("yarmouth", "") and p("12 Oak St, Yarmouth, GT")[6] == "gt"
    assert tuple(p(None)) == tuple(p(" ; ")) == ("",) * 8 and p("x " * 20000)[0] == ""


def test_pairs(spark):
    data = {
        1: "12 Oakfield St, Kelport, NV", 2: "12 OAKFIELD STREET; KELPORT", 3: "12 Oakfield", 4: "12 Oakfeild St, Kelport, New Velland", 5: "12 Oakfield St, Kelport, NV",
        6: "12 Oakfield Lane, Ashbury", 7: "9 Elm Rd, Kelport", 8: "9 Elm Ave, Kelport", 9: "9 Elm, Kelport", 10: "7 Fir Rd Unit 3, Kelport", 11: "7 Fir Road #4, Kelport", 12: "7 Fir Rd, Kelport", 13: "5 Ash Ct #2, Kelport", 14: "5 Ash Court, Kelport",
        15: None, 16: "  ", 17: "Kelport", 18: "12 Oakfield St, Kelport, NV",
    }
    df = spark.createDataFrame([(i, a, 1, "u") for i, a in data.items()], "lead_id long, address string, location int, unit string")
    cities = spark.createDataFrame(CITIES, "city string, province_id string, province_name string")
    placed = location.locations(df, "lead_id", "address", cities)
    got = {(r["id_a"], r["id_b"]) for r in location.same_location_pairs(placed).collect()}
    same = {1, 2, 4, 5, 18}  # 3 could be of two streets; 9 of two kinds; 12 of two units
    want = {(a, b) for a in same for b in same if a < b and data[a] != data[b]} | {(13, 14)}
    assert got == want
    assert location.locations(df.limit(0), "lead_id", "address", cities).count() == 0


def test_salted_pairs_equal_plain(spark, monkeypatch):
    monkeypatch.setattr(location, "BLOCK", 5)
    df = spark.range(60).selectExpr("id", "concat('a', id % 7) as address", "cast(id % 2 as long) as location")
    got = {(r["id_a"], r["id_b"]) for r in location.same_location_pairs(df).collect()}
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2 and a % 7 != b % 7}


def test_short_names_with_a_typo(spark):
    data = {1: "12 Main St, Kelport", 2: "12 Mian St, Kelport", 3: "7 Maple Rd, Kelport", 4: "7 Mapel Rd, Kelport", 5: "9 Cedar Ave, Kelport", 6: "9 Ceder Ave, Kelport", 7: "5 Oakfields Ct, Kelport", 8: "5 Oakfelds Ct, Kelport", 9: "3 Elm St, Kelport", 10: "3 Fir St, Kelport", 11: "4 Abcdefgh Rd, Kelport", 12: "4 Abcdefghi Rd, Kelport"}
    df = spark.createDataFrame(list(data.items()), "lead_id long, address string")
    cities = spark.createDataFrame(CITIES, "city string, province_id string, province_name string")
    placed = location.locations(df, "lead_id", "address", cities)
    assert {(r["id_a"], r["id_b"]) for r in location.same_location_pairs(placed).collect()} == {(1, 2), (3, 4), (5, 6), (7, 8), (11, 12)}


def test_every_typo_shares_a_piece(spark):
    import random

    rng, rows = random.Random(6), []
    for n in range(2, 15):
        for _ in range(40):
            a = "".join(rng.choice("abcdefgh") for _ in range(n))
            i, c = rng.randrange(n), rng.choice("xyz")
            rows += [(a, b) for b in (a[:i] + c + a[i + 1 :], a[:i] + a[i + 1 :], a[:i] + c + a[i:], a[:i] + a[i + 1 : i + 2] + a[i : i + 1] + a[i + 2 :])]
    df = spark.createDataFrame(rows, "a string, b string")
    from pyspark.sql import functions as F

    assert df.where(~F.arrays_overlap(location.pieces(F.col("a")), location.pieces(F.col("b")))).collect() == []
