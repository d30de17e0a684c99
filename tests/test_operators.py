import random
import re

from pyspark.sql import functions as F

from leadloom import runtime
from leadloom.operators import catalog, dedup, enrich, expand, merge, pipeline


def greedy(rows):
    places, urls, kept = set(), set(), []
    for o, p, u in rows:
        if u in urls or (p and p in places):
            continue
        kept.append(o)
        urls.add(u)
        if p:
            places.add(p)
    return kept


def test_two_key_greedy(spark):
    rng = random.Random(3)
    cases = [[(0, "p1", "u"), (1, "p2", "u"), (2, "p2", "v")], [(i, rng.choice(["", None, "a", "b", "c", "d"]), rng.choice("stuvwxyz")) for i in range(60)], [(i, f"p{(i + 1) // 2}", f"u{i // 2}") for i in range(24)]]
    for rows in cases:
        df = spark.createDataFrame(rows, "o long, p string, u string")
        assert sorted(r["o"] for r in dedup.two_key_greedy(df, "p", "u", "o").collect()) == greedy(rows)


def test_first_per_key_keeps_blank(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, ""), (5, None)], "o int, k string")
    assert sorted(r["o"] for r in dedup.first_per_key(df, F.col("k"), F.col("o"), keep_blank=True).collect()) == [1, 3, 4, 5]


def test_filter_urls(spark):
    u = ["https://plumbing.com/a", "https://acme.ca/", "https://www.acme.ca/b", "https://www.yelp.ca/x"]
    df = spark.createDataFrame(list(enumerate(u)), "o int, u string")
    assert [r["u"] for r in dedup.business_urls(df, "u", "o", 10).collect()] == ["https://acme.ca/"]


def test_overlay(spark):
    cols = "url string, emails array<string>, phones array<string>, socials map<string,string>, hours string, description string, company string, address string"
    own = spark.createDataFrame([("u", ["b@x.ca"], [], {"facebook": "A"}, "", "d", "", None)], cols)
    new = spark.createDataFrame([(1, None, "u", ["a@x.ca", "b@x.ca"], ["1"], {"facebook": "B"}, "9-5", "e", "C", "z"), (0, None, "u", ["old@x.ca"], [], {}, "", "", "", "")], "n int, error string, " + cols)
    r = merge.enrich_records(own, new, "n").first()
    assert (r["emails"], r["socials"], r["hours"], r["description"], r["company"], r["phones"], r["address"]) == (["a@x.ca", "b@x.ca"], {"facebook": "B"}, "9-5", "d", "C", ["1"], "z")


def test_import_record(spark):
    row = dict(title="R", website="https://reliance.example/toronto/", phone="(888) 431-3111", street="145 Front St E Suite L3", city="Ontario", postalCode="M5A 1E3", totalScore="4.7")
    names = ["title", "name", "address", "neighborhood", "street", "postalCode", "city", "website", "url", "phone", "phoneUnformatted", "totalScore", "reviewsCount", "categoryName", "openingHours", "description"]
    df = spark.createDataFrame([tuple(row.get(n) for n in names), tuple("https://www.google.com/maps/x" if n == "url" else None for n in names)], ", ".join(f"{n} string" for n in names))
    a, b = merge.import_record(df).collect()
    assert (a["url"], a["phones"], a["address"], a["google_rating"], a["google_reviews"]) == ("https://reliance.example/toronto/", ["(888) 431-3111"], "145 Front St E Suite L3, Ontario, M5A 1E3", 4.7, None)
    assert b["url"] == "" and b["phones"] == []


def test_validate_emails(spark):
    df = spark.createDataFrame([(1, ["a@ok.ca", "b@bad.ca", "c@unk.ca"]), (2, [])], "k int, emails array<string>")
    v = spark.createDataFrame([("ok.ca", 1), ("bad.ca", 0)], "domain string, valid int")
    a, b = enrich.validate_emails(df, "k", v).orderBy("k").collect()
    assert (a["emails"], a["invalid_emails"]) == (["a@ok.ca", "c@unk.ca"], ["b@bad.ca"]) and b["emails"] == []


def test_fresh(spark):
    df = spark.createDataFrame([(100.0 - catalog.LEAD_TTL,), (99.0 - catalog.LEAD_TTL,)], "scraped_at double")
    assert catalog.fresh(df, "scraped_at", 100.0, catalog.LEAD_TTL).count() == 1


def test_variation_counts(spark):
    kw = spark.createDataFrame([("hvac",), ("plumber",)], "keyword string")
    got = {r["keyword"]: r["n"] for r in expand.variations(kw, expand.trade_terms(spark)).groupBy("keyword").agg(F.count("*").alias("n")).collect()}
    assert got == {"hvac": 182, "plumber": 153}
    assert expand.per_query(50, 1) == 25 and expand.import_concurrency(1000) == 12


def test_runs(spark):
    runs = spark.createDataFrame([("r", "u", "running", 0, 0.0, None)], "run_id string, user_id string, status string, lead_count int, duration_seconds double, error string")
    done = spark.createDataFrame([("r", "done", 7, 1.26, None)], "run_id string, status string, lead_count int, duration_seconds double, error string")
    r = catalog.finish_runs(runs, done).first()
    assert (r["status"], r["lead_count"], r["duration_seconds"]) == ("done", 7, 1.3)


def test_extract_leads_uses_sub_pages(spark):
    pages = spark.createDataFrame([("https://a.ca/", "<title>Acme Co</title><p>call (416) 555-2671</p>", True), ("https://a.ca/contact", "<p>Write to jane.d@acme.ca</p>", False)], "url string, html string, main boolean")
    r = pipeline.extract_leads(pages).first()
    assert (r["company"], r["emails"], r["phones"], r["score"], r["tier"]) == ("Acme Co", ["jane.d@acme.ca"], ["(416) 555-2671"], 5, "warm")


def test_join_hot_equals_join(spark):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)], "k int, v int")
    per = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    a = runtime.join_hot(rows, per, ["k"], "n", 300).select("k", "v", "top")
    assert sorted(a.collect()) == sorted(rows.join(per.drop("n"), "k").select("k", "v", "top").collect())


def test_limited_discovery_is_the_sequential_one(spark):
    rng = random.Random(11)
    plan = [(i, f"q{i}", f"a{i % 3}") for i in range(12)]
    pages = [(f"q{i}", e, "header", "".join(f'<a class="result-header" href="https://h{rng.randrange(90)}.example/{k}">' for k in range(rng.randrange(14))), "") for i in range(12) for e in (0, 1)]
    each, want, seen = max(10, 40 // 6), [], set()
    for i in range(12):
        room = min(each, 40 - len(want))
        for text_, _, _, html, _ in pages:
            for u in re.findall(r'href="([^"]+)"', html) if text_ == f"q{i}" else ():
                host = u.split("/")[2]
                if room > 0 and host not in seen:
                    seen.add(host)
                    want.append(u)
                    room -= 1
    got = pipeline.discover(spark.createDataFrame(plan, "ord long, text string, area string"), spark.createDataFrame(pages, "text string, engine int, kind string, html string, md string"), pipeline.Options(most=40))
    assert [r["url"] for r in got.collect()] == want and len(want) == 40


def test_runs_start_and_finish(spark):
    schema = "run_id string, user_id string, mode string, keyword string, cities string, status string, lead_count int, duration_seconds double, created_at string, finished_at string, grid_spacing_km double, max_results int, error string, backup_filename string"
    jobs = spark.createDataFrame([("r1", "u", "maps", "hvac", [3, 4], None, 1.0, 120, 1700000000.0), ("r2", "u", None, None, [], "Kelport", None, None, 1700000000.5)], "id string, user_id string, mode string, keyword string, city_ids array<int>, city string, grid_spacing_km double, max_results int, created_at double")
    runs = catalog.start_runs(spark.createDataFrame([("r0", "u", "m", "k", "c", "failed", 1, 2.0, "x", None, None, None, "old", None)], schema), jobs)
    got = {r["run_id"]: r for r in runs.collect()}
    assert got["r1"]["cities"] == "[3,4]" and got["r2"]["cities"] == "Kelport" and got["r1"]["status"] == "running" and got["r1"]["created_at"] == "2023-11-14T22:13:20Z" and got["r2"]["mode"] == ""
    upd = spark.createDataFrame([("r0", "completed", 7, 12.345, 1700000060.0, "")], "run_id string, status string, lead_count int, duration_seconds double, finished_at double, error string")
    done = {r["run_id"]: r for r in catalog.finish_runs(runs, upd).collect()}
    assert (done["r0"]["status"], done["r0"]["error"], done["r0"]["duration_seconds"], done["r0"]["finished_at"]) == ("completed", None, 12.3, "2023-11-14T22:14:20Z") and done["r1"]["status"] == "running"


def test_areas_only_for_large_targets(spark):
    cities, near = spark.createDataFrame([("Kelport", 1)], "city string, ord int"), spark.createDataFrame([("kelport", ["North", "South"])], "city string, areas array<string>")
    assert [r["area"] for r in expand.search_areas(cities, near, 50).collect()] == ["Kelport"]
    assert {r["area"] for r in expand.search_areas(cities, near, 51).collect()} == {"North", "South"}
