import json

from pyspark.sql import functions as F

from leadloom.sources import readers, sinks
from leadloom.streaming import jobs


def test_url_list(spark, tmp_path):
    (tmp_path / "u.txt").write_text(" a.com \n#x\n\n #y\n")
    assert [r["url"] for r in readers.url_list(spark, str(tmp_path / "u.txt")).collect()] == ["a.com", "#y"]
    assert readers.url_list(spark, "acme.ca").first()["url"] == "https://acme.ca"


def test_records(spark, tmp_path):
    for i, x in enumerate([{"records": [{"title": "A", "website": "a.ca"}]}, [{"title": "B"}, {"title": "C", "url": "c.ca"}], {"title": "D", "url": "d.ca"}, {"title": "E"}, 5]):
        (tmp_path / f"{i}.json").write_text(json.dumps(x))
    (tmp_path / "bad.json").write_text("{no")
    df = readers.records(spark, str(tmp_path))
    assert sorted(r["title"] for r in df.collect()) == ["A", "B", "C", "D"]
    assert tuple(readers.import_stats(df).first()) == (4, 3)


def _leads(spark):
    rows = [("u1", "A", ["b@x.ca", "a@x.ca"], {"facebook": "f"}, None, True), ("u2", "B", None, None, "timeout", None)]
    return readers.conform(spark.createDataFrame(rows, "url string, company string, emails array<string>, socials map<string,string>, error string, is_temporarily_closed boolean"))


def test_exports(spark, tmp_path):
    leads = _leads(spark)
    r = sinks.export(leads).collect()
    assert len(r) == 1 and (r[0]["emails"], r[0]["socials"], r[0]["is_closed"], r[0]["score"]) == ("b@x.ca; a@x.ca", '{"facebook":"f"}', "Yes", "")
    assert len(sinks.export(leads).columns) == 31 and sinks.export(leads, "cli").count() == 2
    sinks.write_csv(leads, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1
    sinks.write_json(leads, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert "ERROR: timeout" in sinks.report(leads)
    assert [r["email"] for r in sinks.distinct_emails(leads.unionByName(leads)).collect()] == ["a@x.ca", "b@x.ca"]


def test_node_items(spark):
    leads = _leads(spark)
    assert sinks.node_items(leads, "j").count() == 1
    assert sinks.node_items(leads.where("error is not null"), "j").count() == 0
    assert sinks.node_items(leads.limit(0), "j").first()["message"] == "no leads found"


def test_backup_round_trip(spark, tmp_path):
    assert sinks.backup(_leads(spark), str(tmp_path), "20250101-000000_j1_maps_x.json", {"job_id": "j1", "status": "done"})
    assert not sinks.backup(_leads(spark).limit(0), str(tmp_path), "none.json", {"job_id": "j2"})
    (tmp_path / "bad.json").write_text("{broken")
    b = readers.backups(spark, str(tmp_path) + "/*")
    assert [r["url"] for r in readers.backup_leads(b, "j1").orderBy("ord").collect()] == ["u1", "u2"]
    assert readers.safe_name("a.json") and not readers.safe_name("../a.json")
    name = spark.range(1).select(sinks.backup_name(F.lit(0.0), F.lit("j"), F.lit("maps"), F.lit("a b")).alias("n")).first()["n"]
    assert name == "19700101-000000_j_maps_a_b.json"


def test_job_states(spark, tmp_path):
    spark.createDataFrame([("a", "pending", 1.0), ("a", "scraping", 2.0), ("a", "scraping", 3.0), ("a", "done", 4.0), ("a", "scraping", 5.0)], "job_id string, status string, time double").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("job_id string, status string, time double").parquet(str(tmp_path / "e"))
    got = jobs.run_to_memory(jobs.job_states(stream), "states")
    assert [r["status"] for r in got.orderBy("time").collect()] == ["pending", "scraping", "done"]


def test_stream_upsert_and_first_seen(spark, tmp_path):
    rows = [("https://www.a.ca/1", "p1", 1.0, None), ("https://a.ca/2", "p2", 2.0, None), ("https://b.ca/", "p3", 3.0, "timeout")]
    spark.createDataFrame(rows, "url string, payload string, scraped_at double, error string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, payload string, scraped_at double, error string").parquet(str(tmp_path / "in"))
    jobs.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "scraped_at").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "0")).select("domain", "payload").collect()] == [("a.ca", "p2")]
    seen = stream.select(F.lit("d").alias("domain"), F.timestamp_seconds("scraped_at").alias("scraped_at"))
    assert jobs.run_to_memory(jobs.first_seen(seen), "seen").count() == 1
