import pytest

import __spark_entry__ as entry
from leadloom import runtime
from leadloom.operators import pipeline
from leadloom.plans.queries import QUERIES, SQL

from .oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["place", "lead_id", "company", "score", "tier"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name, rows", [("sub_page_emails", "error is null and company is not null"), ("deep_crawl_phones", "error is null")])
def test_crawl_reads_all_leads(spark, monkeypatch, name, rows):
    given, extract = [], pipeline.extract_leads
    monkeypatch.setattr(pipeline, "extract_leads", lambda pages, *a, **kw: given.append(pages) or extract(pages, *a, **kw))
    QUERIES[name](spark, DATA)
    assert given[0].where("main").count() == runtime.table(spark, DATA, "leads").where(rows).count()
