"""Splitting addresses by the validity of their mail domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions import urls


def validate_emails(df: DataFrame, key: str, validity: DataFrame, emails: str = "emails") -> DataFrame:
    """df with ``emails`` cut to valid domains and ``invalid_emails`` (null if none); domains without an answer are valid.

    validity: domain, valid. Each domain is looked up once, before the join back.
    """
    each = df.select(key, F.posexplode(emails).alias("pos", "email")).withColumn("domain", urls.email_domain(F.col("email")))
    known = validity.select(F.lower("domain").alias("domain"), F.col("valid").cast("boolean").alias("valid")).groupBy("domain").agg(F.max("valid").alias("valid"))
    marked = each.join(known, "domain", "left").withColumn("ok", F.coalesce("valid", F.lit(True)))
    ordered = lambda ok: F.transform(F.array_sort(F.collect_list(F.when(F.col("ok") == ok, F.struct("pos", "email")))), lambda x: x["email"])
    # a lead's own addresses: few; the lists are per lead, never per domain
    per = marked.groupBy(key).agg(ordered(True).alias("_good"), ordered(False).alias("_bad"))
    out = df.join(per, key, "left")
    return out.withColumns({emails: F.coalesce("_good", emails), "invalid_emails": F.when(F.size("_bad") > 0, F.col("_bad"))}).drop("_good", "_bad")
