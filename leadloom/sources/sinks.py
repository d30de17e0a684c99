"""Writers of leads: CSV in three shapes, JSON, backups, and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import display

CLI = ["tier", "score", "url", "company", "description", "emails", "phones", "address", "hours", "socials", "google_reviews", "google_rating"]
WEB = [
    "tier", "score", "url", "company", "description", "emails", "phones", "address", "city", "state", "zip_code", "hours",
    "socials", "category", "rating", "neighborhood", "google_reviews", "google_rating", "review_distribution",
    "homestars_rating", "homestars_reviews", "homestars_url", "homestars_verified", "price_level", "maps_url", "latitude",
    "longitude", "place_id", "plus_code", "is_closed", "source_city",
]
DESKTOP = ["url", "company", "description", "emails", "phones", "address", "socials", "tier"]
NODE = ["company", "url", "emails", "phones", "address", "category", "score", "tier"]


def flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as text: lists joined with '; ', maps as JSON, nulls as ''; columns that df lacks are ''."""
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        if c == "is_closed":
            closed = [F.coalesce(F.col(x), F.lit(False)) for x in ("is_temporarily_closed", "is_permanently_closed") if x in kinds]
            return F.when(closed[0] | closed[1], "Yes").otherwise("").alias(c) if len(closed) == 2 else F.lit("").alias(c)
        if c not in kinds:
            return F.lit("").alias(c)
        col = F.col(c)
        if kinds[c].startswith("array"):
            col = F.array_join(col, "; ")
        elif kinds[c].startswith("map"):
            empty = F.create_map().cast(kinds[c])
            col = F.to_json(F.coalesce(col, empty)) if c == "socials" else F.when(F.size(col) > 0, F.to_json(col))
        elif kinds[c] == "boolean":
            col = F.when(col, "Yes")
        return F.coalesce(col.cast("string"), F.lit("")).alias(c)

    return df.select(*[one(c) for c in columns])


def export(df: DataFrame, shape: str = "web") -> DataFrame:
    """Rows of a CSV export. 'cli' writes error leads too; 'web' and 'desktop' leave them out."""
    columns = {"cli": CLI, "web": WEB, "desktop": DESKTOP}[shape]
    return flat(df if shape == "cli" else df.where("error is null"), columns)


def write_csv(df: DataFrame, path: str, shape: str = "web") -> None:
    export(df, shape).write.option("header", True).option("escape", '"').mode("error").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; error leads are kept."""
    df.write.json(path)


def backup_name(created_at: Column, job_id: Column, mode: Column, label: Column) -> Column:
    stamp = F.date_format(F.timestamp_seconds(created_at), "yyyyMMdd-HHmmss")
    return F.concat(F.concat_ws("_", stamp, job_id, mode, display.safe_label(label)), F.lit(".json"))


def backup(leads: DataFrame, folder: str, name: str, envelope: dict) -> bool:
    """Write a job's envelope with its leads as one JSON document; nothing for no leads. A job's leads are one response, so bounded."""
    n = leads.count()
    if not n:
        return False
    rows = leads.agg(F.collect_list(F.struct(*leads.columns)).alias("leads"))
    head = [F.lit(v).alias(k) for k, v in envelope.items()]
    rows.select(*head, F.lit(n).alias("lead_count"), "leads").coalesce(1).write.json(f"{folder.rstrip('/')}/{name}")
    return True


def node_items(leads: DataFrame, job_id: str) -> DataFrame:
    """Items for a workflow: leads without error, eight fields and the job; one item that says so if there are no leads at all."""
    none = leads.limit(1).agg(F.count("*").alias("n")).where("n = 0")
    items = leads.where("error is null").select(*NODE, F.lit(job_id).alias("_jobId"), F.lit(None).cast("string").alias("message"))
    kinds = dict(items.dtypes)
    sentinel = none.select(*[F.lit(None).cast(kinds[c]).alias(c) for c in NODE], F.lit(job_id).alias("_jobId"), F.lit("no leads found").alias("message"))
    return items.unionByName(sentinel)


def workflow_rows(jobs: DataFrame) -> DataFrame:
    """Leads of job results (column leads) as flat rows."""
    one = jobs.select(F.explode("leads").alias("l")).select("l.*")
    return flat(one, ["company", "url", "emails", "phones", "address", "category", "socials", "score", "tier"])


def distinct_emails(df: DataFrame) -> DataFrame:
    """Every address once, sorted."""
    return df.select(F.explode("emails").alias("email")).distinct().orderBy("email")


def report(df: DataFrame, most: int = 100) -> str:
    """A report for people over the first ``most`` leads, which is its feature."""
    lines = []
    for i, r in enumerate(df.limit(most).collect(), 1):
        r = r.asDict()
        lines.append("=" * 60)
        if r.get("error"):
            lines.append(f"#{i}  {r['url']}\n  ERROR: {r['error']}")
            continue
        lines.append(f"#{i}  {r['url']}   [{(r.get('tier') or '').upper()} · score={r.get('score')}]")
        for label, value in (("Company", r.get("company")), ("Description", r.get("description")), ("Emails", ", ".join(r.get("emails") or [])), ("Phones", ", ".join(r.get("phones") or [])), ("Address", r.get("address")), ("Hours", r.get("hours")), ("Reviews", r.get("google_reviews"))):
            if value not in (None, ""):
                lines.append(f"  {label + ':':<12} {value}")
        lines += [f"  {k:<12} {v}" for k, v in (r.get("socials") or {}).items()]
    return "\n".join(lines)
