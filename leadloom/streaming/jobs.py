"""Streams: progress of jobs, fresh leads with a time to live, windowed event counts, and batch upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leadloom import runtime
from leadloom.operators import catalog

TERMINAL = ("done", "error", "cancelled")


def event_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind; works on streams (late rows dropped behind the watermark) and on tables."""
    own = dict(events.dtypes)[time]  # watermarks need a timestamp with zone; the result has the zone of the input
    df = events.withColumn(time, F.col(time).cast("timestamp"))
    df = df.withWatermark(time, late) if events.isStreaming else df
    return df.groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("events")).select(F.col("w.start").cast(own).alias("window_start"), kind, "events")


def latest_status(events: DataFrame) -> DataFrame:
    """job_id -> the status of its latest event (time, then order)."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("time", "status")).alias("status"), F.max("time").alias("time"))


def job_states(events: DataFrame) -> DataFrame:
    """A stream of status changes per job (job_id, status, time); a job that ended takes no more events."""

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else ("", -1.0)
        out = []
        for r in pd.concat(list(batches)).sort_values("time").itertuples():
            if last in TERMINAL or r.time < at:
                continue
            if r.status != last:
                out.append((key[0], r.status, float(r.time)))
            last, at = r.status, float(r.time)
        state.update((last, at))
        yield pd.DataFrame(out, columns=["job_id", "status", "time"])

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id string, status string, time double", "status string, at double", "append", GroupStateTimeout.NoTimeout)


def first_seen(leads: DataFrame, time: str = "scraped_at", ttl: str = "30 days") -> DataFrame:
    """Leads whose domain was not seen within the time to live."""
    return leads.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, ttl).dropDuplicatesWithinWatermark(["domain"])


def upsert_stream(leads: DataFrame, path: str, checkpoint: str, order: str) -> StreamingQuery:
    """Keep the last lead of each domain in versions under ``path``: every batch writes the next version, named by its number, so a repeated batch gives the same."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        schema = "domain string, url string, payload string, scraped_at double"
        old = spark.read.schema(schema).parquet(f"{path}/{epoch - 1}") if epoch else spark.createDataFrame([], schema)
        catalog.upsert(old, batch, order).write.mode("overwrite").parquet(f"{path}/{epoch}")

    return leads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is available and give its result as a table."""
    spark = df.sparkSession
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", runtime.fresh_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
