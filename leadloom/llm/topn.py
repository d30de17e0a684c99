"""Problem 5: the top N items of every group, by statistics-guided skipping.

``cluster`` writes a slim copy of the table (group, ordering columns, id) range-partitioned and sorted by
(group, score descending), in parquet files of row groups of ``ROW_GROUP_ROWS``. A group of any size spans as many files
as it needs, because the range is over group *and* score, so a hot group never meets in one task. The copy is kept
under a path of the caller's and new batches are clustered beside it (``mode="append"``): the footers tell what is where,
so nothing is sorted again.

``top_n`` reads only the footers first (in tasks), which gives for each row group its first and last group
and its maximum score. Row groups are then read in descending maximum score:

* wave 1 reads those that hold a boundary between groups, and of the row groups with one single group the
  leading ones, until they hold N rows;
* the N-th score per group after wave 1 is the group's bar;
* wave 2 reads the remaining row groups whose maximum is not strictly below the bar of their group.

A row group skipped in wave 2 lies strictly below the N-th score of the only group in it, so no row of it can
be among the first N whatever the ties. Within a task the same rule is applied again, row group by row group.

Defined cases: rows with a null group take no part; a null score or tie column counts as 0; ties are broken by
the tie columns and then by the smaller id, so the order is total; equal rows (same id) rank together
arbitrarily only if they are equal in every ordering column; an empty table gives an empty result; other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom import runtime

ROW_GROUP_ROWS = 100_000
#: Row groups that a task reads, about.
GROUPS_A_TASK = 20


def cluster(df: DataFrame, group: str, score: str, ties: list[tuple[str, bool]], id_col: str, path: str, rows_per_file: int = 2_000_000, row_group_rows: int = ROW_GROUP_ROWS, mode: str = "errorifexists") -> None:
    """Write the slim clustered copy to ``path``, or add a batch to it. ``ties``: (column, descending) in order."""
    slim = df.where(F.col(group).isNotNull()).select(
        F.col(group).cast("string").alias("g"),
        F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"),
        *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * (1 if desc else -1)).alias(f"t{i}") for i, (c, desc) in enumerate(ties)],
        F.col(id_col).cast("long").alias("id"),
    )
    spark = df.sparkSession
    files = max(spark.sparkContext.defaultParallelism, -(-df.count() // rows_per_file))
    order = ["g", F.desc("s"), *[F.desc(f"t{i}") for i in range(len(ties))], "id"]
    (
        slim.repartitionByRange(files, *order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .option("parquet.block.row.count.limit", row_group_rows)
        .parquet(path)
    )


def _open(path: str):
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, inner = pafs.FileSystem.from_uri(path)
    return pq.ParquetFile(fs.open_input_file(inner))


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["path", "rg", "n", "g_lo", "g_hi", "s_max"]
    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            meta = _open(path).metadata
            at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
            for rg in range(meta.num_row_groups):
                m = meta.row_group(rg)
                if not m.num_rows:
                    continue
                gs, ss = m.column(at["g"]).statistics, m.column(at["s"]).statistics
                known = gs is not None and gs.has_min_max and ss is not None and ss.has_min_max
                # without statistics the row group counts as a boundary and is read in wave 1
                rows.append((path, rg, m.num_rows, gs.min if known else "", gs.max if known else "\U0010ffff", ss.max if known else float("inf")))
        yield pd.DataFrame(rows, columns=cols)


def _reader(n: int, ties: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.compute as pc

        keep: dict[str, pa.Table] = {}
        bar: dict[str, float] = {}
        by = [("s", "descending"), *[(f"t{i}", "descending") for i in range(ties)], ("id", "ascending")]
        todo = pd.concat([b for b in batches] or [pd.DataFrame(columns=["path", "rg", "g_lo", "g_hi", "s_max", "bar"])])
        for r in todo.sort_values("s_max", ascending=False).itertuples():
            if r.g_lo == r.g_hi and r.s_max < bar.get(r.g_lo, float("-inf")):
                continue
            t = _open(r.path).read_row_group(r.rg).select(["g", "s", *[f"t{i}" for i in range(ties)], "id"])
            for g in pc.unique(t["g"]).to_pylist():
                part = t.filter(pc.equal(t["g"], g))
                part = pa.concat_tables([keep[g], part]) if g in keep else part
                part = part.take(pc.sort_indices(part, sort_keys=by)[:n]).combine_chunks()
                keep[g] = part
                if part.num_rows >= n:
                    bar[g] = part["s"][n - 1].as_py()
        for part in keep.values():
            yield part.to_pandas()

    return read


def top_n(spark: SparkSession, path: str, n: int, ties: int) -> tuple[DataFrame, DataFrame]:
    """(the first n rows of each group: g, s, t*, id, rank; the row groups with the wave that read them or null)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    slots = spark.sparkContext.defaultParallelism
    stats = runtime.materialize(files.repartition(slots).mapInPandas(_footers, "path string, rg int, n long, g_lo string, g_hi string, s_max double"), "footers")
    # of the row groups with one single group the n highest hold n rows surely: each task keeps n a group before they
    # meet (the filter on the rank), so a group of any number of row groups is no hot window
    by_max = W.partitionBy("g_lo").orderBy(F.desc("s_max"), "path", "rg")
    single = stats.where("g_lo = g_hi")
    high = single.withColumn("place", F.row_number().over(by_max)).where(F.col("place") <= n)
    before = F.sum("n").over(by_max.rowsBetween(W.unboundedPreceding, -1))
    leading = high.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < n).select("path", "rg", F.lit(1).alias("lead"))
    wave = F.when((F.col("g_lo") != F.col("g_hi")) | F.col("lead").isNotNull(), 1)
    planned = runtime.materialize(stats.join(leading, ["path", "rg"], "left").select("path", "rg", "n", "g_lo", "g_hi", "s_max", wave.alias("wave"), F.lit(None).cast("double").alias("bar")), "planned")
    readers = max(slots, -(-planned.count() // GROUPS_A_TASK))
    schema = ", ".join(["g string", "s double", *[f"t{i} double" for i in range(ties)], "id long"])

    def read(part: DataFrame) -> DataFrame:
        return part.select("path", "rg", "g_lo", "g_hi", "s_max", "bar").repartition(readers, "path", "g_lo").mapInPandas(_reader(n, ties), schema)

    order = [F.desc("s"), *[F.desc(f"t{i}") for i in range(ties)], F.asc("id")]

    def best(rows: DataFrame) -> DataFrame:
        # a task gives n rows a group at most, and only the groups of its files: the window is over few rows
        return rows.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(*order))).where(F.col("rank") <= n)

    first = runtime.materialize(best(read(planned.where("wave = 1"))), "wave1")
    bars = first.where(F.col("rank") == n).select(F.col("g").alias("g_lo"), F.col("s").alias("nth"))
    rest = planned.where("wave is null").join(bars, "g_lo", "left").withColumn("wave", F.when(F.col("nth").isNull() | (F.col("s_max") >= F.col("nth")), 2))
    second = read(rest.where("wave = 2").withColumn("bar", F.col("nth")))
    result = best(first.drop("rank").unionByName(second))
    report = planned.where("wave = 1").select("path", "rg", "n", "g_lo", "g_hi", "s_max", "wave").unionByName(rest.select("path", "rg", "n", "g_lo", "g_hi", "s_max", "wave"))
    return result, report


def top_n_per_group(df: DataFrame, group: str, score: str, ties: list[tuple[str, bool]], id_col: str, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Cluster, then read by statistics; see ``top_n`` for what is returned."""
    path = runtime.fresh_path(df.sparkSession, "topn")
    cluster(df, group, score, ties, id_col, path)
    return top_n(df.sparkSession, path, n, len(ties))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = runtime.table(spark, sf_dir, "leads")
    rows, _ = top_n_per_group(leads, "source_city", "score", [("google_reviews", True)], "lead_id", 5)
    return rows.select(F.col("g").alias("source_city"), F.col("id").alias("lead_id"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups of the clustered copy by the wave that read them (0: skipped)."""
    leads = runtime.table(spark, sf_dir, "leads")
    _, report = top_n_per_group(leads, "source_city", "score", [("google_reviews", True)], "lead_id", 5)
    return report.groupBy(F.coalesce("wave", F.lit(0)).alias("wave")).agg(F.count("*").alias("row_groups"), F.sum("n").alias("rows"))


P5_SQL = """
SELECT source_city, lead_id FROM (
  SELECT source_city, lead_id, row_number() OVER (PARTITION BY source_city
    ORDER BY coalesce(score, 0) DESC, coalesce(google_reviews, 0) DESC, lead_id) AS rk
  FROM leads WHERE source_city IS NOT NULL) WHERE rk <= 5
"""
