"""Session helpers: the shared folder, materialised tables and sizes.

Lineage is cut only by writing to the folder that the cluster names in
``spark.checkpoint.dir`` (shared by all executors, so a lost executor loses
nothing). A folder of our own is made only for local sessions where the setting
is absent, as in tests.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that a query's shuffle files go as soon as it ends, not when the driver happens to collect its garbage.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def session(master: str = "local[*]", name: str = "leadloom", **conf) -> SparkSession:
    """A session with the settings that the engine expects; ``conf`` adds to them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return SparkSession.builder.master(master).appName(name).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read and write."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="leadloom-")
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/leadloom/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, gives the planner real sizes and frees the shuffle files."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(FILES_GO, "false")
    spark.sparkContext.setJobDescription(name)
    spark.conf.set(FILES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FILES_GO, before)
    spark.sparkContext.setJobDescription(None)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_paths = [path]
    return out


def scoped(name: str, build, kept: list[DataFrame] | None = None) -> DataFrame:
    """materialize(build()); the tables that build wrote on the way are deleted once the result stands, but for those it put into ``kept``."""
    start = len(_MADE)
    out = materialize(build(), name)
    stay = {p for df in kept or () for p in _paths(df)}
    for made in (going := [m for m in _MADE[start:-1] if m[1] not in stay]):
        drop(*made)
    _MADE[start:-1] = [m for m in _MADE[start:-1] if m not in going]
    return out


def release(df: DataFrame) -> None:
    """Delete the tables that materialize wrote for ``df``, which is not read again."""
    for made in [m for m in _MADE if m[1] in _paths(df)]:
        drop(*made)
        _MADE.remove(made)


def _paths(df: DataFrame) -> set[str]:
    return set(df.__dict__.get("_table_paths", ()))


def tidy(spark: SparkSession) -> None:
    """Between the rounds of a long loop of small queries: what they left in the driver goes (plans, broadcasts), and its heap shrinks again."""
    gc.collect()  # Python's handles hold the JVM's objects
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            drop(spark, path)
        except Exception:  # the session may be gone already
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_tasks(df: DataFrame) -> DataFrame:
    """``df``, a plain scan (files, no shuffle before), ready for a costly step on each row.

    The scan's own splits are used, so nothing is moved. Only where there are fewer of them than cores (then the
    input is small: under one split a core) the rows are spread.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def spread(df: DataFrame, rows_per_task: int) -> DataFrame:
    """Distinct values or other few rows that come from a shuffle, in enough tasks for a costly step; ``df`` is best materialised."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task)))


def join_hot(rows: DataFrame, per_key: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """rows joined to per_key, which has one row a key and in ``size`` the key's number of rows.

    Keys with more than a thousandth of ``total`` rows (so at most 1,000 keys, a proven bound) are broadcast and
    their rows are not shuffled; the others are joined by shuffle.
    """
    hot = per_key.where(F.col(size) * 1000 > total)
    if hot.isEmpty():
        return rows.join(per_key.drop(size), on)
    flag = hot.select(*on, F.lit(True).alias("_hot"))
    tagged = rows.join(F.broadcast(flag), on, "left")
    big = tagged.where("_hot").drop("_hot").join(F.broadcast(hot.drop(size)), on)
    small = tagged.where("_hot is null").drop("_hot").join(per_key.where(F.col(size) * 1000 <= total).drop(size), on)
    return big.unionByName(small)
