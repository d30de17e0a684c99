"""Problem 2: copies hidden by formatting, with the number of copies of each record.

Every row gets a canonical text and a 64-bit hash of it (native columns). The hashes are taken in slices of their
range, each with a filter of at most ``SLICE_BITS`` (so a bounded broadcast), as many slices as the rows need: the
false-positive rate is the same at every size. The canonical rows are sorted by hash inside each task, so that a
slice reads its own row groups.

A filter is cut into segments; a hash's bits all lie in one segment. Each task folds its hashes, segment by segment, into
two bit arrays, ``once`` and ``again`` (a hash whose bits all stand in ``once`` already goes to ``again``).
Segments meet by number and are merged pairwise by the rule

    again = again_a | again_b | (once_a & once_b),   once = once_a | once_b

so every hash seen twice anywhere has all its bits in ``again``. That array is probed by every row of the slice: rows
that fail are proven singletons and are never shuffled, the others are grouped exactly by the canonical text. So the
result is exact, whatever the filter lets through.

Hot keys: a group is aggregated with map-side combine, never collected. Where members are joined to their
group, keys that hold more than a thousandth of the rows (at most 1,000 of them, a proven bound) are broadcast.

Defined cases: null and blank fields are equal; null lists, empty lists and lists of blanks are equal; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import runtime
from leadloom.llm import keys

HASHES = 4
BITS_PER_KEY = 12
SEGMENT_BITS = 1 << 20
SLICE_BITS = 1 << 27


def canonical(company: str = "company", url: str = "url", phones: str = "phones", emails: str = "emails") -> Column:
    return F.concat_ws("\x1f", keys.alnum(F.col(company)), keys.url(F.col(url)), F.array_join(keys.entries(F.col(phones), keys.phone), "\x1e"), F.array_join(keys.entries(F.col(emails), keys.alnum), "\x1e"))


def filter_bits(rows: int) -> int:
    """Bits for ``rows`` keys, in whole segments."""
    return SEGMENT_BITS * max(1, -(-rows * BITS_PER_KEY // SEGMENT_BITS))


def slices(rows: int) -> list[tuple[int, int]]:
    """Ranges (from, to) of the 64-bit hashes, so many that a filter of SLICE_BITS holds each."""
    k = max(1, -(-rows * BITS_PER_KEY // SLICE_BITS))
    cuts = [(i << 64) // k - (1 << 63) for i in range(k + 1)]
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:])]


def _segments(h: np.ndarray, bits: int) -> np.ndarray:
    """The segment of each hash."""
    return (((h.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) % np.uint64(bits // SEGMENT_BITS)).astype(np.int64)


def _inside(h: np.ndarray) -> np.ndarray:
    """HASHES bit positions of each hash inside its segment, by double hashing."""
    u = h.view(np.uint64)
    a, b = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    return np.stack([((a + np.uint64(i) * b) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(SEGMENT_BITS - 1) for i in range(HASHES)], 1).astype(np.int64)


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """The same positions in the whole filter."""
    return _segments(h, bits)[:, None] * SEGMENT_BITS + _inside(h)


def _partial(bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]  # 8 bytes a row of the task
        if not sum(map(len, parts)):
            return
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        seg = _segments(h, bits)
        order = np.argsort(seg, kind="stable")
        own, starts = np.unique(seg[order], return_index=True)
        for s, at in zip(own.tolist(), np.split(order, starts[1:])):
            pos = _inside(h[at])
            once, again = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
            again[pos[n[at] > 1].ravel()] = True
            once[pos.ravel()] = True
            yield pa.RecordBatch.from_pydict({"seg": pa.array([s], pa.int32()), "once": [zlib.compress(np.packbits(once).tobytes(), 1)], "again": [zlib.compress(np.packbits(again).tobytes(), 1)]})

    return build


def _merge_group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once = again = np.zeros(SEGMENT_BITS // 8, np.uint8)
    for b in batches:
        for o, a in zip(b.column("once").to_pylist(), b.column("again").to_pylist()):
            o, a = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, a))
            again = again | a | (once & o)
            once = once | o
    yield pa.RecordBatch.from_pydict({"seg": pa.array([key[0].as_py()], pa.int32()), "once": [zlib.compress(once.tobytes(), 1)], "again": [zlib.compress(again.tobytes(), 1)]})


def repeat_filter(hashes: DataFrame, bits: int, fan_in: int = 64) -> np.ndarray:
    """The merged ``again`` bits. Partial arrays meet in a tree of ``fan_in``, so no task reads them all."""
    schema = "seg int, once binary, again binary"
    parts = hashes.mapInArrow(_partial(bits), schema)
    left = -(-hashes.rdd.getNumPartitions() // fan_in)
    if left > 1:
        parts = parts.withColumn("k", F.pmod(F.spark_partition_id(), F.lit(left))).groupBy("seg", "k").applyInArrow(_merge_group, schema)
    merged = parts.groupBy("seg").applyInArrow(_merge_group, schema)
    again = np.zeros(bits // 8, np.uint8)
    for r in merged.select("seg", "again").toLocalIterator():  # bits / SEGMENT_BITS rows, SLICE_BITS in all at most
        again[r.seg * SEGMENT_BITS // 8 : (r.seg + 1) * SEGMENT_BITS // 8] = np.frombuffer(zlib.decompress(bytes(r.again)), np.uint8)
    return again


def _probe(filter_var, bits: int, names: list[str]):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(filter_var.value, np.uint8)
        for b in batches:
            h = b.column(names.index("h")).to_numpy(zero_copy_only=False)
            if not len(h):
                continue
            pos = _positions(h, bits)
            hit = ((packed[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1).all(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], names=[*names, "maybe"])

    return probe


def group_copies(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """One row per input row: id, first (smallest id of its copies), copies (their number)."""
    spark = df.sparkSession
    canonical_rows = df.select(F.col(id_col).cast("long").alias("id"), key.alias("k")).withColumn("h", F.xxhash64("k"))
    n = df.count()
    ranges = slices(n)
    if len(ranges) > 1:
        canonical_rows = canonical_rows.sortWithinPartitions("h")
    rows = runtime.materialize(canonical_rows, "canonical")
    bits = filter_bits(-(-n // len(ranges)))
    marked = None
    for lo, hi in ranges:
        own = rows.where(F.col("h").between(lo, hi)) if len(ranges) > 1 else rows
        again = spark.sparkContext.broadcast(repeat_filter(own.select("h"), bits).tobytes())
        part = own.select("id", "k", "h").mapInArrow(_probe(again, bits, ["id", "k", "h"]), "id long, k string, h long, maybe boolean")
        marked = part if marked is None else marked.unionByName(part)
    marked = runtime.materialize(marked.select("id", "maybe", F.when(F.col("maybe"), F.col("k")).alias("k")), "marked")
    maybe = marked.where("maybe").select("id", "k")
    groups = runtime.materialize(maybe.groupBy("k").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "groups")
    hot = groups.where(F.col("copies") * 1000 > n).select("k", F.lit(True).alias("hot"))
    tagged = maybe.join(F.broadcast(hot), "k", "left")
    big = tagged.where("hot").drop("hot").join(F.broadcast(groups.join(F.broadcast(hot), "k", "left_semi")), "k")
    small = tagged.where("hot is null").drop("hot").join(groups, "k")
    single = marked.where("not maybe").select("id", F.col("id").alias("first"), F.lit(1).cast("long").alias("copies"))
    return single.unionByName(big.select("id", "first", "copies")).unionByName(small.select("id", "first", "copies"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = runtime.table(spark, sf_dir, "leads").where("error is null")
    found = group_copies(leads, canonical(), "lead_id")
    return found.where("id <> first").select(F.col("first").alias("first_lead_id"), F.col("id").alias("lead_id"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct record once, with its number of copies."""
    leads = runtime.table(spark, sf_dir, "leads").where("error is null")
    return group_copies(leads, canonical(), "lead_id").where("id = first").select(F.col("id").alias("lead_id"), "copies")


_CANON_SQL = r"""
WITH a AS (SELECT lead_id, regexp_replace(lower(coalesce(company, '')), '[^\p{L}\p{N}]+', '', 'g') AS c,
    regexp_replace(regexp_replace(lower(regexp_replace(coalesce(url, ''), '[\s\p{Z}]+', '', 'g')), '^[a-z][a-z0-9+.-]*://', ''), '#.*$', '') AS u,
    coalesce(phones, []) AS phones, coalesce(emails, []) AS emails
  FROM leads WHERE error IS NULL),
b AS (SELECT lead_id, c,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(u, '^([^/?]*)', 1), '^.*@', ''), ':(80|443)?$', ''), '^www\.', ''), '[^\p{L}\p{N}]+', '', 'g') AS host,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '[^\p{L}\p{N}]+', '', 'g') AS path,
    list_sort(list_filter(list_transform(regexp_split_to_array(regexp_extract(u, '\?(.*)$', 1), '[&;]'), lambda x: regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> '')) AS q,
    list_sort(list_distinct(list_filter(list_transform(phones, lambda p: CASE
      WHEN length(regexp_replace(p, '[^0-9]+', '', 'g')) = 10 THEN regexp_replace(p, '[^0-9]+', '', 'g')
      WHEN length(regexp_replace(p, '[^0-9]+', '', 'g')) = 11 AND regexp_replace(p, '[^0-9]+', '', 'g') LIKE '1%' THEN substr(regexp_replace(p, '[^0-9]+', '', 'g'), 2)
      ELSE regexp_replace(lower(p), '[^\p{L}\p{N}]+', '', 'g') END), lambda x: x <> ''))) AS p,
    list_sort(list_distinct(list_filter(list_transform(emails, lambda e: regexp_replace(lower(e), '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> ''))) AS e
  FROM a),
g AS (SELECT lead_id, min(lead_id) OVER w AS first_lead_id, count(*) OVER w AS copies FROM b WINDOW w AS (PARTITION BY c, host, path, q, p, e))
"""
P2_SQL = _CANON_SQL + "SELECT first_lead_id, lead_id FROM g WHERE lead_id <> first_lead_id"
P2_COUNTS_SQL = _CANON_SQL + "SELECT lead_id, copies FROM g WHERE lead_id = first_lead_id"
