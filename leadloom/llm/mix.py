"""Problem 9: mixing sources to target weights by pivotal dependent rounding.

Sizes are token counts. For each mix the weights are made to sum to 1 over all its sources; the total is the
largest at which every source that has documents can give its share within its repeats (or a total given).
A source's documents all get the same fractional number of copies, x = share * total / tokens of the source.
Whole copies are certain; the fractions are rounded by the pivotal method with sizes: two partners exchange
*tokens* (p_i * size_i + p_j * size_j stays) at random until one fraction is 0 or 1, with odds that keep every
document's expected copies at x. Inside a task the documents of a mix and source are paired from the largest to the
smallest, so what is left at the end is small. Each task leaves one fractional document for each mix and source; the
residuals of ``FAN`` neighbouring tasks are paired in the next level of a reduction tree, those of ``FAN`` neighbouring
groups in the level after that, until one is left, which is drawn. So the tokens of a source miss its target by
less than one document, for any number of documents, and no task holds more than ``ROWS_PER_TASK`` rows (documents
times mixes), or ``FAN`` residuals a mix and source.

Randomness is a hash of (seed, mix, document): a re-run of a lost task makes the same choices.

Defined cases: a source of a mix without documents gets 0 and is reported; documents with null source, null or
empty text, or a source in no mix are never chosen; repeated target rows of a source add their weights and
keep the smallest max_repeats; weights that are null, negative or 0 count as 0; an empty table gives an empty
selection and a report of zeros; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom import runtime
from leadloom.llm import tokens

SEED = 20240
MAX_TARGETS = 10_000
#: Documents times mixes that one task rounds, about; residuals that meet in a node of the tree.
ROWS_PER_TASK = 40_000
FAN = 4


def pivotal(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Round fractions p with sizes until one is left. Returns 0/1 for each, -1 for the one left; its place or -1. u: a draw for each place; p of the one left is put into ``p``."""
    out = np.zeros(len(p), np.int64)
    hold = -1
    for j in range(len(p)):
        if p[j] < 1e-12 or p[j] > 1 - 1e-12:
            out[j] = int(p[j] > 0.5)
            continue
        if hold < 0:
            hold = j
            continue
        i = hold
        a, b = p[i] * size[i], p[j] * size[j]
        up_i = min((1 - p[i]) * size[i], b)  # tokens that j can give to i
        up_j = min((1 - p[j]) * size[j], a)  # tokens that i can give to j
        give = up_i if u[j] < up_j / (up_i + up_j) else -up_j
        pi, pj = p[i] + give / size[i], p[j] - give / size[j]
        hold = -1
        for k, q in ((i, pi), (j, pj)):
            if q < 1e-9 or q > 1 - 1e-9:
                out[k] = int(q > 0.5)
            else:
                p[k], hold = q, k
    if hold >= 0:
        out[hold] = -1
    return out, hold


def _round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Round the rows of each (node, mix_name, source); one row of each may stay undecided (taken = -1)."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    for _, g in pd.concat(parts).groupby(["node", "mix_name", "source"], sort=True):
        g = g.sort_values(["n", "u", "id"], ascending=[False, True, True])
        p = g["p"].to_numpy(float, copy=True)
        taken, _ = pivotal(p, g["n"].to_numpy(float), g["u"].to_numpy(float))
        yield g.assign(taken=taken, p=p)[["node", "mix_name", "source", "id", "n", "p", "u", "whole", "taken"]]


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row per mix and source: share, max_repeats, tokens, docs, total, x. Small: one row a target."""
    spark = sizes.sparkSession
    if targets.limit(MAX_TARGETS + 1).count() > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target rows")
    per = targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).alias("weight"), F.min("max_repeats").alias("max_repeats"))
    have = sizes.where("n > 0").groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    # AQE would do as well; the hint is safe because the targets were counted
    p = have.join(F.broadcast(per), "source", "right").select("mix_name", "source", "weight", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"))
    mix = W.partitionBy("mix_name")
    p = p.withColumn("share", F.col("weight") / F.greatest(F.sum("weight").over(mix), F.lit(1e-300)))
    most = F.min(F.when((F.col("tokens") > 0) & (F.col("share") > 0), F.col("max_repeats") * F.col("tokens") / F.col("share"))).over(mix)
    p = p.withColumn("total", F.coalesce(F.lit(total).cast("double") if total else most, F.lit(0.0)))
    x = F.when((F.col("tokens") > 0) & (F.col("share") > 0), F.least(F.col("share") * F.col("total") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return runtime.materialize(p.withColumn("x", x), "mixplan")


def select_mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(mix_name, source, id, n, copies) of the chosen documents; the report of shares. sizes: id, source, n."""
    p = plan(sizes, targets, total)
    pairs = p.agg(F.coalesce(F.sum(F.when(F.col("x") > 0, F.col("docs"))), F.lit(0))).first()[0]
    tasks = max(1, -(-pairs // ROWS_PER_TASK))
    draw = F.xxhash64(F.lit(seed), "mix_name", "id")
    rows = sizes.where("n > 0").withColumn("node", F.pmod(F.xxhash64("id"), F.lit(tasks))).repartition(tasks, "node")
    rows = rows.join(F.broadcast(p.where("x > 0").select("mix_name", "source", "x")), "source")
    rows = rows.select("node", "mix_name", "source", "id", "n", (F.col("x") - F.floor("x")).alias("p"), (F.shiftrightunsigned(draw, 11) / F.lit(float(1 << 53))).alias("u"), F.floor("x").cast("long").alias("whole"))
    schema = "node long, mix_name string, source string, id long, n long, p double, u double, whole long, taken long"
    done = runtime.materialize(rows.mapInPandas(_round, schema), "rounded")
    settled, left = [done.where("taken >= 0")], done.where("taken < 0").drop("taken")
    nodes = tasks
    while nodes > 1:  # one residual for each node, mix and source: FAN neighbouring nodes meet
        nodes = -(-nodes // FAN)
        up = left.withColumn("node", F.floor(F.col("node") / FAN))
        step = runtime.materialize(up.repartition(max(1, nodes // 64), "node").mapInPandas(_round, schema), "residuals")
        settled.append(step.where("taken >= 0"))
        left = step.where("taken < 0").drop("taken")
    settled.append(left.withColumn("taken", (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "mix_name", "id"), 11) / F.lit(float(1 << 53)) < F.col("p")).cast("long")))
    chosen = settled[0].select("mix_name", "source", "id", "n", "whole", "taken")
    for s in settled[1:]:
        chosen = chosen.unionByName(s.select("mix_name", "source", "id", "n", "whole", "taken"))
    chosen = chosen.select("mix_name", "source", "id", "n", (F.col("whole") + F.col("taken")).alias("copies")).where("copies > 0")
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("n") * F.col("copies")).alias("mixed_tokens"), F.count("*").alias("docs_used"), F.max("copies").alias("most_copies"))
    report = p.join(F.broadcast(got), ["mix_name", "source"], "left").fillna(0, ["mixed_tokens", "docs_used", "most_copies"])
    reached = F.sum("mixed_tokens").over(W.partitionBy("mix_name"))
    report = report.select("mix_name", "source", F.col("share").alias("target_share"), F.when(reached > 0, F.col("mixed_tokens") / reached).otherwise(0.0).alias("actual_share"), "max_repeats", "most_copies", "tokens", "mixed_tokens", "docs", "docs_used")
    return chosen, report


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    return runtime.materialize(tokens.counted(docs.where("source is not null"), "doc_id", "text", ["source"]).withColumnRenamed("n_tokens", "n"), "sizes")


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, _ = select_mix(_sizes(spark, sf_dir), runtime.table(spark, sf_dir, "mix_targets"))
    return chosen.select("mix_name", "source", F.col("id").alias("doc_id"), F.col("n").alias("n_tokens"), "copies")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_mix(_sizes(spark, sf_dir), runtime.table(spark, sf_dir, "mix_targets"))[1]
