"""Problem 6: new batches against all accepted history, by multi-key sorted-neighbourhood runs.

Every record gives entries under several keys: P (its place identifier), W (its host and each parent domain), N (phone and
company, with the website beside it, for slightly misspelt domains) and D (for each domain a hash of the place, company
and phone seen under it, with counts). The history is kept as *runs* under a path of the caller's: files sorted by
key, cut into key ranges, each entry once however many records have it, and a manifest with the ranges of each run. It
can be opened again in a later session (``History``).

For a batch: its entries are first aggregated to one row a key; only the key ranges they touch are read from the runs.
The D entries of the batch's domains, of history and batch together, say which of them several businesses share
(``shared_domains``); a record's website is the highest domain of its host that is not shared. So only what is known when
the batch comes is used. Then, range by range, the sorted batch is merged into the sorted runs and each new entry is
compared with the window around its place, which reaches over all neighbours of an equal key (so nothing is cut off): an
equal place or website is known; so is a website ``edits`` away under equal phone and company. As W entries
hold every parent domain, a website is found whatever was thought shared when the entry was written.

The entries not seen before are appended as a run of level 0. When a level has more than ``COMPACT_EVERY`` runs, they are
merged into one of the next level, with new ranges of about ``RANGE_ROWS`` entries: an entry is rewritten O(log n)
times, and a task's share does not grow with the history.

A domain is shared if its records name many places, or many companies with many phones, relative to their number:
hosting platforms, directories, brands with a page for each branch, public suffixes.

Defined cases: unreadable payloads give their domain only; blank and null fields give no entry, and a record
without any key is new; hosts without a dot are no website; repeated rows count as records; hot keys are
aggregated before any shuffle and joined back by broadcast; keys over ``LONGEST`` characters are compared by their
beginning and a hash; an empty batch table gives an empty result.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import runtime
from leadloom.llm import keys
from leadloom.llm.address import within

COMPACT_EVERY = 4
RANGE_ROWS = 100_000
LONGEST = 160
#: A domain is shared from so many businesses on, if they are this share of its records.
SHARED_FROM, SHARED_RATIO = 3, 0.3
ENTRY = "kind string, key string, site string, n long"


def edits(site: str) -> int:
    """Edits between a domain and its misspelling."""
    return 2 if len(site) >= 8 else 1


def place_key(c: Column) -> Column:
    """The identifier inside its spellings; case kept; '' if blank."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    inner = F.regexp_extract(t, r"(ChIJ[0-9A-Za-z_\-]+)", 1)
    return F.when(inner != "", inner).otherwise(t)


def host(domain: Column, url: Column) -> Column:
    """Host of the domain field, else of the URL: no scheme, www., port, path; '' if none."""
    both = [F.regexp_replace(F.regexp_replace(keys.url_parts(c)[0], r":\d+$", ""), r"\.+$", "") for c in (domain, url)]
    return F.when(both[0] != "", both[0]).otherwise(both[1])


def ancestors(h: Column) -> Column:
    """The host and its parent domains of at least two labels, highest first."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    return F.when(n < 2, F.array().cast("array<string>")).when(n == 2, F.array(h)).otherwise(F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), ".")))


def company_key(c: Column) -> Column:
    return F.regexp_replace(keys.alnum(c), r"^the(?=.{4})", "")


def normalized(df: DataFrame, id_col: Column, place: Column, domain: Column, url: Column, company: Column, phones: Column, *more: Column) -> DataFrame:
    return df.select(*more, id_col.cast("long").alias("id"), place_key(place).alias("place"), host(domain, url).alias("host"), company_key(company).alias("company"), keys.usable_phones(phones).alias("phones"))


def evidence(records: DataFrame) -> DataFrame:
    """D entries of normalised records: (kind, key: domain, site: what was seen, n: how often). Aggregated with map-side combine."""
    tag = lambda k, c: F.when(c.isNotNull(), F.concat(F.lit(k), F.xxhash64(c)))
    seen = F.array(tag("p", F.nullif("place", F.lit(""))), tag("c", F.nullif("company", F.lit(""))), tag("t", F.try_element_at("phones", F.lit(1))))
    under = records.where("host <> ''").select(F.explode(ancestors(F.col("host"))).alias("key"), seen.alias("seen"))
    return under.select("key", F.explode("seen").alias("site")).where("site is not null").groupBy("key", "site").agg(F.count("*").alias("n")).select(F.lit("D").alias("kind"), "key", "site", "n")


def shared_of(evident: DataFrame) -> DataFrame:
    """Domains under which several businesses keep pages, from D entries (an entry may come in several parts)."""
    per = evident.groupBy("key", "site").agg(F.sum("n").alias("n"))
    k = F.substring("site", 1, 1)
    sums = [x for c, many, n in (("p", "places", "n_p"), ("c", "companies", "n_c"), ("t", "phones", "n_t")) for x in (F.count_if(k == c).alias(many), F.coalesce(F.sum(F.when(k == c, F.col("n"))), F.lit(0)).alias(n))]
    per = per.groupBy("key").agg(*sums)
    by_place = (F.col("places") >= SHARED_FROM) & (F.col("places") >= SHARED_RATIO * F.col("n_p"))
    by_name = (F.least("companies", "phones") > SHARED_FROM) & (F.least("companies", "phones") >= SHARED_RATIO * F.col("n_c"))
    return per.where(by_place | by_name).select(F.col("key").alias("domain"))


def shared_domains(records: DataFrame) -> DataFrame:
    """Shared domains of one table of normalised records."""
    return shared_of(evidence(records))


def with_sites(records: DataFrame, shared: DataFrame) -> DataFrame:
    """records with ``site``: the highest domain of the host that is not shared; '' if there is none."""
    counted = records.groupBy("host").agg(F.count("*").alias("rows_of_host"))
    chain = counted.select("host", "rows_of_host", F.posexplode_outer(ancestors(F.col("host"))).alias("pos", "domain")).join(shared.withColumn("shared", F.lit(True)), "domain", "left")
    # a shared host itself is no website, whatever stands above it
    own, site = F.bool_or((F.col("domain") == F.col("host")) & F.col("shared")), F.min_by("domain", F.when(F.col("shared").isNull(), F.col("pos")))
    sizes = chain.groupBy("host").agg(F.max("rows_of_host").alias("rows_of_host"), F.when(F.coalesce(own, F.lit(False)), None).otherwise(site).alias("site"))
    sizes = runtime.materialize(sizes, "hosts")
    n = sizes.agg(F.sum("rows_of_host")).first()[0] or 0
    return runtime.join_hot(records, sizes, ["host"], "rows_of_host", n).withColumn("site", F.coalesce("site", F.lit("")))


def entries(records: DataFrame) -> DataFrame:
    """(id, kind, key, site, probe) of normalised records with sites. probe: the record is looked up under this key too."""
    e = lambda kind, key, site, probe: F.struct(F.lit(kind).alias("kind"), _short(key).alias("key"), _short(site).alias("site"), probe.alias("probe"))
    none = F.array().cast("array<struct<kind:string,key:string,site:string,probe:boolean>>")
    p = F.when(F.col("place") != "", F.array(e("P", F.col("place"), F.lit(""), F.lit(True)))).otherwise(none)
    w = F.transform(ancestors(F.col("host")), lambda d: e("W", d, F.lit(""), d == F.col("site")))
    n = F.when((F.col("site") != "") & (F.col("company") != ""), F.transform("phones", lambda t: e("N", F.concat_ws("|", t, "company"), F.col("site"), F.lit(True)))).otherwise(none)
    return records.select("id", F.explode(F.concat(p, w, n)).alias("e")).select("id", "e.*")


def _short(c: Column) -> Column:
    return F.when(F.length(c) > LONGEST, F.concat(F.substring(c, 1, LONGEST - 40), F.lit("#"), F.sha2(c, 256).substr(1, 39))).otherwise(c)


def _at(kind: pd.Series, key: pd.Series, site: pd.Series) -> list[str]:
    """The place of an entry in the order of a run. Only D entries of one key may lie in several ranges."""
    return [f"{k}|{x}|{s if k == 'D' else ''}" for k, x, s in zip(kind, key, site)]


def _named(df: DataFrame, bounds: list[str], name: str) -> DataFrame:
    """df with the column ``name``: the range of each entry under ``bounds``."""
    if len(bounds) == 1:
        return df.withColumn(name, F.lit(0).cast("long"))
    shipped = df.sparkSession.sparkContext.broadcast(bounds)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[name] = [bisect_right(shipped.value, a) - 1 for a in _at(pdf["kind"], pdf["key"], pdf["site"])]
            yield pdf

    return df.mapInPandas(find, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + f", {name} long")


class History:
    """The runs under ``path``; opened again if there are any."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or runtime.fresh_path(spark, "history")
        #: of each run: name, level, bounds of its ranges
        self.runs: list[dict] = []
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.manifest = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest.json")
        self.fs = self.manifest.getFileSystem(conf)
        if self.fs.exists(self.manifest):
            self.runs = json.loads(spark.read.text(f"{self.path}/manifest.json", wholetext=True).first()[0])

    def _save(self, runs: list[dict], gone: list[dict]) -> None:
        """The manifest is replaced before old runs go, so a driver that ends in between loses nothing."""
        self.runs = runs
        out = self.fs.create(self.manifest, True)
        out.write(bytearray(json.dumps(runs).encode()))
        out.close()
        for r in gone:
            runtime.drop(self.spark, f"{self.path}/{r['name']}")

    def _write(self, df: DataFrame, level: int) -> dict:
        """Write entries, which stand in tables, as a run, in ranges of about RANGE_ROWS."""
        df = df.select("kind", "key", "site", "n")
        n = df.count()
        k = max(1, -(-n // RANGE_ROWS))
        # quantiles of the sorted keys, from a hash sample of about 16 keys a range
        sample = df.where(F.pmod(F.xxhash64("kind", "key", "site"), F.lit(max(1, n // (16 * k)))) == 0).toPandas() if k > 1 else pd.DataFrame(columns=["kind", "key", "site"])
        at = sorted(_at(sample["kind"], sample["key"], sample["site"]))
        run = {"name": f"run-{uuid.uuid4().hex[:12]}", "level": level, "bounds": sorted({"", *(at[len(at) * i // k] for i in range(1, k) if at)})}
        out = _named(df, run["bounds"], "range")
        out.repartition("range").sortWithinPartitions("range", "kind", "key", "site").write.partitionBy("range").parquet(f"{self.path}/{run['name']}")
        return run

    def _scan(self, run: dict) -> DataFrame:
        return self.spark.read.schema(ENTRY + ", range long").parquet(f"{self.path}/{run['name']}")

    def read(self, wanted: DataFrame | None = None) -> DataFrame:
        """The entries of the runs; of the ranges that the entries ``wanted`` (kind, key, site) fall into, if given."""
        empty = self.spark.createDataFrame([], ENTRY)
        touched: dict[int, set[int]] = {}
        if wanted is not None and self.runs:
            shipped = self.spark.sparkContext.broadcast([r["bounds"] for r in self.runs])

            def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                out: set[tuple[int, int]] = set()
                for pdf in batches:
                    at = _at(pdf["kind"], pdf["key"], pdf["site"])
                    for i, bounds in enumerate(shipped.value):
                        out |= {(i, bisect_right(bounds, a) - 1) for a in at}
                        if any(k == "D" for k in pdf["kind"]):  # a domain's evidence may lie in several ranges
                            for x in set(pdf["key"][pdf["kind"] == "D"]):
                                out |= {(i, r) for r in range(bisect_right(bounds, f"D|{x}|") - 1, bisect_right(bounds, f"D|{x}|~"))}
                yield pd.DataFrame(sorted(out), columns=["run", "range"])

            for r in wanted.select("kind", "key", "site").mapInPandas(find, "run long, range long").distinct().collect():  # ranges of the runs
                touched.setdefault(r["run"], set()).add(r["range"])
        for i, r in enumerate(self.runs):
            if wanted is None:
                empty = empty.unionByName(self._scan(r).drop("range"))
            elif i in touched:
                empty = empty.unionByName(self._scan(r).where(F.col("range").isin(sorted(touched[i]))).drop("range"))
        return empty

    def append(self, df: DataFrame) -> None:
        """Add entries; df is read more than once, so it is best materialised."""
        runs, gone = [*self.runs, self._write(df, 0)], []
        level = 0
        while len(own := [r for r in runs if r["level"] == level]) > COMPACT_EVERY:
            every = self._scan(own[0])
            for r in own[1:]:
                every = every.unionByName(self._scan(r))
            merged = self._write(runtime.materialize(every.groupBy("kind", "key", "site").agg(F.sum("n").alias("n")), "entries"), level + 1)
            runs = [r for r in runs if r["level"] != level] + [merged]
            gone += own
            level += 1
        self._save(runs, gone)

    def bounds(self) -> list[str]:
        """The bounds of the largest run: by these, a batch is dealt to tasks."""
        return max((r["bounds"] for r in self.runs), key=len, default=[""])


def _merge(new: pd.DataFrame, hist: pd.DataFrame) -> pd.DataFrame:
    """Merge a sorted batch into sorted runs: for each new entry the first record that matches (-1: in the history)."""
    new = new.assign(at=new["kind"] + "|" + new["key"]).sort_values(["at", "site"], ignore_index=True)
    hist = hist.assign(at=hist["kind"] + "|" + hist["key"]).sort_values(["at", "site"], ignore_index=True)
    at, run = new["at"].to_numpy(object), hist["at"].to_numpy(object)
    lo, hi = (np.searchsorted(run, at, side=s) if len(run) else np.zeros(len(at), int) for s in ("left", "right"))
    own_lo, own_hi = (np.searchsorted(at, at, side=s) for s in ("left", "right"))
    first = new["first"].to_numpy().copy()
    fresh = hi == lo
    first[~fresh] = -1
    own_first, sites, known = new["first"].to_numpy(), new["site"].to_numpy(object), hist["site"].to_numpy(object)
    for i in np.flatnonzero((new["kind"] == "N").to_numpy()):  # the window: neighbours of equal phone and company
        s, most = sites[i], edits(sites[i])
        near = set(known[lo[i] : hi[i]])
        fresh[i] = s not in near
        if any(within(s, o, most) <= most for o in near):
            first[i] = -1
            continue
        first[i] = min(own_first[j] for j in range(own_lo[i], own_hi[i]) if j == i or within(s, sites[j], most) <= most)
    return new.assign(first=first, fresh=fresh)[["kind", "key", "site", "n", "first", "fresh"]]


def check_batch(history: History, batch: DataFrame) -> DataFrame:
    """batch (normalised) -> its ids with ``known``; its new entries are added to the history."""
    seen = runtime.materialize(evidence(batch), "evidence")
    domains = runtime.materialize(batch.where("host <> ''").select(F.lit("D").alias("kind"), F.explode(ancestors(F.col("host"))).alias("key"), F.lit("").alias("site")).distinct(), "domains")
    past = history.read(domains).where("kind = 'D'").join(domains.select("key"), "key", "left_semi")
    shared = runtime.materialize(shared_of(past.select("key", "site", "n").unionByName(seen.select("key", "site", "n"))), "shared")
    own = runtime.materialize(entries(with_sites(batch, shared)), "batch")
    per_key = runtime.materialize(own.groupBy("kind", "key", "site").agg(F.min("id").alias("first"), F.count("*").alias("n")), "keys")
    bounds = history.bounds()
    hist = _named(history.read(per_key).where("kind <> 'D'").select("kind", "key", "site"), bounds, "range")
    merged = _named(per_key, bounds, "range").groupBy("range").cogroup(hist.groupBy("range")).applyInPandas(_merge, "kind string, key string, site string, n long, first long, fresh boolean")
    merged = runtime.materialize(merged, "merged")
    history.append(merged.where("fresh").select("kind", "key", "site", "n").unionByName(seen))
    hits = runtime.join_hot(own.where("probe"), merged.drop("fresh"), ["kind", "key", "site"], "n", own.count()).where("first < id").select("id").distinct()
    return batch.select("id").distinct().join(hits.withColumn("known", F.lit(True)), "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


def load(history: History, accepted: DataFrame) -> None:
    """Take accepted records (normalised) into the history."""
    seen = runtime.materialize(evidence(accepted), "evidence")
    own = entries(with_sites(accepted, runtime.materialize(shared_of(seen), "shared")))
    history.append(runtime.materialize(own.groupBy("kind", "key", "site").agg(F.count("*").alias("n")), "entries").unionByName(seen))


def classify(cache: DataFrame, batches: DataFrame, batch_col: str = "batch_no", path: str | None = None) -> DataFrame:
    """id, batch_no, known for every record of the batches, taken in order against cache and earlier records.

    cache and batches are normalised; batches also has ``batch_no``. The history is left under ``path``; one that is there already is
    taken further, and cache is then not read.
    """
    spark = cache.sparkSession
    history = History(spark, path)
    if not history.runs:
        load(history, cache)
        runtime.tidy(spark)
    batches = runtime.materialize(batches, "batches")
    numbers = sorted(r[0] for r in batches.select(batch_col).distinct().collect())  # one row a batch
    done = []
    for b in numbers:
        part = batches.where(F.col(batch_col) == b).drop(batch_col)
        done.append(runtime.scoped("checked", lambda part=part, b=b: check_batch(history, part).withColumn(batch_col, F.lit(b))))
        runtime.tidy(spark)
    if not done:
        return spark.createDataFrame([], f"id long, known boolean, {batch_col} long")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cache, new = (runtime.table(spark, sf_dir, t) for t in ("leads_cache", "lead_batches"))
    field = lambda name, kind: F.try_variant_get(F.try_parse_json("payload"), f"$.{name}", kind)
    known = normalized(cache, F.lit(-1), field("place_id", "string"), F.col("domain"), F.col("url"), field("company", "string"), field("phones", "array<string>"))
    batch_no = F.coalesce(F.col("batch_no").cast("long"), F.lit(0))
    fresh = normalized(new, F.col("rec_id"), F.col("place_id"), F.col("domain"), F.col("url"), F.col("company"), F.col("phones"), batch_no.alias("batch_no"))
    return runtime.materialize(known, "known"), runtime.materialize(fresh, "fresh")


def p6_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of lead_batches, new or known."""
    return classify(*_inputs(spark, sf_dir)).select(F.col("id").alias("rec_id"), "batch_no", "known")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(*_inputs(spark, sf_dir)).where("known").select(F.col("id").alias("rec_id"))
