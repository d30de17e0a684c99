"""Problem 1: mapping freely typed values to a reference list with a BK-tree.

The metric is the unrestricted Damerau-Levenshtein distance (insert, delete, substitute, transpose), which is a
true metric; so a BK-tree over the reference entries returns *every* entry within a threshold and prunes by the
triangle inequality. Strings are compared without case, accents, spaces and punctuation ("squeezed").

A typed value is read in a few ways (``readings``): as it stands, without decoration ("Specialists", "near me",
"in <town>", prices and times), with its parts turned round ("Binding, Book", "Removal of trees"), and with
abbreviated words written out from the vocabulary of the reference ("Deck Rpr", "Awning Instn", "Dog Gro...").
Each reading costs a little; the best (distance + cost) wins. Two different entries at the same best total are
a tie and the value counts as unmatched, unless one of them is spelt exactly; ``tie`` tells ties from values that fit
nothing.

Only distinct typed values are matched. The tree is walked for a whole batch of values at once: at every node
one vectorised distance gives all values that must enter each child. The reference list is cut into shards of
at most ``SHARD_ENTRIES`` entries, each a broadcast of bounded size; every value visits every shard's tree where it lies,
so neither values nor entries are copied or shuffled for it, and the winners of the shards are merged by one aggregate. The vocabulary
from which abbreviations are written out, and the choice among entries of one squeezed text, are those of the whole
list, so the number of shards changes nothing.

Defined cases: null, empty and blank values are left out; a value that fits nothing, or that is only
decoration, gets id 0; very long values are compared whole; repeated reference entries count once (smallest
id); an empty reference list gives id 0 for all; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import runtime

SHARD_ENTRIES = 50_000
#: Distinct words of the whole reference list that are shipped; more are refused.
MAX_WORDS = 2_000_000
#: Words that say nothing about the trade.
DECORATION = frozenset("the a an local professional certified licensed best trusted quality affordable specialist specialists expert experts service services svc svcs company co contractor contractors provider providers shop inc ltd limited group and more".split())
_TAIL = re.compile(r"\s+(?:near me|in\s+\S.*|nearby|& more|and more)\s*$")
_PAREN = re.compile(r"^(.+?)\s*\(([^()]*)\)\s*$")
_TURN = re.compile(r"^(.+?)\s*(?:,|:|;|\s-\s|\s/\s|\bof\b|\bfor\b)\s*(.+)$")
_WORD = re.compile(r"[^\W_]+")


def plain(value: str) -> str:
    """Lower case without accents, with split camel case and single spaces."""
    v = unicodedata.normalize("NFKC", value)
    v = "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", v).strip().lower()


def squeeze(words: Iterable[str] | str) -> str:
    return "".join(_WORD.findall(words) if isinstance(words, str) else words)


def singular(word: str) -> str:
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def threshold(length: int) -> int:
    """Edits allowed for a squeezed string of this length."""
    return 0 if length < 5 else 1 if length < 8 else 2 if length < 14 else 3


def dl_batch(a: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distance of ``a`` to each row of ``codes`` (code points, 0 padded)."""
    n, width = codes.shape
    m = len(a)
    inf = m + width + 2
    d = np.full((m + 2, width + 2, n), inf, np.int16)
    d[1:, 1, :] = np.arange(m + 1)[:, None]
    d[1, 1:, :] = np.arange(width + 1)[:, None]
    symbols = {c: i + 1 for i, c in enumerate(sorted(set(a)))}
    known = np.zeros((width, n), np.int64)  # each character of b as a symbol of a, 0 if a has none
    for c, i in symbols.items():
        known[codes.T == ord(c)] = i
    last_row = np.zeros(len(symbols) + 1, np.int64)  # last row of a with this symbol
    each = np.arange(n)
    for i in range(1, m + 1):
        col = np.zeros(n, np.int64)  # last column of this row where the characters agree
        for j in range(1, width + 1):
            row = last_row[known[j - 1]]
            same = codes[:, j - 1] == ord(a[i - 1])
            swap = d[row, col, each] + (i - row - 1) + 1 + (j - col - 1)
            best = np.minimum(np.minimum(d[i, j] + ~same, d[i + 1, j] + 1), np.minimum(d[i, j + 1] + 1, swap))
            d[i + 1, j + 1] = best
            col[same] = j
        last_row[symbols[a[i - 1]]] = i
    return d[m + 1, lengths + 1, each].astype(np.int64)


def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in strings], np.int64)
    codes = np.zeros((len(strings), int(lengths.max(initial=0))), np.int32)
    for i, s in enumerate(strings):
        codes[i, : len(s)] = np.fromiter(map(ord, s), np.int32, len(s))
    return codes, lengths


class BKTree:
    """Entries (squeezed text -> id). ``search`` returns every entry within each query's threshold."""

    def __init__(self, entries: dict[str, int]):
        self.texts = list(entries)
        self.ids = list(entries.values())
        self.children: list[dict[int, int]] = [{} for _ in self.texts]
        if self.texts:
            codes, lengths = encode(self.texts)
            self._grow(0, np.arange(1, len(self.texts)), codes, lengths)

    def _grow(self, node: int, members: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> None:
        todo = [(node, members)]
        while todo:
            at, rest = todo.pop()
            if not len(rest):
                continue
            dist = dl_batch(self.texts[at], codes[rest], lengths[rest])
            for k in np.unique(dist):
                own = rest[dist == k]
                self.children[at][int(k)] = int(own[0])
                todo.append((int(own[0]), own[1:]))

    def search(self, queries: list[str], limits: np.ndarray) -> list[tuple[int, int, int]]:
        """(query index, entry index, distance) of all entries within the limits."""
        found: list[tuple[int, int, int]] = []
        if not self.texts or not queries:
            return found
        order = np.argsort([len(q) for q in queries], kind="stable")
        for part in np.array_split(order, -(-len(order) // 2000)):
            codes, lengths = encode([queries[i] for i in part])
            todo = [(0, np.arange(len(part)))]
            while todo:
                at, own = todo.pop()
                dist = dl_batch(self.texts[at], codes[own, : int(lengths[own].max())], lengths[own])
                lim = limits[part[own]]
                hit = dist <= lim
                found += [(int(part[q]), at, int(k)) for q, k in zip(own[hit], dist[hit])]
                for k, child in self.children[at].items():
                    inside = abs(dist - k) <= lim
                    if inside.any():
                        todo.append((child, own[inside]))
        return found


class Matcher:
    """Matches typed values against reference entries [(id, text)]. vocabulary: the words of the whole list, if the entries are a shard of it."""

    def __init__(self, entries: list[tuple[int, str]], vocabulary: Iterable[str] | None = None):
        by_text: dict[str, int] = {}
        self.words: dict[str, set[int]] = defaultdict(set)
        self.split: list[list[str]] = []
        for i, text in sorted(entries):
            if (s := squeeze(plain(text))) and s not in by_text:
                by_text[s] = i
                for w in _WORD.findall(plain(text)):
                    self.words[w].add(len(self.split))
                self.split.append(_WORD.findall(plain(text)))
        self.tree = BKTree(by_text)
        self.known = set(self.words if vocabulary is None else vocabulary)
        self.by_letter: dict[str, list[str]] = defaultdict(list)
        for w in self.known:
            self.by_letter[w[0]].append(w)
        self.full: dict[str, set[str]] = {}

    def meanings(self, word: str) -> set[str]:
        """Words of the reference that ``word`` is, or is short for."""
        if word not in self.full:
            out = {w for w in (word, singular(word)) if w in self.known}
            if not out:
                for w in self.by_letter.get(word[0], ()):
                    if len(w) > len(word):
                        rest = iter(w)
                        if w.startswith(word) or len(word) > 2 and w[-1] == word[-1] and all(c in rest for c in word):
                            out.add(w)
            self.full[word] = out
        return self.full[word]

    def written_out(self, words: list[str]) -> list[str]:
        """Entries (squeezed) of as many words, each meant by the word in its place."""
        if not any(len(w) > 2 and (w in self.known or singular(w) in self.known) for w in words):
            return []
        hits: set[int] | None = None
        for w in words:
            own = set().union(*(self.words.get(m, ()) for m in self.meanings(w)))
            hits = own if hits is None else hits & own
            if not hits:
                return []
        return [squeeze(self.split[i]) for i in hits or () if len(self.split[i]) == len(words) and all(e in self.meanings(w) for e, w in zip(self.split[i], words))]

    def readings(self, value: str) -> dict[str, float]:
        """Squeezed readings of a typed value with their costs."""
        out: dict[str, float] = {}

        def add(text: str, cost: float) -> None:
            words = _WORD.findall(text)
            if s := squeeze(words):
                out[s] = min(cost, out.get(s, 9.0))
            kept = [w for w in words if w not in DECORATION]
            a, b = 0, len(words)
            while a < b and words[a] in DECORATION:
                a += 1
            for end in range(b, a, -1):  # the ends are stripped word by word, as an entry may hold such a word itself
                if end < b and words[end] not in DECORATION:
                    break
                s = squeeze(words[a:end])
                out[s] = min(cost + 0.1, out.get(s, 9.0))
            if kept and kept != words:
                s = squeeze(kept)
                out[s] = min(cost + 0.1, out.get(s, 9.0))
            ones = [singular(w) for w in kept]
            if kept and ones != kept:
                s = squeeze(ones)
                out[s] = min(cost + 0.1, out.get(s, 9.0))
            if len(kept) > 1:
                for s in self.written_out(kept):
                    out[s] = min(cost + 0.3, out.get(s, 9.0))

        v = plain(value)
        camel = plain(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value)) if not re.search(r"(?:^|\s)[a-z]", value) else v
        for text, cost in {v: 0.0, camel: 0.0}.items():
            text = re.sub(r"[_]", " ", text)
            add(text, cost)
            bare = _TAIL.sub("", text)
            if bare != text:
                add(bare, cost + 0.1)
            for t in {text, bare}:
                if m := _PAREN.match(t):
                    add(m[1], cost + 0.1)
                    add(f"{m[2]} {m[1]}", cost + 0.1)
                if m := _TURN.match(t):
                    add(f"{m[2]} {m[1]}", cost + 0.1)
        return out

    def match(self, values: list[str]) -> list[tuple[int, float]]:
        """(id, total) for each value; id 0 and total 99 where nothing fits, id 0 and the total for a tie."""
        asked: dict[str, int] = {}
        reads = []
        for v in values:
            r = self.readings(v)
            for s in r:
                asked.setdefault(s, len(asked))
            reads.append(r)
        texts = list(asked)
        near: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for q, e, d in self.tree.search(texts, np.array([threshold(len(t)) for t in texts], np.int64)):
            near[q].append((e, d))
        out = []
        for r in reads:
            best: dict[int, float] = {}
            for s, cost in r.items():
                for e, d in near.get(asked[s], ()):
                    i = self.tree.ids[e]
                    best[i] = min(best.get(i, 99.0), round(d + cost, 3))
            if not best:
                out.append((0, 99.0))
                continue
            low = min(best.values())
            top = [i for i, t in best.items() if t == low]
            out.append((top[0] if len(top) == 1 else 0, low))
        return out


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, entries: list[tuple[int, str]], vocabulary: list[str]) -> Matcher:
    """Built once in a worker process for all tasks of a shard."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(entries, vocabulary)
    return _MATCHERS[key]


def _squeezed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        own = [plain(t) for t in pdf["text"]]
        yield pdf.assign(s=[squeeze(t) for t in own], words=[_WORD.findall(t) for t in own])


def map_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """value, entry (id; 0 unmatched), tie for distinct ``values`` (one string column ``value``); reference: id, text."""
    spark = values.sparkSession
    reference = reference.where("id is not null and text is not null").select(F.col("id").cast("long"), "text")
    split = runtime.materialize(reference.mapInPandas(_squeezed, "id long, text string, s string, words array<string>").where("s <> ''"), "reference")
    words = split.select(F.explode("words").alias("w")).distinct().limit(MAX_WORDS + 1).collect()
    if len(words) > MAX_WORDS:
        raise ValueError(f"the reference list has more than {MAX_WORDS} distinct words")
    vocabulary = spark.sparkContext.broadcast([r["w"] for r in words])
    entries = runtime.materialize(split.groupBy("s").agg(F.min(F.struct("id", "text")).alias("e")).select("s", "e.*"), "entries")
    shards = max(1, -(-entries.count() // SHARD_ENTRIES))
    values = runtime.spread(runtime.materialize(values.select("value"), "values"), 5000)
    out = None
    for k in range(shards):
        own = entries.where(F.pmod(F.xxhash64("s"), F.lit(shards)) == k)
        shipped = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["id"], r["text"]) for r in own.collect()]))  # about SHARD_ENTRIES

        def run(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            matcher = _matcher(*shipped.value, vocabulary.value)
            for pdf in batches:
                got = matcher.match(pdf["value"].tolist())
                yield pd.DataFrame({"value": pdf["value"], "entry": [g[0] for g in got], "total": [g[1] for g in got]})

        found = values.mapInPandas(run, "value string, entry long, total double")
        out = found if out is None else out.unionByName(found)
    if shards > 1:
        # winners: the least total; a tie between shards, or inside the winning shard, is a tie
        best = out.groupBy("value").agg(F.min(F.struct("total", "entry")).alias("lo"), F.min(F.struct("total", (-F.col("entry")).alias("e"))).alias("hi"))
        out = best.select("value", F.when(F.col("lo.entry") == -F.col("hi.e"), F.col("lo.entry")).otherwise(0).alias("entry"), F.col("lo.total").alias("total"))
    return out.select("value", "entry", ((F.col("entry") == 0) & (F.col("total") < 99)).alias("tie"))


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = runtime.table(spark, sf_dir, "categories")
    return c.select(F.col("category_id").alias("id"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("text"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = runtime.table(spark, sf_dir, "leads")
    names = runtime.table(spark, sf_dir, "categories").select(F.col("name").alias("category"))
    return leads.select("lead_id", "category").where(F.length(F.regexp_replace("category", r"(?U)\s+", "")) > 0).join(names, "category", "left_anti")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir)
    mapped = runtime.materialize(map_values(typed.select(F.col("category").alias("value")).distinct(), _reference(spark, sf_dir)), "mapped")
    # the join's sides have known sizes; a hot value is split by the adaptive skew join where it is not broadcast
    return typed.join(mapped, typed["category"] == mapped["value"]).select(F.col("entry").cast("int").alias("category_id"), "lead_id")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values without an entry, with the number of leads that have them and whether several entries fit equally well."""
    typed = runtime.materialize(_typed(spark, sf_dir).groupBy("category").agg(F.count("*").alias("leads")), "typed")
    mapped = runtime.materialize(map_values(typed.select(F.col("category").alias("value")), _reference(spark, sf_dir)), "mapped")
    return typed.join(mapped.where("entry = 0"), typed["category"] == mapped["value"]).select("category", "leads", "tie")
