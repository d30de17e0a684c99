"""Problem 8: evaluation items leaking into documents.

Words are compared without case, markup, entities, quoting and punctuation. A word weighs log(1 + items / items
that have it), so stock wording weighs little; words that no item has weigh as much as the rarest.

* Item side: windows of 3/8 of the item's length at a stride of 1/8, so every stretch of half the item holds
  whole windows. Lengths are grouped in size classes (``CLASSES``). Each window gets a 64-bit SimHash of its
  weighted words.
* Document side: windows of each class's size slide word by word over the whole text. A window is a candidate if
  ``LEAST_SHARE`` of its weight lies in words of any item (a condition of its own, beside the radius: a stretch with
  more foreign words than that is no case) and its SimHash is within ``RADIUS`` of an item's window.
* Search: the 64 bits are four blocks of 16. Two fingerprints within ``RADIUS`` = 15 bits agree in some block up
  to 3 bits, so probing each block's table, which lists every value within 3 bits of an item's block, finds all
  of them. The Hamming distance is then checked.
* Verification: the best local alignment of the item's words with the words around the window gives the stretch.
  It must cover ``COVER`` of the item, keep ``KEPT`` of the words and ``KEPT_WEIGHT`` of the weight of the word
  pairs (shingles), both of the stretch itself and of what a stretch of that length has in the item on average: so a
  stretch of nothing but stock wording is no case.

Items are shipped to all tasks; their number and size are checked, and more than ``MAX_ITEMS`` are searched in
several passes. Word weights are taken once, over all items, and handed to every pass, so the number of passes changes
nothing. No task sees more than its documents, and nothing about documents goes to the driver.

Defined cases: null, empty and blank texts and items leak nothing; items under ``LEAST_WORDS`` words are left
out (too short to tell); repeated documents are reported each, repeated items each; a document that holds an item
twice is reported once; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import runtime

MAX_ITEMS, MAX_ITEM_CHARS = 5_000, 50_000_000
#: Distinct words of all items that are shipped with their counts; more are refused.
MAX_WORDS = 2_000_000
LEAST_WORDS = 8
CLASSES = (3, 6, 9, 12, 15, 18, 22, 27, 33, 40, 50, 64, 96, 160, 320)
LEAST_SHARE = 0.5
RADIUS = 15
COVER, KEPT, KEPT_WEIGHT = 0.48, 0.65, 0.4
_TAG = re.compile(r"<[/!]?[a-z][^<>]*>|<!--.*?-->", re.S)
_ZERO = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    t = text
    if "&" in t:
        t = html.unescape(html.unescape(t))
    t = t.lower()
    if "<" in t:
        t = _TAG.sub(" ", t)
    if not t.isascii():
        t = _ZERO.sub("", t)
        if not unicodedata.is_normalized("NFKC", t):
            t = unicodedata.normalize("NFKC", t)
    return _WORD.findall(t)


class _Codes(dict):
    """Word -> code; 0 for a word that no item has."""

    def __missing__(self, word: str) -> int:
        return 0


@lru_cache(1 << 15)
def _signs(word: str) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), np.uint8))
    return bits.astype(np.float32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as four blocks of 16 bits, of rows of 64 sums."""
    return np.packbits(sums > 0, axis=1).view(np.uint8).reshape(-1, 4, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)


def word_counts(items: list[tuple[int, str]]) -> tuple[int, dict[str, int]]:
    """(searchable items, in how many of them each word stands)."""
    split = [w for _, t in items if len(w := words(t or "")) >= LEAST_WORDS]
    return len(split), Counter(x for w in split for x in set(w))


class ItemIndex:
    """Fingerprints of the items' windows with a multi-index for the Hamming search. counts: ``word_counts`` of all items, if these are a part."""

    def __init__(self, items: list[tuple[int, str]], counts: tuple[int, dict[str, int]] | None = None):
        self.items = [(i, w) for i, t in items if len(w := words(t or "")) >= LEAST_WORDS]
        total, df = counts or word_counts(items)
        own = sorted({x for _, w in self.items for x in w})
        # words of these items come first: only they have a vector kept
        named = own + sorted(df.keys() - set(own))
        self.own = len(own)
        self.top = math.log(1 + max(1, total))
        self.code = _Codes({x: k + 1 for k, x in enumerate(named)})
        self.weight = np.array([self.top, *(math.log(1 + total / df[x]) for x in named)])
        self.vectors = np.vstack([np.zeros((1, 64), np.float32), *(_signs(x) * self.weight[self.code[x]] for x in own)]) if own else np.zeros((1, 64), np.float32)
        self.coded = [np.array([self.code[x] for x in w]) for _, w in self.items]
        by_class: dict[int, list[tuple[int, int, np.ndarray]]] = defaultdict(list)
        for k, c in enumerate(self.coded):
            size = max([s for s in CLASSES if s <= 3 * len(c) // 8] or [CLASSES[0]])
            stride = max(1, len(c) // 8)
            for at in sorted({*range(0, len(c) - size + 1, stride), len(c) - size}):
                by_class[size].append((k, at, self.vectors[c[at : at + size]].sum(0)))
        masks = [0] + [sum(1 << b for b in bits) for r in (1, 2, 3) for bits in combinations(range(16), r)]
        self.classes = {}
        for size, rows in by_class.items():
            prints = _pack(np.array([v for _, _, v in rows]))
            tables = []
            for b in range(4):
                value = (prints[:, b].astype(np.int64)[:, None] ^ np.array(masks)[None, :]).ravel()
                owner = np.repeat(np.arange(len(rows)), len(masks))
                order = np.argsort(value, kind="stable")
                tables.append((np.searchsorted(value[order], np.arange(65537)), owner[order].astype(np.int32)))
            self.classes[size] = (np.array([(k, at) for k, at, _ in rows]), prints, tables)

    def candidates(self, codes: np.ndarray, found: list[str]) -> set[tuple[int, int]]:
        """(item, place in the document // item length) of windows within RADIUS of a window of the item."""
        weight = self.weight[codes]
        run = np.concatenate([[0.0], weight.cumsum()])
        own = np.concatenate([[0.0], (weight * (codes > 0)).cumsum()])
        out: set[tuple[int, int]] = set()
        for size, (rows, prints, tables) in self.classes.items():
            if len(codes) < size:
                continue
            mass, hit = run[size:] - run[:-size], own[size:] - own[:-size]
            at = np.flatnonzero(hit >= LEAST_SHARE * mass)
            for part in np.split(at, np.flatnonzero(np.diff(at) > size) + 1) if len(at) else ():
                for lo in range(0, len(part), 8192):
                    self._search(codes, found, part[lo : lo + 8192], size, rows, prints, tables, out)
        return out

    def _search(self, codes, found, at, size, rows, prints, tables, out) -> None:
        first, last = at[0], at[-1] + size
        part = codes[first:last]
        kept = (part > 0) & (part <= self.own)
        vec = self.vectors[np.where(kept, part, 0)]
        for k in np.flatnonzero(~kept):
            vec[k] = _signs(found[first + k]) * self.weight[part[k]]
        run = np.vstack([np.zeros((1, 64)), vec.astype(np.float64).cumsum(0)])
        mine = _pack(run[at - first + size] - run[at - first])
        for b, (starts, owner) in enumerate(tables):
            v = mine[:, b].astype(np.int64)
            n = starts[v + 1] - starts[v]
            q = np.repeat(np.arange(len(at)), n)
            r = owner[np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(starts[v], n)]
            near = np.bitwise_count(mine[q] ^ prints[r]).sum(1) <= RADIUS
            for k, place in set(zip(rows[r[near], 0].tolist(), (at[q[near]] - rows[r[near], 1]).tolist())):
                out.add((k, max(0, place) // max(1, len(self.coded[k]) // 2)))

    def verify(self, item: int, codes: np.ndarray, places: list[int]) -> bool:
        c = self.coded[item]
        n = len(c)
        half = max(1, n // 2)
        for p in places:
            lo, hi = max(0, (p - 1) * half - n // 4), min(len(codes), (p + 2) * half + n + n // 4)
            if self._aligned(c, codes[lo:hi]):
                return True
        return False

    def _aligned(self, item: np.ndarray, doc: np.ndarray) -> bool:
        """Whether the best local alignment (match 1, change or gap -0.5) makes a leak."""
        n, m = len(item), len(doc)
        score = np.zeros((n + 1, m + 1))
        steps = np.arange(m + 1) * 0.5
        for i in range(1, n + 1):
            row = np.zeros(m + 1)
            row[1:] = np.maximum(0, np.maximum(score[i - 1, :-1] + np.where(doc == item[i - 1], 1.0, -0.5), score[i - 1, 1:] - 0.5))
            score[i] = np.maximum.accumulate(row + steps) - steps  # gaps in the item
        i, j = np.unravel_index(score.argmax(), score.shape)
        last, kept, prev = i, [], None
        while i > 0 and j > 0 and score[i, j] > 0:
            s = score[i, j]
            if item[i - 1] == doc[j - 1] and abs(score[i - 1, j - 1] + 1 - s) < 1e-9:
                kept.append(i - 1)
                i, j = i - 1, j - 1
            elif abs(score[i - 1, j - 1] - 0.5 - s) < 1e-9:
                i, j = i - 1, j - 1
            elif abs(score[i - 1, j] - 0.5 - s) < 1e-9:
                i -= 1
            else:
                j -= 1
        cover = last - i
        if cover < COVER * n or len(kept) < KEPT * cover:
            return False
        weight = self.weight[item]
        pair = weight[:-1] * weight[1:]
        have = set(kept)
        total = max(pair[i : last - 1].sum(), pair.sum() * cover / n)
        return sum(pair[k] for k in have if k + 1 in have) >= KEPT_WEIGHT * total

    def leaks(self, text: str) -> list[int]:
        """Ids of the items that the text holds."""
        found = words(text)
        codes = np.array(list(map(self.code.__getitem__, found)), np.int64)
        if not len(codes) or not codes.any():
            return []
        places: dict[int, list[int]] = defaultdict(list)
        for k, p in sorted(self.candidates(codes, found)):
            places[k].append(p)
        return [self.items[k][0] for k, p in places.items() if self.verify(k, codes, p)]


_INDEX: dict[str, ItemIndex] = {}


def _index(key: str, items: list[tuple[int, str]], counts: tuple[int, dict[str, int]] | None) -> ItemIndex:
    """Built once in a worker process, for all its tasks; one pass is kept."""
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = ItemIndex(items, counts)
    return _INDEX[key]


def _counted(items: DataFrame) -> tuple[int, dict[str, int]]:
    """``word_counts`` of a table of items (i, t), counted in tasks; at most MAX_WORDS words."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"w": [sorted(set(w)) if len(w := words(t or "")) >= LEAST_WORDS else None for t in pdf["t"]]})

    rows = runtime.materialize(items.mapInPandas(split, "w array<string>").where("w is not null"), "items")
    per = rows.select(F.explode("w").alias("w")).groupBy("w").count()
    got = per.limit(MAX_WORDS + 1).collect()
    if len(got) > MAX_WORDS:
        raise ValueError(f"the items have more than {MAX_WORDS} distinct words")
    return rows.count(), {r["w"]: r["count"] for r in got}


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """item_id, doc_id of every document that holds half of an item or more."""
    spark = docs.sparkSession
    items = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    passes = max(1, -(-n // MAX_ITEMS), -(-chars // MAX_ITEM_CHARS))
    rows = runtime.scan_tasks(docs.where(F.length(text) > 0).select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")))
    counts = spark.sparkContext.broadcast(_counted(items) if passes > 1 else None)
    out = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k)
        shipped = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["i"], r["t"]) for r in part.collect()]))

        def run(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            index = _index(*shipped.value, counts.value)
            for pdf in batches:
                yield pd.DataFrame([(i, d) for d, t in zip(pdf["d"], pdf["t"]) for i in index.leaks(t)], columns=["item_id", "doc_id"]).astype("int64")

        found = rows.mapInPandas(run, "item_id long, doc_id long")
        out = found if out is None else out.unionByName(found)
    return out


def _find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(runtime.table(spark, sf_dir, "documents"), "doc_id", "text", runtime.table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _find(spark, sf_dir)


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that leaked, with the number of documents that hold them."""
    return _find(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
