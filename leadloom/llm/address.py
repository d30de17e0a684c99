"""Taking postal addresses apart. Shared by problems 3 and 4.

``AddressParser`` turns a text into (num, name, kind, dir, unit, city, prov, postal), '' for a part left out.
Order, case, separators, abbreviations, accents and the position of the unit do not matter; the town may be
misspelt by up to two edits. The gazetteer (the table ``cities``) is checked to be small before it is shipped.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import runtime

MAX_GAZETTEER = 100_000

#: Kinds of street and their usual short forms.
KINDS = {
    "street": "st str street", "avenue": "ave av avenue", "road": "rd road", "drive": "dr drv drive", "lane": "ln lane",
    "court": "ct crt court", "crescent": "cres cr crescent", "boulevard": "blvd boul boulevard", "terrace": "ter terr terrace",
    "parkway": "pkwy pky parkway", "highway": "hwy highway", "square": "sq square", "place": "pl place", "way": "way",
    "trail": "trl trail", "circle": "cir circle", "close": "close", "gate": "gate", "row": "row",
}
KIND_OF = {short: kind for kind, shorts in KINDS.items() for short in shorts.split()}
DIR_OF = {"n": "n", "north": "n", "s": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w", "ne": "ne", "nw": "nw", "se": "se", "sw": "sw"}
_POSTAL = re.compile(r"(?<![a-z0-9])([a-z]\d[a-z])[\s\-]*(\d[a-z]\d)(?![a-z0-9])")
_UNIT = re.compile(r"(?:(?<![a-z])(?:unit|suite|ste|apt|apartment|room|rm)(?![a-z])[\s.]*#?|#)\s*(\d+[a-z]?)(?![a-z0-9])")
_UNIT_NUM = re.compile(r"(?<![a-z0-9])(\d{1,5}[a-z]?)\s?-\s?(\d{1,6})(?=\s+[a-z])")
_NUM = re.compile(r"(?:(?<![a-z])no\.?\s*)?(?<![a-z0-9])(\d{1,6})(?![a-z0-9])")
_SEP = re.compile(r"[,;\n|]|\s-\s|-\s|\s-")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


class Parts(NamedTuple):
    num: str = ""
    name: str = ""
    kind: str = ""
    dir: str = ""
    unit: str = ""
    city: str = ""
    prov: str = ""
    postal: str = ""


def within(a: str, b: str, most: int) -> int:
    """Edits between a and b (with swaps of neighbours), most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, prev = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, prev = prev, row
    return min(prev[-1], most + 1)


class AddressParser:
    def __init__(self, cities: list[tuple[str, str, str]], country: str = "canada"):
        self.country = country
        self.provinces: dict[str, str] = {}
        self.towns: dict[str, set[str]] = defaultdict(set)
        for city, prov, name in cities:
            prov = (prov or "").strip().lower()
            if prov:
                self.provinces[prov] = prov
            if name and prov:
                self.provinces[" ".join(_TOKEN.findall(name.lower()))] = prov
            if city and (town := " ".join(_TOKEN.findall(city.lower()))):
                self.towns[town].add(prov)
        self.by_shape: dict[str, list[str]] = defaultdict(list)
        for town in self.towns:
            for s in self._shapes(town):
                self.by_shape[s].append(town)
        self.cache: dict[str, str] = {}
        self.places: dict[tuple[tuple[str, ...], ...], tuple[str, str]] = {}
        self.country_word = re.compile(rf"(?<![a-z]){country}(?![a-z])")

    @staticmethod
    def _shapes(town: str) -> set[str]:
        t = town.replace(" ", "")
        return {"a" + t[:3], "z" + t[-3:], "m" + t[2:5]} | {"w" + w for w in town.split()[1:]}

    def town(self, text: str) -> str:
        """The town meant by ``text``: exact, else the single nearest one within 2 edits; '' if none."""
        if text in self.towns:
            return text
        if text not in self.cache:
            got = ""
            if len(text) >= 4:
                most = 1 if len(text) < 6 else 2
                near = {c: within(text, c, most) for s in self._shapes(text) for c in self.by_shape.get(s, ())}
                low = min(near.values(), default=9)
                if low <= most and len(best := [c for c, d in near.items() if d == low]) == 1:
                    got = best[0]
            self.cache[text] = got
        return self.cache[text]

    def parse(self, address: str | None) -> Parts:
        if not address:
            return Parts()
        t = address.lower()
        if not t.isascii():
            t = unicodedata.normalize("NFKC", address).lower()
            t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).replace("‑", "-").replace("–", "-")
        t = re.sub(r"[ \t\r\f\v]+", " ", t)
        postal = unit = num = ""
        if m := _POSTAL.search(t):
            postal = m[1] + m[2]
            t = t[: m.start()] + " , " + t[m.end() :]
        t = self.country_word.sub(" , ", t)
        if m := _UNIT.search(t):
            unit = m[1].lstrip("0")
            t = t[: m.start()] + " , " + t[m.end() :]
        elif m := _UNIT_NUM.search(t):
            unit = m[1].lstrip("0")
            t = t[: m.start()] + " , " + t[m.start(2) :]
        name = kind = direction = ""
        rest: list[list[str]] = []
        for segment in _SEP.split(t):
            m = None if num else _NUM.search(segment)
            words = _TOKEN.findall(segment[m.end() :] if m else segment)
            if m and words:
                num = m[1].lstrip("0") or "0"
                if ahead := _TOKEN.findall(segment[: m.start()]):
                    rest.append(ahead)
                i = 0
                if len(words) > 1 and words[0] in DIR_OF and words[1] not in KIND_OF:
                    direction, i = DIR_OF[words[0]], 1
                k = next((k for k in range(i + 1, min(i + 5, len(words))) if words[k] in KIND_OF), None)
                if k is None or k > i + 1 and self._place(words[i + 1 : k]):
                    k = i + 1
                name = " ".join(words[i:k])
                if k < len(words) and words[k] in KIND_OF:
                    kind, k = KIND_OF[words[k]], k + 1
                if k < len(words) and words[k] in DIR_OF and not direction:
                    direction, k = DIR_OF[words[k]], k + 1
                words = words[k:]
            elif m:
                num = m[1].lstrip("0") or "0"
            if words:
                rest.append(words)
        city, prov = self._where(rest)
        if num and not name and rest:
            name, kind, direction, city, prov = self._late_street(rest)
        return Parts(num, name, kind, direction, unit, city, prov, postal)

    def _place(self, words: list[str]) -> bool:
        return " ".join(words) in self.towns or " ".join(words) in self.provinces

    def _where(self, rest: list[list[str]]) -> tuple[str, str]:
        """Town and province among the segments. The same few endings come again and again, so they are kept."""
        key = tuple(map(tuple, rest))
        if key not in self.places:
            if len(self.places) >= 100_000:
                self.places.clear()
            self.places[key] = self._find_where(rest)
        return self.places[key]

    def _find_where(self, rest: list[list[str]]) -> tuple[str, str]:
        city = prov = ""
        for words in rest:
            i = 0
            while i < len(words):
                for n in (3, 2, 1):
                    text = " ".join(words[i : i + n])
                    if i + n > len(words):
                        continue
                    if not prov and text in self.provinces:
                        prov = self.provinces[text]
                    elif not city and (c := self._exact(words[i : i + n], words[i + n : i + n + 1])):
                        city = c
                        n += len(c.split()) > n
                    else:
                        continue
                    i += n
                    break
                else:
                    i += 1
        if not city or not prov:
            for words in rest:
                left = [w for w in words if w not in self.provinces]
                for n in (3, 2, 1):
                    for i in range(len(left) - n + 1):
                        text = " ".join(left[i : i + n])
                        if not city and (c := self.town(text)) and n >= len(c.split()):
                            city = c
                if not prov:
                    for n in (2, 1):
                        for i in range(len(words) - n + 1):
                            text = " ".join(words[i : i + n])
                            if len(text) > 4 and text != city:
                                near = [p for p in self.provinces if len(p) > 4 and within(text, p, 2) <= 2]
                                if len(near) == 1 and not prov:
                                    prov = self.provinces[near[0]]
        if city and not prov and len(self.towns[city]) == 1:
            prov = next(iter(self.towns[city]))
        return city, prov

    def _exact(self, words: list[str], following: list[str]) -> str:
        """The town spelt by ``words``; a longer town whose last word is misspelt goes before it."""
        text = " ".join(words)
        if text not in self.towns:
            return ""
        if following and following[0] not in self.provinces and len(following[0]) > 2 and len((c := self.town(f"{text} {following[0]}")).split()) > len(words):
            return c
        return text

    def _late_street(self, rest: list[list[str]]) -> tuple[str, str, str, str, str]:
        """A number that stands alone: the street is the first segment with a kind of street."""
        for i, words in enumerate(rest):
            k = next((k for k in range(1, len(words)) if words[k] in KIND_OF), None)
            if k is not None:
                city, prov = self._where(rest[:i] + [words[k + 1 :]] + rest[i + 1 :])
                d = DIR_OF.get(words[k + 1], "") if k + 1 < len(words) else ""
                return " ".join(words[:k]), KIND_OF[words[k]], d, city, prov
        return "", "", "", *self._where(rest)


FIELDS = Parts._fields
SCHEMA = "address string, " + ", ".join(f"{f} string" for f in FIELDS)


def parse_addresses(addresses: DataFrame, cities: DataFrame) -> DataFrame:
    """One column ``address`` (distinct texts) -> the parts of each."""
    shipped = _gazetteer(cities)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = _parser(shipped.value)
        for pdf in batches:
            rows = [(a, *parser.parse(a)) for a in pdf["address"]]
            yield pd.DataFrame(rows, columns=["address", *FIELDS])

    return runtime.spread(addresses.select("address"), 20000).mapInPandas(run, SCHEMA)


def parts_udf(cities: DataFrame):
    """A column function: address text -> struct of its parts. The gazetteer is checked and shipped as in ``parse_addresses``."""
    shipped = _gazetteer(cities)

    @F.arrow_udf(", ".join(f"{f} string" for f in FIELDS))
    def parts(texts: pa.Array) -> pa.Array:
        parser = _parser(shipped.value)
        rows = [parser.parse(a) for a in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], "string") for i in range(len(FIELDS))], FIELDS)

    return parts


def _gazetteer(cities: DataFrame):
    towns = cities.select("city", "province_id", "province_name").distinct()
    if (n := towns.limit(MAX_GAZETTEER + 1).count()) > MAX_GAZETTEER:
        raise ValueError(f"the gazetteer has more than {MAX_GAZETTEER} rows ({n})")
    return cities.sparkSession.sparkContext.broadcast(tuple(sorted(tuple(x or "" for x in r) for r in towns.collect())))


@lru_cache(2)
def _parser(cities: tuple[tuple[str, str, str], ...]) -> AddressParser:
    """Built once in a worker process."""
    return AddressParser(list(cities))


def blank(c: str):
    return F.length(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", "")) == 0
