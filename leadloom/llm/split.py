"""Problem 10: splitting oversized texts at natural boundaries, with overlap.

A text over the limit is taken apart into units (paragraphs, lines, sentences; a longer unit at white space,
and a run without any at token ends). Around every gap between units the words (longer tokens) of the units before
and after it are compared (cosine of counts over sliding blocks); the depth of a similarity valley says how much
the topic changes there. A piece ends at the deepest valley within its size window, among the sentence, line and
paragraph ends there; of equally deep ones a paragraph end goes before a line end, that before a sentence end, and the
later before the earlier. Where the window has no such end, the same is done among white space, then token ends. The
next piece begins ``overlap`` tokens before that end.

The words compared are the vocabulary's tokens of at least ``LEAST_BYTES`` bytes, in lower case, hashed to ``DIMS`` bins.

Texts of at most ``limit`` bytes cannot hold more than ``limit`` tokens and never reach Python. Every other
text is tokenised whole. Long texts are segmented in blocks of units, so memory follows the block, not the text.

Defined cases: null, empty and blank texts give no piece; a text within the limit gives none either (it needs no
cut); concatenating text[new_from:end] over a document's pieces gives the document back, character by
character; every piece has at most ``limit`` tokens when encoded on its own; repeated rows are split
separately; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import runtime
from leadloom.llm import tokens

LIMIT, OVERLAP = 1500, 100
#: A piece is filled to this share of the limit at least, if it can be.
LEAST_FILL = 0.5
#: Units that are compared on each side of a gap; summed as three pairs.
BLOCK = 6
DIMS = 512
LEAST_BYTES = 4
UNITS_AT_ONCE = 256
KINDS = ("token", "word", "sentence", "line", "paragraph")
NATURAL = 2
_GAP = re.compile(r"(\n[ \t\r]*\n\s*)|([\n\r]\s*)|((?<=[.!?…。！？])[\"'”’)\]]*\s+)")


def gaps(text: str, longest: int) -> tuple[list[int], list[int]]:
    """(character offsets where a unit ends, kind of each): all natural ones, and word gaps inside units over ``longest`` characters."""
    at, kind = [], []
    start = 0
    ends = [(m.end(), 4 if m.group(1) else 3 if m.group(2) else 2) for m in _GAP.finditer(text)]
    for end, k in [*ends, (len(text), 4)]:
        while end - start > longest:
            cut = max(text.rfind(" ", start + 1, start + longest), text.rfind("\t", start + 1, start + longest))
            start = cut + 1 if cut > start else start + longest
            at.append(start)
            kind.append(1 if cut > 0 and text[start - 1] in " \t" else 0)
        if end > start and end < len(text):
            at.append(end)
            kind.append(k)
        start = max(start, end)
    return at, kind


def valley_depth(at: list[int], bins: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Depth of the similarity valley at each gap, 0 to 2. The words are the tokens of at least LEAST_BYTES; bins: those of all tokens."""
    sims = np.zeros(len(at))
    word = size >= LEAST_BYTES
    unit_of, ids = np.searchsorted(at, ends[word], side="left"), bins[word]
    for lo in range(0, len(at), UNITS_AT_ONCE):
        hi = min(lo + UNITS_AT_ONCE, len(at))
        a, b = max(0, lo - BLOCK), min(len(at) + 1, hi + 1 + BLOCK)
        own = slice(*np.searchsorted(unit_of, (a, b)))
        m = b - a
        counts = np.zeros((m + 2 * BLOCK, DIMS), np.float32)  # without words before the first and after the last unit
        counts[BLOCK : BLOCK + m] = np.bincount((unit_of[own] - a) * DIMS + ids[own], minlength=m * DIMS).reshape(m, DIMS)
        two = counts[:-1] + counts[1:]
        block = two[: m + BLOCK + 1] + two[2 : m + BLOCK + 3] + two[4 : m + BLOCK + 5]  # row j: the BLOCK units before unit j
        norm = np.einsum("ij,ij->i", block, block)
        left = slice(lo + 1 - a, hi + 1 - a)
        right = slice(left.start + BLOCK, left.stop + BLOCK)
        sims[lo:hi] = np.einsum("ij,ij->i", block[left], block[right]) / np.maximum(np.sqrt(norm[left] * norm[right]), 1e-9)
    return (_peak(sims) - sims) + (_peak(sims[::-1])[::-1] - sims)


def _peak(s: np.ndarray) -> np.ndarray:
    """The top of the hill that rises from each place to the left."""
    out = s.copy()
    for i in range(1, len(s)):
        out[i] = out[i - 1] if s[i - 1] >= s[i] else s[i]
    return out


def token_ends(text: str, enc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token ids, bytes of each, character offset after each). A token that ends inside a character counts to the end of it."""
    ids = enc.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
    size = tokens.sizes(enc)[ids]
    ends = size.cumsum()
    if text.isascii():
        return ids, size, ends
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    begun = np.concatenate([[0], ((raw & 0xC0) != 0x80).cumsum()])  # characters begun before each byte
    return ids, size, begun[ends]


def pieces(text: str, enc, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, str]]:
    """(start, new_from, end, n_tokens, kind of cut) of each piece; [] for a text within the limit."""
    ids, size, where = token_ends(text, enc)
    if (n := len(ids)) <= limit:
        return []
    ends = where.tolist()
    overlap = min(overlap, limit // 2)
    at, kind = gaps(text, longest=max(16, limit))
    # the deepest natural gap, then the stronger kind, then the later one; weaker gaps only where there is no natural one
    depth = np.round(valley_depth(at, tokens.folded_bins(enc, DIMS)[ids], where, size), 6)
    kinds = np.array(kind, int)
    worth = depth + kinds * 1e-8 + np.where(kinds >= NATURAL, 8.0, np.where(kinds == 1, 4.0, 0.0)) if at else depth
    before = np.searchsorted(where, at, side="right").tolist()  # tokens that end at or before each gap
    out: list[tuple[int, int, int, int, str]] = []
    start = fresh = 0
    while True:
        have = bisect_right(ends, start)
        rest = len(enc.encode_ordinary(text[start:])) if n - have <= limit + 8 else limit + 1
        if rest <= limit:
            out.append((start, fresh, len(text), rest, "end"))
            return out
        last = have + limit - 2
        while True:
            lo, hi = bisect_left(before, have + int(limit * LEAST_FILL)), bisect_right(before, last)
            lo = max(lo, bisect_right(at, fresh))
            if lo < hi:
                best = hi - 1 - int(np.argmax(worth[lo:hi][::-1]))
                end, what = at[best], KINDS[kind[best]]
            else:
                hi, lo = bisect_right(before, last), bisect_right(at, fresh)
                if lo < hi:  # no gap in the window: the last one before it
                    end, what = at[hi - 1], KINDS[kind[hi - 1]]
                else:
                    end, what = max(ends[last - 1], fresh + 1), "token"
            size = len(enc.encode_ordinary(text[start:end]))
            if size <= limit:
                break
            last -= size - limit
            if last <= have + 1:
                end, what = fresh + 1, "token"
                start = fresh
                size = len(enc.encode_ordinary(text[start:end]))
                break
        out.append((start, fresh, end, size, what))
        fresh = end
        closed = bisect_right(ends, end)
        start = max(out[-1][0] + 1, ends[closed - overlap - 1] if overlap and closed > overlap else end)
        start = min(start, fresh)


def split_documents(docs: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = tokens.VOCABULARY) -> DataFrame:
    """One row per piece: id, piece_no, start, new_from, end, n_tokens, cut, text."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(tokens.load(path))
    large = docs.where(F.octet_length(text_col) > limit).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.encoder(vocabulary.value)
        for pdf in batches:
            for i, t in zip(pdf["id"], pdf["t"]):
                if cut := pieces(t, enc, limit, overlap):
                    yield pd.DataFrame([(i, k, a, f, b, n, what, t[a:b]) for k, (a, f, b, n, what) in enumerate(cut)], columns=["id", "piece_no", "start", "new_from", "end", "n_tokens", "cut", "text"])

    return runtime.scan_tasks(large).mapInPandas(run, "id long, piece_no int, start int, new_from int, end int, n_tokens int, cut string, text string")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    return split_documents(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the splitter had to cut: those of more than LIMIT tokens."""
    docs = runtime.table(spark, sf_dir, "documents")
    return split_documents(docs, "doc_id", "text").where("piece_no = 0").select(F.col("id").alias("doc_id"))
