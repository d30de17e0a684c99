"""Token counts under a public byte-pair vocabulary.

The vocabulary file is a parameter. The driver reads it (about 1 MB, checked) and broadcasts its bytes, so
executors need no copy of it; a Python worker builds the encoder once.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import runtime

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 16 << 20
#: Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict[int, object] = {}
_SIZES: dict[int, np.ndarray] = {}
_BINS: dict[tuple[int, int], np.ndarray] = {}


def load(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary may be")
    return data


def encoder(data: bytes):
    """The encoder for vocabulary bytes, built once in a process."""
    import tiktoken

    if (key := hash(data)) not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def sizes(enc) -> np.ndarray:
    """Bytes of each token, by id."""
    if (key := id(enc)) not in _SIZES:
        out = np.zeros(enc.n_vocab, np.int64)
        for token in enc.token_byte_values():
            out[enc.encode_single_token(token)] = len(token)
        _SIZES[key] = out
    return _SIZES[key]


def folded_bins(enc, bins: int) -> np.ndarray:
    """A bin for each token id: a hash of its text in lower case without white space, so that case and position in a word don't part tokens."""
    if (key := (id(enc), bins)) not in _BINS:
        out = np.zeros(enc.n_vocab, np.int64)
        for token in enc.token_byte_values():
            out[enc.encode_single_token(token)] = zlib.crc32(token.decode("utf-8", "replace").strip().lower().encode()) % bins
        _BINS[key] = out
    return _BINS[key]


def counted(docs: DataFrame, id_col: str, text_col: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """id, the columns ``keep`` and n_tokens (0 for null or empty texts). Whole texts are counted."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(load(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    slim = runtime.scan_tasks(docs.select(F.col(id_col).cast("long").alias("id"), *[F.col(c) for c in keep], F.col(text_col).alias("_text")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(count, f"{fields}, n_tokens long")
