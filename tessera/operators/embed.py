"""Embedding (F1): a pluggable batch model function, with a local default.

The default needs no network: lower-cased alphanumeric tokens -> unigrams and
word bigrams -> feature hashing -> IDF -> L2 normalisation, in NumPy on Arrow
batches, stored as a dense ``ARRAY<FLOAT>`` of ``dims`` values. A user model
plugs in through ``embed(df, fn)`` which calls ``fn(list[str]) ->
list[list[float]]`` on batches of ``batch`` texts inside ``mapInPandas``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessera.functions import text as T

DEFAULT_DIMS = 256
# Bytes of text worked through at a time (a longer text is worked through whole).
SLICE_BYTES = 1 << 20
# A word of more bytes is hashed on its own.
_LONG_WORD = 64
# Tokens: runs of letters and digits beyond ASCII or [a-z0-9_], A-Z folded.
_FOLD = np.array([b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 or b == 95 else b + 32 if 65 <= b < 91 else 32
                  for b in range(256)], np.uint8)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of every word of ``data``: all words' first bytes at once, then their second, and so on."""
    order = np.argsort((_LONG_WORD + 1 - np.minimum(size, _LONG_WORD + 1)).astype(np.uint8), kind="stable")
    at, left = start[order], size[order]
    long = int(np.searchsorted(-left, -_LONG_WORD, "left"))
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    longest = int(left[long]) if long < len(left) else 0
    counts = np.bincount(left[long:], minlength=longest + 1)
    n = len(left)
    for k in range(longest):
        n -= int(counts[k])  # words of exactly k bytes are done
        part = state[long:n]
        part[:] = _CRC[(part ^ data[at[long:n] + k]) & 0xFF] ^ (part >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        state[i] = zlib.crc32(data[at[i]:at[i] + left[i]].tobytes())
    out = np.empty(len(state), np.uint64)
    out[order] = state
    return out


def _counts(column: pa.Array, dims: int) -> np.ndarray:
    """Hashed unigram and bigram counts of a string column, one row per text; no Python object per word."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, ends, raw = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, int)
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    out = np.zeros((len(column), dims), np.float64)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE_BYTES, "right")) - 1)
        data = _FOLD[raw[ends[lo]:ends[hi]]]
        cut = ends[lo:hi + 1] - ends[lo]
        letter = np.append(data != 32, False)
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        first[cut[:-1]] = letter[cut[:-1]]  # a text begins a word of its own
        last = letter[:-1] & ~letter[1:]
        full = cut[1:][cut[1:] > cut[:-1]] - 1  # and ends one
        last[full] = letter[full]
        start = np.flatnonzero(first[:-1])
        size = np.flatnonzero(last) + 1 - start
        text = np.repeat(np.arange(hi - lo), np.diff(np.searchsorted(start, cut)))
        h = _word_hashes(data, start, size)
        pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) * np.uint64(0x85EBCA6B) >> np.uint64(16)
        inside = text[1:] == text[:-1]
        row = np.concatenate([text, text[1:][inside]])
        dim = (np.concatenate([h, pairs[inside]]) % np.uint64(dims)).astype(np.int64)
        out[lo:hi] = np.bincount(row * dims + dim, minlength=(hi - lo) * dims).reshape(hi - lo, dims)
        lo = hi
    return out


def _vectors(df: DataFrame, text_col: str, dims: int, out_col: str, weights: np.ndarray | None) -> DataFrame:
    others = [c for c in df.columns if c != out_col]
    schema = df.select(*others).schema.add(out_col, ArrayType(FloatType()))

    def run(it):
        for batch in it:
            m = _counts(batch.column(text_col), dims)
            if weights is not None:
                m *= weights
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.where(norm > 0, m / np.where(norm > 0, norm, 1.0), 0.0).astype(np.float32)
            flat = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * dims, pa.array(m.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*others, out_col])

    return df.select(*others).mapInArrow(run, schema)


def document_frequencies(df: DataFrame, text_col: str, dims: int) -> tuple[int, np.ndarray]:
    """(texts, texts that use each dimension): one pass, ``dims`` rows reach the driver."""
    def run(it):
        n, seen = 0, np.zeros(dims, np.int64)
        for batch in it:
            seen += (_counts(batch.column(0), dims) > 0).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims, dtype=np.int32)),
                                          pa.array(np.concatenate([[n], seen]))], ["d", "n"])

    rows = df.select(text_col).mapInArrow(run, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).collect()
    total = {r["d"]: r["n"] for r in rows}
    return total.get(-1, 0), np.array([total.get(i, 0) for i in range(dims)], np.float64)


def hashed_tfidf(df: DataFrame, text_col: str = "text", dims: int = DEFAULT_DIMS,
                 out_col: str = "embedding") -> DataFrame:
    """Dense unit-length hashed TF-IDF vectors of ``text_col``.

    Two passes over the texts: document frequencies (an aggregate of ``dims``
    rows), then the vectors. Nothing is cached.
    """
    n, seen = document_frequencies(df, text_col, dims)
    return _vectors(df, text_col, dims, out_col, np.log((n + 1.0) / (seen + 1.0)))


def hashed_tf(df: DataFrame, text_col: str = "text", dims: int = DEFAULT_DIMS,
              out_col: str = "embedding") -> DataFrame:
    """Stateless variant: hashed unigram+bigram counts, L2-normalised.

    Nothing is fitted, so vectors appended in different runs (or streaming
    micro-batches) share one space; this is the default for incremental stores.
    """
    return _vectors(df, text_col, dims, out_col, None)


def embed(df: DataFrame, fn: Callable[[list[str]], list[list[float]]] | None = None, text_col: str = "text",
          batch: int = 500, max_chars: int | None = None, dims: int = DEFAULT_DIMS) -> DataFrame:
    """Add ``embedding ARRAY<FLOAT>`` for ``text_col`` (F1).

    Whole texts by default; ``max_chars`` (8,000 for the reference's remote
    model) only when the model function has an input limit.
    """
    clipped = df if max_chars is None else df.withColumn(text_col, T.clip(F.col(text_col), max_chars))
    if fn is None:
        return hashed_tfidf(clipped, text_col, dims)
    schema = f"{clipped.schema.simpleString()[7:-1]}, embedding array<float>"

    def run(it):
        for pdf in it:
            parts = []
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s:s + batch]
                vecs = fn(part[text_col].fillna("").tolist())
                parts.append(part.assign(embedding=[list(map(float, v)) for v in vecs]))
            yield pd.concat(parts) if parts else pdf.assign(embedding=[])

    return clipped.mapInPandas(run, schema)
