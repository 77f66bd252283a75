"""Deterministic text embedding: words by Spark, hashes and sums by numpy on Arrow batches.

The vector has four quarters of ``dim/4`` values:

1. hashes of byte 2-, 3- and 4-grams (all 2-grams first), first dim/4 only;
2. mean word byte length / 20, then the top-10 relative word frequencies;
3. relative term frequencies (frequency-descending, so the output is
   deterministic), then ln(n_words + 1) / 10;
4. a ramp ``h * (i+1) / (dim/4)`` from the hash of the whole text;

then L2-normalized in float32 arithmetic. Hash-to-[0,1] is the first 8 bytes
of SHA-256 (big endian) divided by 2^64.
"""

from __future__ import annotations

import hashlib
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..operators.normalize import unicode_trim
from .text import col_

TWO64 = 18446744073709551616.0
ROWS = 1024  # texts that are embedded at a time
WORD_RE = "[\\p{L}\\p{Nd}_-]+"


def tokens(text) -> Column:
    """Runs of letters, digits, '_' and '-' of the lower-cased, trimmed text."""
    return F.regexp_extract_all(col_(text), F.lit(WORD_RE), 0)


def prepared(text) -> Column:
    return F.lower(unicode_trim(col_(text)))


@cache
def _pair_hashes() -> np.ndarray:
    """E3 of every 2-gram."""
    return np.array([_unit(bytes((i >> 8, i & 255))) for i in range(1 << 16)], np.float32)


def _unit(b: bytes) -> float:
    return int.from_bytes(hashlib.sha256(b).digest()[:8], "big") / TWO64


@lru_cache(1 << 18)
def _gram(b: bytes) -> float:
    return _unit(b)


def _grams(out: np.ndarray, texts: pa.Array) -> None:
    """E2 + E3: hashes of the first byte n-grams (n = 2, then 3, then 4), as many as ``out`` has columns."""
    q = out.shape[1]
    edges, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:][:len(texts) + 1], np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    size = np.diff(edges)
    if len(data):
        codes = data[np.minimum(edges[:-1, None] + np.arange(q + 1), len(data) - 1)].astype(np.int64)
        out[:] = np.where(np.arange(q) < size[:, None] - 1, _pair_hashes()[(codes[:, :-1] << 8) | codes[:, 1:]], 0)
    for row in np.flatnonzero((size <= q) & (size > 2)).tolist():
        b, at = data[edges[row]:edges[row + 1]].tobytes(), int(size[row]) - 1
        more = [_gram(b[i:i + n]) for n in (3, 4) for i in range(min(q, len(b) - n + 1))][:q - at]
        out[row, at:at + len(more)] = more


def _vectors(texts: pa.Array, words: pa.Array, logs: pa.Array, dim: int) -> np.ndarray:
    """E1-E8 of texts, their words and ln(number of words + 1)."""
    q, rows = dim // 4, len(texts)
    out, texts, logs = np.zeros((rows, dim), np.float32), texts.cast(pa.large_binary()), logs.to_numpy(zero_copy_only=False)
    _grams(out[:, :q], texts)
    n, flat = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64), words.flatten()
    own = np.repeat(np.arange(rows), n)
    # Occurrences of each distinct word of a text, most frequent first.
    codes = flat.dictionary_encode()
    kinds = max(1, len(codes.dictionary))
    pairs, counts = np.unique(own * kinds + codes.indices.to_numpy(zero_copy_only=False), return_counts=True)
    of = pairs // kinds
    order = np.lexsort((-counts, of))
    counts, distinct = counts[order], np.bincount(of, minlength=rows)
    place = np.arange(len(of)) - np.repeat(np.cumsum(distinct) - distinct, distinct)
    tf = counts / n[of]
    size = np.bincount(own, pc.binary_length(flat).to_numpy(zero_copy_only=False), rows)
    some = n > 0
    out[some, q] = size[some] / n[some] / 20.0
    top = place < min(10, q - 1)
    out[of[top], q + 1 + place[top]] = tf[top]
    fits = place < q
    out[of[fits], 2 * q + place[fits]] = tf[fits]
    fits = distinct < q
    out[fits, 2 * q + distinct[fits]] = logs[fits] / 10.0
    h = np.array([_unit(b) for b in texts.to_pylist()]).reshape(-1, 1)
    out[:, 3 * q:] = h * np.arange(1, q + 1) / float(q)
    return _normalized(out)


def _normalized(v: np.ndarray) -> np.ndarray:
    """L2 normalization with float32 products and a float64 running sum."""
    ss = np.add.accumulate((v * v).astype(np.float64), axis=1)[:, -1]
    scale = (1.0 / np.sqrt(np.where(ss > 0, ss, 1.0))).astype(np.float32)
    return np.where((ss > 0)[:, None], v * scale[:, None], v)


def embed(text, dim: int = P.VECTOR_DIM) -> Column:
    """``ARRAY<FLOAT>`` of length ``dim``. Spark lower-cases and cuts the words; hashes and
    sums are made by numpy, for a batch of texts at a time."""
    q = dim // 4

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors(t: pa.Array, words: pa.Array, logs: pa.Array) -> pa.Array:
        parts = [_vectors(t[i:i + ROWS], words[i:i + ROWS], logs[i:i + ROWS], dim) for i in range(0, len(t), ROWS)]
        flat = np.concatenate(parts).reshape(-1) if parts else np.empty(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * dim), pa.array(flat))

    t = prepared(text)
    words = tokens(t)
    made = vectors(F.coalesce(t, F.lit("")).cast("binary"), F.coalesce(words, F.array().cast("array<string>")).cast("array<binary>"),
                   F.coalesce(F.log(F.size(words) + 1.0), F.lit(0.0)))
    none = lambda n, v: F.array_repeat(F.lit(v).cast("float"), n)
    return F.when(col_(text).isNull(), F.concat(none(2 * q, 0.0), none(1, None), none(q - 1, 0.0), none(q, None))).otherwise(made)


def shared_tokens(a, b) -> Column:
    """Tokens shared by two texts (explanation of a hit)."""
    return F.array_intersect(F.array_distinct(tokens(prepared(a))), F.array_distinct(tokens(prepared(b))))
