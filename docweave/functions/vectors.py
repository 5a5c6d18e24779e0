"""Vector expressions and the built-in deterministic embedding."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 256
PROVIDER = "builtin"
MODEL = "hashed-words"

_WORD = re.compile(r"[^\W_]+")
_BUCKET: dict[str, int] = {}
_BUCKET_LIMIT = 200_000


def _bucket(word: str) -> int:
    bucket = _BUCKET.get(word)
    if bucket is None:
        bucket = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % DIM
        if len(_BUCKET) < _BUCKET_LIMIT:
            _BUCKET[word] = bucket
    return bucket


SLICE = 1024  # texts whose counts are held at once


@F.arrow_udf(T.ArrayType(T.FloatType()))
def embed(texts: pa.Array) -> pa.Array:
    """Word counts hashed into DIM buckets, scaled to unit length; zeros for a wordless text."""
    vectors = np.zeros((len(texts), DIM), dtype=np.float32)
    for start in range(0, len(texts), SLICE):
        vectors[start : start + SLICE] = _counted(texts.slice(start, SLICE))
    offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * DIM)
    return pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))


def _counted(texts: pa.Array) -> np.ndarray:
    buckets, sizes = [], np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        words = _WORD.findall((text.as_py() or "").lower())
        found = list(map(_BUCKET.get, words))
        buckets += map(_bucket, words) if None in found else found
        sizes[row] = len(words)
    cells = np.repeat(np.arange(len(texts)) * DIM, sizes) + np.array(buckets, np.int64)
    vectors = np.bincount(cells, minlength=len(texts) * DIM).astype(np.float64).reshape(-1, DIM)
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=vectors, where=norms > 0)


def norm(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def unit(vector: Column) -> Column:
    """Scaled to length one; a zero vector stays as it is."""
    length = norm(vector)
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length)).otherwise(
        F.transform(vector, lambda x: x.cast("double"))
    )


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
