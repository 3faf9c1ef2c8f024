"""Text to vector: a deterministic hashed bag of words, or any column the caller already has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf

from askloom.functions.text import words

DIM = 256
BATCH_ROWS = 1024               # texts whose counts are held at a time


def word_buckets(text, dim: int = DIM) -> Column:
    """Bucket of every word: the first 8 hex digits of its md5, modulo ``dim``."""
    return F.transform(words(text), lambda w: F.pmod(
        F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int"))


def embed_text(text, dim: int = DIM) -> Column:
    """Counts per bucket, scaled to length one; a text without words gives the zero vector.

    Hashing stays in the JVM; only the small bucket lists go through Arrow, where one histogram
    serves a thousand texts.
    """

    def of(buckets: pa.Array) -> pa.Array:
        n = len(buckets)
        sizes = np.diff(buckets.offsets.to_numpy())
        rows = np.repeat(np.arange(n, dtype=np.int64), sizes)
        flat = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.bincount(rows * dim + flat, minlength=n * dim).reshape(n, dim).astype(np.float64)
        norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = (counts / np.where(norm > 0, norm, 1.0)).astype(np.float32)
        return pa.ListArray.from_arrays(
            pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)), pa.array(unit.ravel()))

    @arrow_udf("array<float>")
    def histogram(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for lo in range(0, len(batch), BATCH_ROWS):
                yield of(batch.slice(lo, BATCH_ROWS))

    empty = F.array().cast("array<int>")
    return histogram(F.coalesce(word_buckets(text, dim), empty))
