"""Shared helpers of the text operators: word spans and hashes in numpy, stored intermediates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from askloom.session import scratch_path, ship

#: Words are runs of anything but these: [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def prepare(spark: SparkSession) -> None:
    """Ready a session for the operators that work on Arrow batches.

    Batches of few rows keep long texts from filling a worker; the package goes to the workers.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_of_id(name: str = "doc_id"):
    """Unsigned crc32 of an id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One text column as (bytes, offsets); a null is an empty text. No copy where there is none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text; a longer text is a range of its own."""
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n-1) modulo 2 ** 64; a table of up to 8 M entries is kept."""
    key = int(base)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n > 1 else 1 << 16
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if size <= 8 << 20:
            _POWERS[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all positions."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word, in order; words end where their text ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal bytes, equal hash, wherever the span lies."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(data), BASE_INV)[starts])


def per_text(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of the first word of every text, and the number of words at the end."""
    return np.searchsorted(starts, offsets, "left")


def run_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and the bounds of each text's runs.

    A text of fewer words has one run of all its words; one of no words has none.
    """
    n = np.diff(bounds)
    runs = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out = np.concatenate([[0], np.cumsum(runs)])
    if not len(words):
        return np.zeros(0, np.uint64), out
    at = np.repeat(bounds[:-1], runs) + np.arange(out[-1]) - np.repeat(out[:-1], runs)
    size = np.repeat(np.minimum(n, width), runs)
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = k < size
        total = total * BASE + np.where(inside, words[np.minimum(at + k, len(words) - 1)], np.uint64(0))
    return mix(total), out


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = 2 << 20,
           gap: np.ndarray = SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) of about ``most`` bytes each; a longer text comes in several.

    Parts of one text meet in a gap byte that both have, so each word, with the gap bytes beside
    it, lies whole in one part, however long it is.
    """
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        at, end = int(offsets[lo]), int(offsets[hi])
        if end - at <= most:
            yield lo, data[at:end], offsets[lo:hi + 1] - at
        else:
            while at < end:
                stop, start = end, at + most
                while start < end:
                    gaps = np.flatnonzero(gap[data[start:start + most]][:end - start])
                    if len(gaps):
                        stop = start + int(gaps[0]) + 1
                        break
                    start += most
                yield lo, data[at:stop], np.array([0, stop - at])
                if stop >= end:
                    break
                at = stop - 1
        lo = hi
