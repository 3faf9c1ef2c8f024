"""Separator-aware greedy chunking.

A page is cut into leaves: pieces that start with their separator. A piece that is still too long
is cut again with the separators that come after. Leaves of one level that follow each other are
packed greedily, keeping a tail of whole leaves as overlap. Pages never move and the work is linear
in the text: it goes leaf by leaf through an Arrow UDF, since a fold in SQL copies all chunks so
far at every leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from askloom.functions.text import WHITESPACE
from askloom.sources.files import SHORT_HASH

# Chunk size and overlap in characters, separators in order of preference.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 150
BATCH_BYTES = 1 << 20           # text cut at a time
SEPARATORS = ["\n\n", "\n", " "]


def _leaves(text: str, seps: list[str], size: int, group: tuple):
    """(piece, group) in reading order; pieces of one group side by side may be packed."""
    while seps and seps[0] not in text:
        seps = seps[1:]
    if not seps:
        yield text, (*group, None)
        return
    sep, at = seps[0], 0
    for i, part in enumerate(text.split(sep)):
        piece = part if i == 0 else sep + part
        if not piece:
            continue
        if len(piece) < size:
            yield piece, group
        else:
            yield from _leaves(piece, seps[1:], size, (*group, at))
        at += 1


def chunks_of(text: str, size: int, overlap: int, seps: list[str]) -> list[str]:
    """The chunks of one text: leaves are held until the next would not fit or is of another group.

    A full chunk leaves the longest run of whole leaves at its end that is no longer than the
    overlap and fits together with the next leaf.
    """
    out, held, total, group = [], [], 0, ()

    def flush():
        if chunk := "".join(held).strip(WHITESPACE):
            out.append(chunk)

    for leaf, g in _leaves(text, seps, size, (0,)):
        if g != group:
            flush()
            held, total, group = [], 0, g
        elif total + len(leaf) > size:
            flush()
            room, keep, first = min(overlap, size - len(leaf)), 0, len(held)
            while first and keep + len(held[first - 1]) <= room:
                first -= 1
                keep += len(held[first])
            held, total = held[first:], keep
        held.append(leaf)
        total += len(leaf)
    flush()
    return out


def pieces(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """Slices of up to ``most`` bytes, or of one longer text, so that Python holds few texts at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def split_text(column: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               separators: list[str] | None = None) -> Column:
    """The chunks of a text column, in reading order; none for a null text."""
    seps = list(SEPARATORS if separators is None else separators)

    @arrow_udf("array<string>")
    def chunks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in pieces(texts):
                yield pa.array([None if t is None else chunks_of(t, size, overlap, seps) for t in part.to_pylist()],
                               pa.list_(pa.string()))

    return chunks(F.col(column))


def chunk_pages(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                separators: list[str] | None = None) -> DataFrame:
    """One row per chunk in place of ``text``; ``chunk_idx`` counts from 0 on each page."""
    keep = [c for c in pages.columns if c != "text"]
    # The outer form: for the inner one the optimizer adds a filter that cuts every page again.
    return pages.select(*keep, F.posexplode_outer(
        split_text("text", size, overlap, separators)).alias("chunk_idx", "text")
    ).filter(F.col("text").isNotNull())


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Add the chunk id made of short document hash, page and chunk number."""
    return chunks.withColumn("id", F.format_string(
        "doc_%s_p%d_c%d", F.substring("file_hash", 1, SHORT_HASH), F.col("page"), F.col("chunk_idx")))
