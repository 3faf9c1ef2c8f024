"""All pairs within groups of any size, cut into tiles that fit a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def with_tiles(members: DataFrame, group: list[str], size: str, node: str, block: int) -> DataFrame:
    """Adds lo, hi and side: a group of more than ``block`` rows is cut into blocks by node hash.

    Every two blocks, and every block with itself, meet in one tile; a row is repeated once for
    each block of its group. ``size`` holds the group's number of rows.
    """
    n = F.ceil(F.col(size) / block).cast("long")
    d = members.withColumn("side", F.pmod(F.xxhash64(F.col(node), F.lit(17)), n))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return d.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other")).drop("other")


def over_tiles(tiles: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]],
               schema: str, order: tuple = ("side", "node")) -> DataFrame:
    """Run ``fn(rows, bounds)`` on whole tiles, many small ones at a time; bounds cut rows into tiles.

    A tile is the rows of equal ``keys`` (whole numbers), in ``order``; it must fit a task.
    """
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            code = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            first = tuple(c[0] for c in code)
            if last is not None and first != last and sum(b.nbytes for b in held) >= 2 << 20:
                yield from whole(held)
                held = []
            change = np.zeros(batch.num_rows, bool)
            for c in code:
                change[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(change)
            if len(at):  # all tiles but the last are whole
                yield from whole(held + [batch.slice(0, int(at[-1]))])
                held = [batch.slice(int(at[-1]))]
            else:
                held.append(batch)
            last = tuple(c[-1] for c in code)
        if held:
            yield from whole(held)

    def whole(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(rows.num_rows, bool)
        for k in keys:
            c = rows.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(change), [rows.num_rows]])
        yield from fn(rows, bounds)

    return tiles.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
