"""Connected components as DataFrame jobs: stars within tasks, then one step up, until nothing moves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from askloom.llm.common import stored

HELD = 1 << 20  # edges that a task joins at a time
EDGE = "u long, v long"


def _mark(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0))).first()
    return row[0], row[1]


def _stars(batches):
    """Every HELD edges as (node, least node that they link it with)."""
    def joined(held):
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = forest(len(names), at[:len(u)], at[len(u):])
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield joined(held)
            held, n = [], 0
    if n:
        yield joined(held)


def _round(edges: DataFrame) -> DataFrame:
    """Links a node's smaller neighbours with the least of them, then every node with its neighbour's least one.

    After the stars this is all Spark expressions: tables of few edges in many partitions cost no
    Python call for each partition. No step makes rows: an edge is moved to smaller nodes or goes.
    """
    by = Window.partitionBy("u").orderBy("v")
    near = edges.mapInArrow(_stars, EDGE).select("u", "v", F.first("v").over(by).alias("m"), F.lag("v").over(by).alias("b"))
    near = near.where("b is null or b <> v").select(
        F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    up = near.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("w"))
    return near.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v"))


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Node and the least node it is linked with, for every node that has an edge.

    After ``rounds``, where given, some roots may still be other nodes of their component.

    ``edges``: u, v (long), either way round, repeats and loops allowed; edges with a null are
    left out. Tasks turn the edges they read into stars before the shuffle, so a node with very many
    neighbours is one row for every HELD edges; the join's wide side can be split by adaptive
    execution. Every round's edges are a written table. Empty input gives an empty result.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(
        F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    e = stored(e.mapInArrow(_stars, EDGE), "links")
    mark = _mark(e)
    done = 0
    while mark[0] and done != rounds:
        done += 1
        e = stored(_round(e), "links")
        if done != rounds:
            last, mark = mark, _mark(e)
            if mark == last:
                break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index that each of n items is linked with, for links a[i] - b[i] that fit a task."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            return root
        root = new
