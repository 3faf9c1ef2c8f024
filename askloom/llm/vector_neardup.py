"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from askloom.llm.common import stored
from askloom.llm.components import connected_components, forest
from askloom.llm.tiles import over_tiles, with_tiles

BLOCK = 1024


def tables_for(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits and tables: a bucket of unrelated vectors stays small as the corpus grows, and a pair
    at the threshold meets in some table with probability ``recall``."""
    bits = min(60, max(8, math.ceil(math.log2(max(n, 2)))))
    same = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-same))


def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def _signs(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One key per row and table."""
    flat = (x @ _planes(x.shape[1], bits, tables, seed) > 0).reshape(len(x), tables, bits)
    return flat @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vector_links(distinct: DataFrame, cosine: float, recall: float, seed: int) -> DataFrame:
    """node, links, root for rows (node, n, dim, v) of different vectors; several rows per node.

    A pair is counted in the first table whose bucket both are in, so once. ``links`` sums the
    partners' n; ``root`` is the least node of those linked in the tile. Buckets of any size are
    compared, in tiles of two blocks.
    """
    bits, tables = tables_for(distinct.count(), cosine, recall)

    def keys(batches):
        for b in batches:
            node, dim = b.column("node").to_numpy(), b.column("dim").to_numpy()
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = _unit(np.array(b.column("v").take(pa.array(at)).to_pylist(), float))
                k = _signs(x, bits, tables, seed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(node[at], tables)), pa.array(np.full(len(at) * tables, d, np.int32)),
                     pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(k.ravel())],
                    ["node", "dim", "t", "key"])

    group = ["dim", "t", "key"]
    dealt = stored(distinct.mapInArrow(keys, "node long, dim int, t int, key long"), "signs")
    sizes = dealt.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = dealt.join(sizes, group).join(distinct.select("node", "n", "v"), "node")

    def compare(rows: pa.Table, bounds: np.ndarray):
        node, n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        side, lo, hi = (rows.column(c).to_numpy() for c in ("side", "lo", "hi"))
        t, values = rows.column("t").to_numpy(), rows.column("v").combine_chunks()
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            x = _unit(values.slice(a, b - a).flatten().to_numpy().astype(float).reshape(b - a, -1))
            cut = b - a if lo[a] == hi[a] else int((side[a:b] == lo[a]).sum())
            right = x if lo[a] == hi[a] else x[cut:]
            i, j = np.nonzero(x[:cut] @ right.T >= cosine)
            if lo[a] == hi[a]:
                i, j = i[i < j], j[i < j]
            else:
                j = j + cut
            if not len(i):
                continue
            if t[a]:
                k = _signs(x, bits, tables, seed)[:, :int(t[a])]
                new = np.ones(len(i), bool)
                for s in range(0, len(i), 1 << 16):
                    new[s:s + (1 << 16)] = ~(k[i[s:s + (1 << 16)]] == k[j[s:s + (1 << 16)]]).any(axis=1)
                i, j = i[new], j[new]
                if not len(i):
                    continue
            links = np.bincount(i, n[a:b][j], b - a) + np.bincount(j, n[a:b][i], b - a)
            root = node[a:b][forest(b - a, i, j)]
            at = np.flatnonzero(links)
            out.append((node[a:b][at], links[at].astype(np.int64), root[at]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["node", "links", "root"])

    tiles = with_tiles(members, group, "size", "node", BLOCK).select(*group, "lo", "hi", "side", "node", "n", "v")
    return over_tiles(tiles, [*group, "lo", "hi"], compare, "node long, links long, root long")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.999, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Needs vec_id and embedding (array of numbers); other columns are ignored. Cosines are taken in
    double precision. Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing, and vectors of different lengths not with each other. Equal vectors become
    one row with a count before the tables are built (keys are 64-bit hashes of the components),
    and their number counts in n_links. component_id is the least vec_id reachable by links; a row with a null
    vec_id counts as a partner but cannot name a component: it has component_id null and kept
    false if no other member has an id. Rows that repeat a vec_id are vectors of their own.
    """
    v = F.col("embedding").cast("array<double>")
    ok = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
                "and exists(v, x -> x <> 0)")
    rows = vectors.select("vec_id", v.alias("v")).withColumn("ok", F.coalesce(ok, F.lit(False)))
    rows = rows.withColumn("v", F.expr("if(ok, transform(v, x -> x + 0.0D), null)"))  # -0 as 0
    rows = rows.withColumn("node", F.when(F.col("ok"), F.xxhash64(F.size("v"), "v")))
    good = rows.where("ok")
    distinct = stored(good.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
        .withColumn("dim", F.size("v")), "vectors")
    found = stored(vector_links(distinct, cosine, recall, seed), "links")
    roots = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = (distinct.select("node", "n", "least").join(links, "node", "left").join(roots, "node", "left")
               .withColumn("root", F.coalesce("root", "node")))
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(names, "root").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(classes, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
