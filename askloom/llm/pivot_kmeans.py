"""Centroid clustering in whole numbers, with Ptolemaic lower bounds from cached pivot distances.

For points x, c and pivots p, s Ptolemy's inequality gives
    d(x, c) * d(p, s) >= |d(x, p) * d(c, s) - d(x, s) * d(c, p)|.
The distances of every vector to the pivots are computed once and stored beside it; a round needs
only those of the centroids. A centroid whose bound, rounded down, is beyond an exact distance
already known cannot be nearest; the others are measured exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from askloom.llm.common import stored

SCALE = 1024
#: Components beyond this size (in units of 1 / SCALE) count as this size: squared distances of up
#: to 64 components then fit 63 bits.
LARGEST = 1 << 27
#: More than the relative error of a few double operations.
SLACK = 1e-12
_ROWS = 4096


def integer_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, v (array of long): rows with exactly ``dim`` components, none null or non-finite."""
    x = F.col("embedding").cast("array<double>")
    ok = F.expr(f"size(x) = {dim} and forall(x, e -> e is not null and not isnan(e) and abs(e) < double('infinity'))")
    held = f"cast(floor(greatest(least(e, {LARGEST / SCALE}D), -{LARGEST / SCALE}D) * {SCALE}) as bigint)"
    return vectors.select("vec_id", x.alias("x")).where(F.coalesce(ok, F.lit(False))).select(
        "vec_id", F.expr(f"transform(x, e -> {held})").alias("v"))


def first_centroids(kept: DataFrame, k: int) -> list[list[int]]:
    """The k vectors of least hash of their id, equal hashes by components; a null id is an empty one."""
    name = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r["v"] for r in kept.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to c."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Nearest:
    """Nearest of some centroids, by bounds from pivot distances; ties go to the smaller number."""

    def __init__(self, centroids: list[list[int]], pivots: list[list[int]]):
        self.centroids = np.array(centroids, np.int64)
        p = np.array(pivots, np.int64)
        own = np.sqrt(np.stack([squared(p, q) for q in p]).astype(float))
        self.to = np.sqrt(np.stack([squared(p, c) for c in self.centroids]).astype(float))  # centroid, pivot
        self.pairs = [(a, b, own[a, b]) for a, b in combinations(range(len(p)), 2) if own[a, b] > 0]

    def bounds(self, far: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances, (rows, centroids), never above the true ones."""
        low = np.zeros((len(far), len(self.centroids)))
        for a, b, apart in self.pairs:
            left, right = far[:, a, None] * self.to[None, :, b], far[:, b, None] * self.to[None, :, a]
            np.maximum(low, (np.abs(left - right) - SLACK * (left + right)) / apart, out=low)
        return low * low * (1 - SLACK)

    def assign(self, x: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Cluster and exact squared distance of every row, and how many distances were measured."""
        low = self.bounds(far)
        rows = np.arange(len(x))
        best = low.argmin(axis=1)
        d = x - self.centroids[best]
        least = np.einsum("ij,ij->i", d, d)
        low[rows, best] = np.inf
        measured = len(x)
        for c in range(len(self.centroids)):
            at = np.flatnonzero(low[:, c] <= least)
            if not len(at):
                continue
            measured += len(at)
            d = squared(x[at], self.centroids[c])
            new = (d < least[at]) | (d == least[at]) & (c < best[at])
            least[at[new]], best[at[new]] = d[new], c
        return best, least, measured


def _blocks(batches: Iterator[pa.RecordBatch], dim: int):
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            part = batch.slice(lo, _ROWS)
            yield part, _matrix(part.column("v"), dim), part.column("far")


def with_pivots(kept: DataFrame, pivots: list[list[int]], dim: int) -> DataFrame:
    """vec_id, v, far: the distances to the pivots, computed once."""
    p = np.array(pivots, np.int64)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            far = np.stack([np.sqrt(squared(x, q).astype(float)) for q in p], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"),
                 pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), len(p)).cast(pa.list_(pa.float64()))],
                ["vec_id", "v", "far"])

    return kept.mapInArrow(run, "vec_id long, v array<long>, far array<double>")


def _sums(table: DataFrame, near: Nearest, dim: int) -> DataFrame:
    """cluster, place, total: componentwise sums of a round's clusters; place ``dim`` holds the counts."""
    def run(batches):
        k = len(near.centroids)
        total, least = np.zeros((k, dim + 1), np.int64), 0
        for _, x, far in _blocks(batches, dim):
            best, _, _ = near.assign(x, _matrix(far, len(near.to[0])))
            for c in np.unique(best):
                mine = x[best == c]
                total[c, :dim] += mine.sum(axis=0)
                total[c, dim] += len(mine)
            least += len(x)
            if least >= 1 << 30:  # sums of so many components fit 63 bits
                yield rows(total)
                total, least = np.zeros((k, dim + 1), np.int64), 0
        yield rows(total)

    def rows(total):
        k = len(total)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k, dtype=np.int32), dim + 1)), pa.array(np.tile(np.arange(dim + 1, dtype=np.int32), k)),
             pa.array(total.ravel())], ["cluster", "place", "total"])

    return table.select("v", "far").mapInArrow(run, "cluster int, place int, total long").groupBy("cluster", "place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept vector.

    Needs vec_id and embedding (array of numbers); other columns are ignored. Rows whose embedding is
    null, has not exactly ``dim`` components or holds a null or non-finite one are left out; with no
    row left the result is empty. Components become floor(1024 * x); beyond +-131072 they count as
    that. Rows that repeat a vec_id, and those without one, are vectors of their own. With fewer than
    ``k`` vectors there are that many centroids; a centroid that wins no vector stays as it is.
    Sums are exact; cluster_inertia and inertia are null where they pass 63 bits.

    The first centroids serve as the pivots. Every round is a scan of the stored vectors that sends k
    sums from each task; only sums and centroids (k vectors) pass through the driver.
    """
    kept = integer_vectors(vectors, dim)
    centroids = first_centroids(kept, k)
    if not centroids:
        return kept.select("vec_id").where("false").selectExpr(
            "vec_id", "cast(0 as int) cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256")
    pivots = [list(c) for c in centroids]
    table = stored(with_pivots(kept, pivots, dim), "vectors")
    for _ in range(rounds):
        sums: dict[int, dict[int, int]] = {}
        for r in _sums(table, Nearest(centroids, pivots), dim).collect():
            sums.setdefault(r["cluster"], {})[r["place"]] = int(r["total"])
        moved = [[s[i] // s[dim] for i in range(dim)] if (s := sums.get(c, {})).get(dim) else old
                 for c, old in enumerate(centroids)]
        if moved == centroids:  # further rounds give the same
            break
        centroids = moved
    near = Nearest(centroids, pivots)

    def run(batches):
        for part, x, far in _blocks(batches, dim):
            best, least, _ = near.assign(x, _matrix(far, len(pivots)))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(least)], ["vec_id", "cluster", "distance"])

    done = stored(table.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    names = [(c, fits(inertia.get(c, 0)), fits(sum(inertia.values())),
              hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    facts = done.sparkSession.createDataFrame(
        names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """The same in DuckDB SQL: every vector against every centroid, round by round."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, [floor(
    greatest(least(e::DOUBLE, {LARGEST / SCALE}), -{LARGEST / SCALE}) * {SCALE})::BIGINT FOR e IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {dim}
    AND len([e FOR e IN embedding IF e IS NULL OR isnan(e) OR isinf(e)]) = 0)""", f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept
  QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT i, min(row(d, c)) AS m FROM (
    SELECT i, c0.c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(kept.v, c0.v)]) AS d
    FROM kept, c{r} AS c0) GROUP BY i)""")
        if r < rounds:
            steps.append(f"""s{r} AS MATERIALIZED (
  SELECT c, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY place) AS v FROM (
    SELECT m[2] AS c, place, sum(e) AS t, count(*)::HUGEINT AS n FROM (
      SELECT a.m, unnest(k.v)::HUGEINT AS e, unnest(range({dim})) AS place FROM a{r} AS a JOIN kept AS k USING (i))
    GROUP BY ALL) GROUP BY c)""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(s.v, o.v) AS v FROM c{r} AS o LEFT JOIN s{r} AS s USING (c))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT k.vec_id, a.m[2]::INTEGER AS cluster, a.m[1]::BIGINT AS distance,
  (sum(a.m[1]) OVER (PARTITION BY a.m[2]))::BIGINT AS cluster_inertia, (sum(a.m[1]) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN kept AS k USING (i) JOIN c{rounds} AS c ON c.c = a.m[2]"""
