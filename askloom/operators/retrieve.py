"""Nearest chunks per question: exact, or approximate through hashed buckets.

Neither form emits pairs: every task multiplies a block of questions with a block of chunks and
keeps the best ``k`` per question, so what is shuffled is questions x tasks x k rows.
"""

from __future__ import annotations

import math
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from askloom.session import checkpointed

TOP_K = 10                      # fixed value: candidates per question
BROADCAST_BYTES = 64 << 20      # questions are broadcast up to this size
SCAN_ROWS = 2_048               # chunks multiplied at a time with broadcast questions
BLOCK_ROWS = 20_000             # rows per side of a block otherwise
FIT_QUESTIONS = 64              # searched exactly to size the hashed form
MAX_TABLES = 64                 # copies of a vector that the hashed form may make
_ROUND = 9


def _matrix(column) -> np.ndarray:
    """Unit rows from an Arrow list column, in double."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm > 0, norm, 1.0)


def _best(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, held=None, step: int = 256):
    """The best k (question, distance, id) per question among ``held`` and this block."""
    limit = np.full(len(q), np.inf)
    parts = []
    if held is not None:
        parts.append(held)
        at, n = np.unique(held[0], return_counts=True)
        worst = np.maximum.reduceat(held[1], np.r_[0, np.cumsum(n)[:-1]]) if len(n) else held[1]
        limit[at[n >= k]] = worst[n >= k]
    for lo in range(0, len(q), step):
        d = np.round(1.0 - q[lo:lo + step] @ c.T, _ROUND)
        cap = limit[lo:lo + step]
        if c.shape[0] > k:
            cap = np.minimum(cap, np.partition(d, k - 1, axis=1)[:, k - 1])
        rows, cols = np.nonzero(d <= cap[:, None])
        parts.append((rows + lo, d[rows, cols], ids[cols]))
    row, dist, ident = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((ident, dist, row))
    row, dist, ident = row[order], dist[order], ident[order]
    start = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    place = np.arange(len(row)) - np.maximum.accumulate(np.where(start, np.arange(len(row)), 0))
    keep = place < k
    return row[keep], dist[keep], ident[keep]


def _ids(column) -> np.ndarray:
    a = column.to_numpy(zero_copy_only=False)
    return a.astype(str) if a.dtype == object else a


def _partial_schema(queries, chunks):
    return T.StructType([
        T.StructField("req_id", queries.schema["req_id"].dataType),
        T.StructField("id", chunks.schema["id"].dataType),
        T.StructField("distance", T.DoubleType())])


def _rank(found: DataFrame, k: int) -> DataFrame:
    """Final rank per question. Salted first, so no task sees all partial results of one."""
    order = (F.col("distance"), F.col("id"))
    salted = Window.partitionBy("req_id", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy(*order)
    some = found.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(
        Window.partitionBy("req_id").orderBy(*order))).filter(F.col("rank") <= k)


def _whole(df: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` numbers; null, ragged or holed vectors are near nothing."""
    e = F.col("embedding")
    return df.filter((F.size(e) == dim) & ~F.exists(e, lambda x: x.isNull()))


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int = TOP_K,
                broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(req_id, embedding)`` x ``(id, embedding)`` -> ``req_id, id, distance, rank``.

    Exact cosine order, ties by id. Questions are broadcast when a count says they are small
    enough; otherwise both sides are cut into blocks that meet in one task each.
    """
    queries, chunks = queries.select("req_id", "embedding"), chunks.select("id", "embedding")
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"),
                       F.sum(F.length(F.col("req_id").cast("string"))).alias("ids")).first()
    queries, chunks = _whole(queries, size["d"] or 0), _whole(chunks, size["d"] or 0)
    schema = _partial_schema(queries, chunks)
    if size["n"] * (size["d"] or 0) * 8 + (size["ids"] or 0) <= broadcast_bytes:
        table = queries.toArrow()
        shared = chunks.sparkSession.sparkContext.broadcast(
            (table.column("req_id").combine_chunks(), _matrix(table.column("embedding"))))

        def scan(batches):
            req, q = shared.value
            held = None
            for whole in batches:
                for lo in range(0, whole.num_rows if len(q) else 0, SCAN_ROWS):
                    b = whole.slice(lo, SCAN_ROWS)
                    held = _best(q, _matrix(b.column(1)), _ids(b.column(0)), k, held)
            if held is not None:
                yield pa.RecordBatch.from_arrays(
                    [req.take(pa.array(held[0])), pa.array(held[2]), pa.array(held[1])],
                    names=["req_id", "id", "distance"])

        return _rank(chunks.mapInArrow(scan, schema), k)
    one = F.lit(0)
    return _rank(_blocks(queries.withColumn("bucket", one), chunks.withColumn("bucket", one),
                         schema, k, block_rows), k)


def _blocks(queries, chunks, schema, k, block_rows) -> DataFrame:
    """Meet questions and chunks of the same bucket, cut so that no task holds a large bucket."""
    def blocks(df, name):
        return df.groupBy("bucket").agg(
            F.ceil(F.count("*") / block_rows).cast("int").alias(name))

    sizes = blocks(queries, "nq").join(blocks(chunks, "nc"), "bucket")  # broadcast only if it is found small
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(sizes, "bucket").withColumn(
        "qi", F.pmod(F.xxhash64("req_id"), F.col("nq")).cast("int")).withColumn("ci", spread("nc"))
    c = chunks.join(sizes, "bucket").withColumn(
        "ci", F.pmod(F.xxhash64("id"), F.col("nc")).cast("int")).withColumn("qi", spread("nq"))
    cols = ["bucket", "qi", "ci"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({"req_id": left.column("req_id").slice(0, 0),
                             "id": right.column("id").slice(0, 0),
                             "distance": pa.array([], pa.float64())})
        row, dist, ident = _best(_matrix(left.column("asked")), _matrix(right.column("embedding")),
                                 _ids(right.column("id")), k)
        return pa.table({"req_id": left.column("req_id").take(pa.array(row)),
                         "id": pa.array(ident), "distance": pa.array(dist)})

    # fresh column names on one side: both may come from the same table
    left = q.select(*[F.col(x).alias("q_" + x) for x in cols], "req_id", F.col("embedding").alias("asked"))
    return left.groupBy(*["q_" + x for x in cols]).cogroup(
        c.select(*cols, "id", "embedding").groupBy(*cols)).applyInArrow(meet, schema)


@lru_cache(maxsize=8)
def _planes(n: int, dim: int, seed: int) -> np.ndarray:
    """Normals of ``n`` planes with entries +1 and -1, drawn by hashing so that they never change."""
    sign = lambda p, d: 1.0 if md5(f"{seed}:{p}:{d}".encode()).hexdigest()[0] < "8" else -1.0
    return np.array([[sign(p, d) for d in range(dim)] for p in range(n)])


def _hyperplane_buckets(embedding, dim: int, tables: int, bits: int, seed: int):
    """For each table on which sides of its ``bits`` planes a vector lies (Charikar 2002)."""

    @arrow_udf("array<int>")
    def signs(vectors: pa.Array) -> pa.Array:
        n = len(vectors)
        side = _matrix(vectors).reshape(n, dim) @ _planes(tables * bits, dim, seed).T >= 0
        code = side.reshape(n, tables, bits) @ (1 << np.arange(bits)) + np.arange(tables) * (1 << bits)
        return pa.ListArray.from_arrays(
            pa.array(np.arange(0, (n + 1) * tables, tables, dtype=np.int32)),
            pa.array(code.astype(np.int32).ravel()))

    return signs(embedding)


def lsh_size(n: int, cosine: float = 0.9, recall: float = 0.95) -> tuple[int, int]:
    """Tables and bits for ``n`` chunks: buckets keep their size as the corpus grows, and a chunk
    of the given cosine is met in some table with the given probability."""
    bits = min(24, max(4, math.ceil(math.log2(max(n, 1) / 256 + 1))))
    alike = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log1p(-alike)), bits


def _sure_distance(tables: int, bits: int, recall: float) -> float:
    """Up to this cosine distance a chunk is met in some table with probability ``recall``."""
    alike = (1 - (1 - recall) ** (1 / tables)) ** (1 / bits)
    return 1 - math.cos((1 - alike) * math.pi)


def _fitted(queries: DataFrame, chunks: DataFrame, n: int, k: int, recall: float) -> tuple[int, int] | None:
    """Tables and bits for the cosine that the k-th neighbour of most questions has, measured
    exactly on some of them; None where so many tables would cost more than an exact scan."""
    some = queries.orderBy(F.xxhash64("embedding")).limit(FIT_QUESTIONS)
    kth = [1 - r[0] for r in vector_topk(some, chunks, k).filter(F.col("rank") == k).select("distance").collect()]
    if not kth:
        return None
    cosine = min(0.9, float(np.quantile(kth, 0.1)))
    tables, bits = lsh_size(n, cosine, recall) if cosine > 0 else (MAX_TABLES + 1, 1)
    return None if tables > min(MAX_TABLES, 1 << bits) else (tables, bits)


def vector_topk_lsh(queries: DataFrame, chunks: DataFrame, k: int = TOP_K,
                    tables: int | None = None, bits: int | None = None, seed: int = 7,
                    block_rows: int = BLOCK_ROWS, recall: float = 0.95) -> DataFrame:
    """Approximate ``vector_topk``: only vectors that share a bucket of some table are compared.

    The vectors' length is taken from the questions. Where tables and bits are not both given, they
    come from the number of chunks and from the cosine of the k-th neighbour of some questions, and
    a question is answered by exact search unless it found k chunks all so near that each nearer one
    was met with probability ``recall``. Where hashing to that recall would take too many tables all
    questions are. With both given the hashed result is returned as it is. Buckets of any size are
    cut into blocks. More ``bits`` compare less, more ``tables`` find more. Null, ragged or holed
    vectors are left out.
    """
    queries, chunks = queries.select("req_id", "embedding"), chunks.select("id", "embedding")
    dim = queries.agg(F.max(F.size("embedding"))).first()[0] or 0
    queries, chunks = _whole(queries, dim), _whole(chunks, dim)
    complete = tables is None or bits is None
    if complete:
        own = _fitted(queries, chunks, chunks.count(), k, recall)
        if own is None:
            return vector_topk(queries, chunks, k, block_rows=block_rows)
        tables, bits = tables or own[0], bits or own[1]
    schema = _partial_schema(queries, chunks)

    def hashed(df):
        return df.select("*", F.explode_outer(_hyperplane_buckets(
            F.col("embedding"), dim, tables, bits, seed)).alias("bucket"))

    found = _blocks(hashed(queries), hashed(chunks), schema, k, block_rows)
    found = _rank(found.groupBy("req_id", "id").agg(F.min("distance").alias("distance")), k)
    if not complete:
        return found
    found = checkpointed(found, queries.sparkSession)   # read twice
    sure = found.filter((F.col("rank") == k) & (F.col("distance") <= _sure_distance(tables, bits, recall))).select(
        F.col("req_id").alias("sure"))
    is_sure = F.col("req_id").eqNullSafe(F.col("sure"))
    rest = checkpointed(queries.join(sure, is_sure, "left_anti"), queries.sparkSession)
    return found.join(sure, is_sure, "left_semi").unionByName(
        vector_topk(rest, chunks, k, block_rows=block_rows))
