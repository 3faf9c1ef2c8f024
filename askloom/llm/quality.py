"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from askloom.llm.common import BASE, SPACE, crc_of_id, mix, pieces, span_hashes, stored, text_bytes, word_spans

BITS = 17
NGRAMS = (3, 4)


@dataclass(frozen=True)
class Model:
    """score = softmax of the averaged vectors; ``gain`` holds each bucket's part of the log-odds."""
    gain: np.ndarray
    bias: float


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of words, of word pairs, of a word said twice, of character n-grams of each length; with bounds by text.

    Every pair of neighbours has a bucket by its hash; pairs of a word with itself count in a
    common bucket as well.

    Characters are UTF-8 characters; white space counts as one mark that may begin or end an
    n-gram but not lie inside it. No n-gram crosses two texts.
    """
    shift = np.uint64(64 - BITS)
    starts, ends = word_spans(data, offsets)
    words, bounds = span_hashes(data, starts, ends), np.searchsorted(starts, offsets)
    yield (words >> shift).astype(np.int32), bounds
    second = np.ones(len(words), bool)
    second[bounds[:-1][bounds[:-1] < len(words)]] = False
    second = np.flatnonzero(second)
    code = mix(words[second - 1] * BASE + words[second])
    yield (code >> shift).astype(np.int32), np.searchsorted(second, bounds)
    twice = second[words[second] == words[second - 1]]
    yield np.zeros(len(twice), np.int32), np.searchsorted(twice, bounds)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    wide = np.concatenate([data, np.zeros(4, np.uint8)])
    chars, more = wide[lead].astype(np.uint64), np.ones(len(lead), bool)
    if len(lead) < len(data):
        for k in (1, 2, 3):
            more &= (wide[lead + k] & 0xC0) == 0x80
            chars |= np.where(more, wide[lead + k].astype(np.uint64) << np.uint64(8 * k), np.uint64(0))
    space = np.zeros(len(lead), bool)
    space[SPACE[data[lead]]] = True
    chars[space] = 1
    bounds = np.searchsorted(lead, offsets)
    text_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(bounds))
    for n in NGRAMS:
        m = len(chars) - n + 1
        if m <= 0:
            yield np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
            continue
        ok = text_of[:m] == text_of[n - 1:]
        code = np.full(m, n, np.uint64)
        for k in range(n):
            code = code * BASE + chars[k:k + m]
            if 0 < k < n - 1:
                ok &= ~space[k:k + m]
        at = np.flatnonzero(ok)
        yield (mix(code[at]) >> shift).astype(np.int32), np.searchsorted(at, bounds)


def _scores(column: pa.Array, model: Model) -> np.ndarray:
    data, offsets = text_bytes(column)
    total, count = np.zeros(len(column)), np.zeros(len(column))
    for first, part, offs in pieces(data, offsets):
        for buckets, bounds in grams(part, offs):
            run = np.concatenate([[0.0], np.cumsum(model.gain[buckets], dtype=np.float64)])
            total[first:first + len(offs) - 1] += run[bounds[1:]] - run[bounds[:-1]]
            count[first:first + len(offs) - 1] += np.diff(bounds)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + model.bias, -700, 700)))


def _features(batches):
    """doc_id, y and a document's buckets with their shares, at most 2 ** BITS of them."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            data, offsets = text_bytes(batch.column("text").slice(i, 1))
            count = np.zeros(1 << BITS, np.float32)
            for _, part, offs in pieces(data, offsets):
                for buckets, _ in grams(part, offs):
                    count += np.bincount(buckets, minlength=1 << BITS)
            at = np.flatnonzero(count).astype(np.int32)
            out.append((at.tobytes(), (count[at] / max(count.sum(), 1)).astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.array([x[0] for x in out], pa.binary()),
             pa.array([x[1] for x in out], pa.binary())], ["doc_id", "y", "at", "share"])


def sgd(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 8, epochs: int = 8, rate: float = 6.0, seed: int = 1) -> Model:
    """Stochastic gradient descent on the softmax loss over (buckets, shares, label) rows.

    With no rows, or rows of one label only, the score follows the labels' frequencies.
    """
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << BITS, dim)) - 0.5) / dim).astype(np.float32)
    out = ((rng.random((2, dim)) - 0.5) * 2).astype(np.float32)
    ones = sum(r[2] for r in rows)
    bias = np.array([0.0, np.log((ones + 1) / (len(rows) - ones + 1))])
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, share, y = rows[k]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[at]
            logit = out @ hidden + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            back = out.T @ p.astype(np.float32)
            out -= np.float32(0.05 * lr) * np.outer(p, hidden).astype(np.float32)
            bias -= 0.01 * lr * p
            # shares add to one, so a plain step would hardly move them: scale by their square norm
            vectors[at] -= np.outer(share * np.float32(lr / max(1e-12, float(np.sqrt(share @ share)))), back)
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, held_out: bool = True,
                max_pairs: int = 32_000_000, **options) -> Model:
    """Train on at most ``max_rows`` labelled documents, whole, those with the least id hashes.

    labels: doc_id, quality. Rows whose crc32 of the id is 2 modulo 4 are never used (unless
    ``held_out`` is false). Of a repeated id the least label and the least text count; null ids and
    labels are left out. The driver gets hashed counts of the chosen documents, one row for each id:
    of documents in the order of their id hashes as many as have ``max_pairs`` (bucket, share) pairs
    of eight bytes, the first one always.
    """
    pool = labels.where("doc_id is not null and quality in (0, 1)")
    if held_out:
        pool = pool.where(crc_of_id() % 4 != 2)
    chosen = (pool.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows ids
    picked = picked.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    made = stored(picked.mapInArrow(_features, "doc_id long, y int, at binary, share binary"), "features")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # over max_rows ids
    sizes = made.select("doc_id", (F.length("at") / 4).cast("long").alias("pairs"))
    fit = sizes.withColumn("total", F.sum("pairs").over(order)).withColumn("nth", F.row_number().over(order))
    fit = fit.where((F.col("total") <= max_pairs) | (F.col("nth") == 1)).select("doc_id")
    rows = made.join(F.broadcast(fit), "doc_id").toPandas().sort_values("doc_id")
    return sgd([(np.frombuffer(a, np.int32), np.frombuffer(s, np.float32), int(y))
                for a, s, y in zip(rows["at"], rows["share"], rows["y"])], **options)


def score_quality(docs: DataFrame, model: Model, keep: str = "doc_id") -> DataFrame:
    """``keep`` (an id column) and score, 0 to 1, from the whole text of every row of ``docs``.

    A null text is an empty one; an empty text gets the model's bias. Ids may be null or repeat.
    """
    kind = docs.schema[keep].dataType.simpleString()

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_scores(batch.column(1), model))], ["id", "score"])

    return docs.select(F.col(keep).alias("id"), F.col("text")).mapInArrow(
        score, f"id {kind}, score double").withColumnRenamed("id", keep)


def keep_quality(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose score is at least ``least``."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any names will do
    text = f"c{docs.columns.index('text')}"

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(text), model) >= least))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
