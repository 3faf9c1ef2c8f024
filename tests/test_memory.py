"""What a Python worker holds at a time."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from askloom.operators import chunk, embed, retrieve


def test_texts_are_cut_in_pieces():
    texts = pa.array(["a" * 600, None, "b" * 600, "c" * 5000, "", None, "ü" * 300, "d"])
    parts = list(chunk.pieces(texts, 1000))
    assert [x for p in parts for x in p.to_pylist()] == texts.to_pylist()
    assert [len(p) for p in parts] == [2, 1, 1, 4] and list(chunk.pieces(texts.slice(0, 0))) == []
    assert [x for p in chunk.pieces(texts.slice(3), 1000) for x in p.to_pylist()] == texts.slice(3).to_pylist()


def test_workers_take_slices_of_a_batch(spark):
    """The same rows, however a batch is cut."""
    texts = [None if i % 50 == 7 else f"word{i % 13} other{i % 7} " * (i % 60) for i in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    got = {r.id: r for r in df.select("id", chunk.split_text("text").alias("c"), embed.embed_text("text").alias("e")).collect()}
    for i, t in enumerate(texts):
        assert got[i].c == (None if t is None else chunk.chunks_of(t, 1000, 150, chunk.SEPARATORS))
        words = len((t or "").split())
        assert abs(sum(x * x for x in got[i].e) - (1 if words else 0)) < 1e-5


def test_candidates_do_not_shuffle_the_texts(spark):
    from askloom.plans import answer
    from askloom.plans.ingest import index_rows

    docs = spark.createDataFrame([(f"/{i}.pdf", f"alpha{i} beta gamma delta epsilon " * 4) for i in range(30)], "source string, content string")
    index = index_rows(docs)
    asked = spark.createDataFrame([(1, "alpha3 beta"), (2, "alpha5")], "req_id long, query string")
    seen = []

    def score(candidates, queries, chunks):
        seen.append(candidates._jdf.queryExecution().sparkPlan().toString())
        return candidates.withColumn("rerank_score", F.lit(1.0))

    assert answer.retrieve(asked, index, k=5, score=score).count() == 6
    assert "BroadcastHashJoin" in seen[0] and "SortMergeJoin" not in seen[0]


def test_scan_in_slices_finds_the_same(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(5000, 8)).astype(np.float32)
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(i, m[i * 900].tolist()) for i in range(5)], "req_id long, embedding array<float>")
    got = {}
    for r in retrieve.vector_topk(asked, chunks, 4).collect():
        got.setdefault(r.req_id, {})[r["rank"]] = r.id
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    for i in range(5):
        d = np.round(1 - unit @ unit[i * 900], 9)
        want = np.lexsort((np.arange(5000), d))[:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == want.tolist()
