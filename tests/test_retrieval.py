import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.operators import rerank, retrieve
from askloom.operators.embed import embed_text
from askloom.plans.answer import answer_requests


def vectors(spark, n, dim, seed, name, copies=0):
    """Random vectors; the first one is repeated ``copies`` times, as a hot group."""
    m = np.random.default_rng(seed).standard_normal((n, dim)).round(2)
    m[1:1 + copies] = m[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return m, spark.createDataFrame(rows, f"{name} long, embedding array<double>").repartition(5)


def exact(q, c, k):
    u = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    d = np.round(1 - u(q) @ u(c).T, 9)
    return {(i, int(j)): r + 1 for i in range(len(q)) for r, j in enumerate(
        np.lexsort((np.arange(len(c)), d[i]))[:k])}


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0, "block_rows": 37}])
def test_topk_is_exact_on_both_paths(spark, how):
    q, qd = vectors(spark, 60, 8, 1, "req_id")
    c, cd = vectors(spark, 300, 8, 2, "id", copies=100)
    got = {(r.req_id, r.id): r.rank for r in retrieve.vector_topk(qd, cd, k=7, **how).collect()}
    assert got == exact(q, c, 7)


def test_topk_with_fewer_chunks_than_k(spark):
    q, qd = vectors(spark, 3, 4, 1, "req_id")
    c, cd = vectors(spark, 4, 4, 2, "id")
    assert retrieve.vector_topk(qd, cd, k=10).count() == 12
    assert retrieve.vector_topk(qd, cd.limit(0), k=10).count() == 0
    assert retrieve.vector_topk(qd.limit(0), cd, k=10).count() == 0


def test_lsh_recall_is_what_the_angles_promise(spark):
    """A neighbour at angle x shares one of 16 tables with probability 1 - (1 - (1 - x/pi)^4)^16."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("req_id"), "embedding")
    c = e.select(F.col("vec_id").alias("id"), "embedding")
    best = {(r.req_id, r.id): r.distance for r in retrieve.vector_topk(q, c).collect()}
    near = {(r.req_id, r.id): r.distance for r in retrieve.vector_topk_lsh(q, c, tables=16, bits=4, block_rows=100).collect()}
    side = 1 - np.arccos(np.clip(1 - np.array(list(best.values())), -1, 1)) / np.pi
    promised = np.mean(1 - (1 - side ** 4) ** 16)
    assert abs(len(set(best) & set(near)) / len(best) - promised) < 0.03
    assert all(near[pair] == best[pair] for pair in set(best) & set(near))


def test_embedding_is_unit_length_and_case_blind(spark):
    df = spark.createDataFrame([("Hello wide World",), ("hello WIDE world",), ("...",), (None,)], "t string")
    a, b, none, null = [np.array(r[0]) for r in df.select(embed_text("t")).collect()]
    assert len(a) == 256 and abs(np.linalg.norm(a) - 1) < 1e-6 and (a == b).all()
    assert not none.any() and not null.any()


def test_rerank_keeps_order_and_threshold(spark):
    rows = [(1, "a", 1, 2.0), (1, "b", 2, 5.0), (1, "c", 3, 5.0), (1, "d", 4, 9.0), (1, "e", 5, -2.0), (2, "f", 1, -3.0)]
    df = spark.createDataFrame(rows, "req_id int, id string, rank int, rerank_score double")
    got = [(r.req_id, r.id, r.pos) for r in rerank.rerank_topn(df).orderBy("pos").collect()]
    assert got == [(1, "d", 1), (1, "b", 2), (1, "c", 3)]


def test_context_prompt_and_fallback(spark):
    q = spark.createDataFrame([(1, "why"), (2, "how")], "req_id int, query string")
    ranked = spark.createDataFrame(
        [(1, "x", "a.pdf", 2, "text two", 1.0, 2), (1, "y", None, None, "text one", 2.0, 1)],
        "req_id int, id string, filename string, page int, text string, rerank_score double, pos int")
    rows = {r.req_id: r for r in rerank.with_context(q, rerank.context_chunks(ranked)).select(
        "req_id", rerank.context_text("context").alias("c"), rerank.build_prompt("context", "query").alias("p"),
        rerank.answer_sources("context").alias("s"),
        rerank.answer_or_fallback(F.lit("yes"), "context").alias("a")).collect()}
    assert rows[1].c == "Source: unknown (Page 1)\ntext one\n\nSource: a.pdf (Page 2)\ntext two"
    assert rows[1].p.endswith("text two\n\nQuestion: why\nAnswer:") and rows[1].s == ["unknown", "a.pdf"]
    assert rows[1].a == "yes" and rows[2].a == rerank.NO_HIT_ANSWER and rows[2].s == []


def test_request_outcomes(spark):
    """Order of the checks: guard, limiter, cache, answer; a blocked answer is never cached."""
    index = spark.createDataFrame(
        [("i1", "/a.pdf", "a.pdf", 1, 0, "paris capital france river seine", "h")],
        "id string, source string, filename string, page int, chunk_idx int, text string, file_hash string"
    ).withColumn("embedding", embed_text("text"))
    s = 1_000_000
    rows = [
        (1, "u", "Capital of France?", 0, 0.1), (2, "u", "  capital of france? ", 1 * s, None),
        (3, "u", "toxic words", 2 * s, 0.9), (4, "u", "capital of france?", 3 * s, 0.0),
        (5, "v", "mail a@b.cd zzzz", 4 * s, 0.0), (6, "v", "mail a@b.cd zzzz", 5 * s, 0.0),
        (7, "w", "CAPITAL of france?", 4000 * s, 0.0), (8, "w", "capital OF france?", 4001 * s, 0.0)]
    df = spark.createDataFrame(rows, "req_id long, user_id string, query string, t long, toxic_score double")
    out = {r.req_id: r for r in answer_requests(df, index, capacity=2, refill_per_s=0.001, min_score=0.1).collect()}
    assert {i: r.outcome for i, r in out.items()} == {
        1: "RAG_PIPELINE", 2: "CACHE_HIT", 3: "INPUT_BLOCKED", 4: "RATE_LIMITED",
        5: "OUTPUT_BLOCKED", 6: "OUTPUT_BLOCKED", 7: "RAG_PIPELINE", 8: "CACHE_HIT"}
    assert [out[i].code for i in (1, 3, 4, 5)] == [200, 400, 429, 422]
    assert out[1].answer == "paris capital france river seine" and out[2].sources == ["a.pdf"]
    assert out[5].reason == "HALLUCINATION_RISK"


def test_lsh_takes_its_size_from_the_data(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 256))
    rows = [(i, (base[i % 40] + 0.1 * rng.standard_normal(256)).tolist()) for i in range(4000)]
    c = spark.createDataFrame(rows + [(9001, None), (9002, [1.0]), (9003, [None] * 256)], "id long, embedding array<double>")
    q = spark.createDataFrame([(i, base[i].tolist()) for i in range(20)] + [(99, None)], "req_id long, embedding array<double>")
    exact = {(r.req_id, r.id) for r in retrieve.vector_topk(q, c).collect()}
    near = {(r.req_id, r.id) for r in retrieve.vector_topk_lsh(q, c).collect()}
    assert len(exact) == 200 and len(exact & near) >= 180
    sizes = [retrieve.lsh_size(n) for n in (10 ** 4, 10 ** 6, 10 ** 8)]
    assert all(t * 2.0 ** -b < 0.5 ** k for k, (t, b) in enumerate(sizes))  # share of the corpus compared falls


def test_lsh_default_finds_neighbours_of_low_cosine(spark):
    """Questions against texts as hashed bags of words, and planted neighbours some of which are far."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id as id", "text").limit(4500)
    c = docs.select("id", embed_text(F.substring("text", 1, 400)).alias("embedding")).localCheckpoint()
    q = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").limit(80).select(
        F.col("item_id").alias("req_id"), embed_text("text").alias("embedding")).localCheckpoint()
    rng = np.random.default_rng(3)
    base = rng.standard_normal((120, 64))
    near = [(i, (base[i % 120] + (0.1 if i % 120 < 110 else 1.2) * rng.standard_normal(64)).tolist()) for i in range(4800)]
    planted = spark.createDataFrame(near, "id long, embedding array<double>")
    asked = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(base)], "req_id long, embedding array<double>")
    for queries, chunks, hashed in [(q, c, False), (asked, planted, True)]:
        best = {(r.req_id, r.id): (r.distance, r.rank) for r in retrieve.vector_topk(queries, chunks).collect()}
        got = [r for r in retrieve.vector_topk_lsh(queries, chunks).collect()]
        found = {(r.req_id, r.id): (r.distance, r.rank) for r in got}
        assert len(found) == len(got) == len(best) and max(r.rank for r in got) == 10
        assert len(set(best) & set(found)) >= 0.95 * len(best)
        fit = retrieve._fitted(queries, chunks, chunks.count(), 10, 0.95)
        assert (fit is not None) == hashed
    far = {p for p in best if p[0] >= 110}      # found by exact completion
    assert far and {p: found[p] for p in far} == {p: best[p] for p in far}
