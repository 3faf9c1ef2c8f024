"""Word statistics that follow the index, and the parts of retrieval as parameters."""

from pyspark.sql import functions as F

from askloom.operators import rerank, retrieve
from askloom.operators.embed import embed_text
from askloom.operators.index import delete_sources, upsert_index
from askloom.plans.answer import retrieve as find

COLUMNS = "id string, source string, filename string, page string, text string, seq long"


def _rows(spark, rows):
    return spark.createDataFrame([(i, s, s, "1", t, 0) for i, s, t in rows], COLUMNS)


def _set(df):
    return {tuple(r) for r in df.select("term", "df", "n_words").collect()}


def test_stats_follow_upserts_and_deletes(spark):
    index = _rows(spark, [("a", "s1", "red red blue"), ("b", "s1", "only here"), ("c", "s2", "blue sky"), ("d", "s3", None), ("e", "s4", "")])
    new = _rows(spark, [("a2", "s1", "red green"), ("c", "s5", "grey sky now"), ("c", "s5", "grey sky now")])
    stats = rerank.term_stats(index)
    assert (None, 5, 7) in _set(stats) and ("red", 1, 0) in _set(stats)
    after = upsert_index(index, new)
    stats = rerank.upsert_stats(stats, index, new)
    assert _set(stats) == _set(rerank.term_stats(after)) and "only" not in {t for t, *_ in _set(stats)}
    gone = spark.createDataFrame([("s1",), ("s1",), ("s9",)], "source string")
    assert _set(rerank.delete_stats(stats, after, gone)) == _set(rerank.term_stats(delete_sources(after, gone)))
    none = rerank.delete_stats(rerank.term_stats(index), index, index)
    assert not _set(none) and _set(rerank.upsert_stats(none, index.where("false"), index)) == _set(rerank.term_stats(index))


def test_scores_from_stats_equal_those_from_the_corpus(spark):
    index = _rows(spark, [(f"c{i}", f"s{i % 4}", f"red {'blue ' * (i % 3)} w{i} w{i % 5}") for i in range(20)])
    asked = spark.createDataFrame([(1, "red w3 nothing"), (2, "blue w1 w2 w1"), (3, "")], "req_id long, query string")
    candidates = asked.select("req_id").crossJoin(index).withColumn("rank", F.lit(1)).withColumn("distance", F.lit(0.5))
    score = lambda df: {(r.req_id, r.id): r.rerank_score for r in df.collect()}
    kept = rerank.rerank_score(candidates, asked, None, rerank.term_stats(index))
    assert score(kept) == score(rerank.rerank_score(candidates, asked, index)) and len(score(kept)) == 60


def test_retrieval_takes_embedder_search_and_scorer(spark):
    index = _rows(spark, [(f"c{i}", f"s{i}", f"word{i} common text") for i in range(12)])
    asked = spark.createDataFrame([(1, "word3 common"), (2, "word7")], "req_id long, query string")
    wide = lambda c: embed_text(c, 512)
    by_length = lambda candidates, queries, chunks: candidates.withColumn("rerank_score", F.length("text") * 1.0)
    index = index.withColumn("embedding", wide("text"))
    usual = {(r.req_id, r.id) for r in find(asked, index, k=12, embed=wide).collect()}
    assert {(1, "c3"), (2, "c7")} <= usual
    stats = rerank.term_stats(index)
    kept = find(asked, index, k=12, embed=wide, search=retrieve.vector_topk_lsh,
                score=lambda c, q, i: rerank.rerank_score(c, q, None, stats))
    assert {(1, "c3"), (2, "c7")} <= {(r.req_id, r.id) for r in kept.collect()}
    longest = find(asked, index, k=12, top_n=2, embed=wide, score=by_length).select("req_id", "id").collect()
    assert {r.id for r in longest} == {"c10", "c11"}
