"""Request log to outcomes: guard, limiter, cache, retrieval, answer, output guard."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, functions as F

from askloom.functions.text import strip_ws
from askloom.operators import cache, guard_input, guard_output, rerank, throttle
from askloom.operators.embed import embed_text
from askloom.operators.retrieve import TOP_K, vector_topk
from askloom.session import checkpointed, written

# Outcome names and their codes.
INPUT_BLOCKED, RATE_LIMITED, CACHE_HIT, RAG_PIPELINE, OUTPUT_BLOCKED = (
    "INPUT_BLOCKED", "RATE_LIMITED", "CACHE_HIT", "RAG_PIPELINE", "OUTPUT_BLOCKED")


def retrieve(queries: DataFrame, index: DataFrame, k: int = TOP_K, top_n: int = rerank.TOP_N,
             min_score: float = rerank.MIN_SCORE, embed: Callable = embed_text,
             search: Callable[..., DataFrame] = vector_topk,
             score: Callable[..., DataFrame] = rerank.rerank_score) -> DataFrame:
    """``req_id, query`` -> the kept chunks per question with distance, score and position.

    ``embed`` makes a vector column of a text column, as the index was embedded; ``search`` takes
    vectors, index and k (``vector_topk`` or ``vector_topk_lsh``); ``score`` takes candidates,
    questions and index and adds ``rerank_score``.
    """
    vectors = queries.select("req_id", embed("query").alias("embedding"))
    near = written(search(vectors, index, k), "near")   # few rows, so that no chunk's text is shuffled
    texts = index.select("id", "filename", "page", "text")
    candidates = near.join(texts, "id")
    return rerank.rerank_topn(score(candidates, queries, index), top_n, min_score)


def extractive_answer(contexts: DataFrame) -> DataFrame:
    """The best chunk itself as the answer."""
    return contexts.withColumn("answer", F.when(F.size("context") > 0, F.col("context")[0]["text"]))


def answer_queries(queries: DataFrame, index: DataFrame,
                   answer: Callable[[DataFrame], DataFrame] = extractive_answer,
                   threshold: float = guard_output.PIPELINE_THRESHOLD, **how) -> DataFrame:
    """``req_id, query`` -> plus context, verdict on the answer, and sources.

    ``answer`` adds the column ``answer`` to ``req_id, query, context``.
    """
    found = rerank.with_context(queries, rerank.context_chunks(retrieve(queries, index, **how)))
    answered = answer(found).withColumn("answer", rerank.answer_or_fallback("answer", "context"))
    texts = F.transform("context", lambda c: c["text"])
    return answered.withColumn(
        "verdict", guard_output.validate_output("answer", texts, threshold)
    ).withColumn("sources", rerank.answer_sources("context"))


def answer_requests(requests: DataFrame, index: DataFrame, capacity=throttle.CAPACITY,
                    refill_per_s=throttle.REFILL_PER_S, idle_s: int | None = throttle.IDLE_S,
                    ttl_s: int = cache.TTL_S, answer=extractive_answer, **how) -> DataFrame:
    """``req_id, user_id, query, t, toxic_score`` -> one outcome row per request.

    Rejected questions cost no token; cache hits do. Each distinct cache key is retrieved and
    answered once, however many requests share it, and its verdict is joined back by key.
    """
    toxic = guard_input.is_toxic("toxic_score")
    guard = guard_input.validate_input("query", "toxic_score")
    rejected = requests.filter(toxic).withColumn("guard", guard)
    accepted = requests.filter(~toxic).select(
        F.col("user_id").alias("key"), "t", F.col("req_id").alias("id"),
        guard["sanitized"].alias("query"))
    limited = checkpointed(
        throttle.token_bucket(accepted, capacity, refill_per_s, idle_s)
        .withColumn("cache_key", cache.cache_key("query")), requests.sparkSession)
    refused = limited.filter(~F.col("allowed"))
    allowed = limited.filter("allowed")

    questions = allowed.groupBy(F.col("cache_key").alias("req_id")).agg(
        F.min(F.lower(strip_ws("query"))).alias("query"))
    answers = checkpointed(answer_queries(questions, index, answer, **how).select(
        F.col("req_id").alias("cache_key"), "verdict", "sources"), requests.sparkSession)

    log = allowed.join(answers.select("cache_key", F.col("verdict.valid").alias("valid")), "cache_key")
    replayed = cache.cache_replay(
        log.select(F.col("cache_key").alias("key"), "t", "id", "valid", F.col("key").alias("user_id"),
                   "query"), ttl_s, valid="valid")
    served = replayed.join(answers, F.col("key") == F.col("cache_key"))

    none_a = F.lit(None).cast("array<string>")
    none_s = F.lit(None).cast("string")

    def row(df, req_id, user, outcome, code, reason, text, sources):
        return df.select(req_id.alias("req_id"), user.alias("user_id"), outcome.alias("outcome"),
                         code.cast("int").alias("code"), reason.alias("reason"),
                         text.alias("answer"), sources.alias("sources"))

    hit, valid = F.col("outcome") == "HIT", F.col("valid")
    parts = [
        row(rejected, F.col("req_id"), F.col("user_id"), F.lit(INPUT_BLOCKED), F.lit(400),
            F.col("guard.reason"), none_s, none_a),
        row(refused, F.col("id"), F.col("key"), F.lit(RATE_LIMITED), F.lit(429),
            F.concat(F.lit("Retry after "), F.col("retry_after_s").cast("string"), F.lit(" s")),
            none_s, none_a),
        row(served, F.col("id"), F.col("user_id"),
            F.when(hit, CACHE_HIT).when(valid, RAG_PIPELINE).otherwise(OUTPUT_BLOCKED),
            F.when(hit | valid, 200).otherwise(422), F.col("verdict.reason"),
            F.col("verdict.text"), F.when(valid, F.col("sources"))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
