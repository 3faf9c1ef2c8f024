"""Exact-match cache with time to live: keys, payloads and replay over a request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from askloom.functions.text import strip_ws
from askloom.operators.replay import CLEAR, READ, SET, TAKE, replay

# Namespace, scope of a missing user or document, time to live.
NAMESPACE = "rag_response"
NO_USER = "global"
NO_DOC = "all"
TTL_S = 3600

PAYLOAD_SCHEMA = "query string, answer string, sources array<string>"


def cache_key(query, user_id=None, doc_hash=None, namespace: str = NAMESPACE) -> Column:
    """``namespace:sha256`` of scope and normalised query; an empty user or hash counts as missing."""

    def scope(c, missing):
        if c is None:
            return F.lit(missing)
        c = F.col(c) if isinstance(c, str) else c
        return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(missing))

    raw = F.concat_ws(":", scope(user_id, NO_USER), scope(doc_hash, NO_DOC), F.lower(strip_ws(query)))
    return F.concat(F.lit(namespace + ":"), F.sha2(raw, 256))


def cache_replay(log: DataFrame, ttl_s: int = TTL_S, valid: str | None = None, **how) -> DataFrame:
    """``key, t, id`` -> plus ``outcome`` HIT or MISS.

    A miss writes an entry that lives ``ttl_s`` from the write; hits do not renew it. ``valid``
    names a boolean column: a miss whose answer is not valid writes nothing.
    """
    events = log
    if valid is not None:
        events = log.withColumn("op", F.when(F.col(valid), TAKE).otherwise(READ)).withColumn(
            "arg", F.lit(0).cast("bigint"))
    out = replay(events, period=int(ttl_s * 1_000_000), **how)
    return out.select(*log.columns, F.when(F.col("ok"), "MISS").otherwise("HIT").alias("outcome"))


def cache_replay_ops(log: DataFrame, default_ttl_s: int = TTL_S, **how) -> DataFrame:
    """The same with explicit operations: ``op`` is get, set or delete, ``ttl_s`` per set.

    A get only reads. Returns every row, ``outcome`` is null for set and delete.
    """
    coded = log.withColumnRenamed("op", "verb").withColumn(
        "op", F.when(F.col("verb") == "set", SET).when(F.col("verb") == "delete", CLEAR).otherwise(READ)
    ).withColumn("arg", F.coalesce(F.col("ttl_s"), F.lit(default_ttl_s)).cast("bigint") * 1_000_000)
    out = replay(coded, period=1, **how)
    outcome = F.when(F.col("verb") == "get", F.when(F.col("ok"), "MISS").otherwise("HIT"))
    return out.select(*[F.col("verb").alias("op") if c == "op" else F.col(c) for c in log.columns],
                      outcome.alias("outcome"))


def to_payload(query, answer, sources) -> Column:
    c = [F.col(x) if isinstance(x, str) else x for x in (query, answer, sources)]
    return F.to_json(F.struct(c[0].alias("query"), c[1].alias("answer"), c[2].alias("sources")))


def from_payload(payload) -> Column:
    """Parsed payload; an empty one reads as nothing, that is a miss."""
    p = F.col(payload) if isinstance(payload, str) else payload
    return F.from_json(F.nullif(p, F.lit("")), PAYLOAD_SCHEMA)
