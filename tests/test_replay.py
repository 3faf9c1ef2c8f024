"""Replay against a literal model of the bucket and the cache, on one task and on many."""

import math
import random

import pytest
from pyspark.sql import functions as F

from askloom.operators import cache, throttle
from askloom.operators.replay import FRESH, Pieces, Rule, evaluate
from askloom.sources import events as ev

S = 1_000_000


def bucket_model(rows, capacity, rate, idle=None):
    """Tokens counted one after the other, per key."""
    state, out = {}, {}
    for key, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        tokens, updated, seen = state.get(key, (capacity, t, t))
        if idle is not None and t - seen >= idle * S:
            tokens, updated = capacity, t
        have = min(capacity, tokens + (t - updated) / S * rate)
        if have >= 1:
            out[i] = (True, math.floor(have - 1), None)
            state[key] = (have - 1, t, t)
        else:
            out[i] = (False, 0, math.ceil((1 - have) / rate))
            state[key] = (tokens, updated, t)
    return out


def cache_model(rows, ttl):
    live, out = {}, {}
    for key, t, i, valid in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key in live and t - live[key] < ttl * S:
            out[i] = "HIT"
        else:
            out[i] = "MISS"
            if valid:
                live[key] = t
    return out


def skewed(n, span_s, seed, hot=0.5, step=1):
    """One key holds half of all rows."""
    r = random.Random(seed)
    return [("hot" if r.random() < hot else f"k{r.randint(0, 30)}",
             r.randrange(0, span_s * S // step) * step, i) for i in range(n)]


def test_bucket_golden_rows(spark):
    rows = [("u", int(x * S), i) for i, x in enumerate([0.0, 0.1, 0.2, 0.3, 0.4])]
    df = spark.createDataFrame(rows, "key string, t long, id long")
    got = {r.id: (r.allowed, r.remaining, r.retry_after_s)
           for r in throttle.token_bucket(df, 3, 0.5).collect()}
    assert [got[i] for i in range(5)] == [
        (True, 2, None), (True, 1, None), (True, 0, None), (False, 0, 2), (False, 0, 2)]


def test_ttl_golden_rows(spark):
    rows = [("k", x * S, i) for i, x in enumerate([0, 1800, 3599, 3600, 5400, 7200])]
    df = spark.createDataFrame(rows, "key string, t long, id long")
    got = {r.id: r.outcome for r in cache.cache_replay(df).collect()}
    assert [got[i] for i in range(6)] == ["MISS", "HIT", "HIT", "MISS", "HIT", "MISS"]


@pytest.mark.parametrize("span,capacity,rate,idle", [
    (600, 10, 1.0, None), (60, 10, 1.0, None), (5000, 3, 0.5, 7), (100_000, 5, 0.001, 3600),
    (3000, 2.5, 0.25, None)])
@pytest.mark.parametrize("hot_rows,pieces", [(10**9, 50_000), (150, 50_000), (150, 1)])
def test_bucket_equals_model(spark, span, capacity, rate, idle, hot_rows, pieces):
    rows = skewed(1500, span, seed=span)
    df = spark.createDataFrame(rows, "key string, t long, id long")
    got = {r.id: (r.allowed, r.remaining, r.retry_after_s) for r in throttle.token_bucket(
        df, capacity, rate, idle, hot_key_rows=hot_rows, max_pieces=pieces).collect()}
    assert got == bucket_model(rows, capacity, rate, idle)


@pytest.mark.parametrize("hot_rows,pieces", [(10**9, 50_000), (40, 50_000), (40, 1)])
@pytest.mark.parametrize("step", [1, 1800 * S])
def test_cache_equals_model(spark, hot_rows, pieces, step):
    """With a step of half the lifetime, chains from different starts never meet."""
    r = random.Random(5)
    rows = [(*x, r.random() < 0.7) for x in skewed(1500, 40 * 86_400, seed=3, step=step)]
    df = spark.createDataFrame(rows, "key string, t long, id long, valid boolean")
    got = {x.id: x.outcome for x in cache.cache_replay(
        df, ttl_s=3600, valid="valid", hot_key_rows=hot_rows, max_pieces=pieces).collect()}
    assert got == cache_model(rows, 3600)


@pytest.mark.parametrize("hot_rows", [10**9, 40])
def test_cache_ops_equal_model(spark, hot_rows):
    r = random.Random(9)
    rows = [(k, t, i, r.choice(["get", "get", "get", "set", "delete"]), r.choice([None, 60, 900]))
            for k, t, i in skewed(1200, 86_400, seed=11)]
    live, want = {}, {}
    for key, t, i, op, ttl in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        if op == "set":
            live[key] = t + (3600 if ttl is None else ttl) * S
        elif op == "delete":
            live.pop(key, None)
        else:
            want[i] = "HIT" if live.get(key, -1) > t else "MISS"
    df = spark.createDataFrame(rows, "key string, t long, id long, op string, ttl_s int")
    out = cache.cache_replay_ops(df, hot_key_rows=hot_rows)
    assert out.columns == df.columns + ["outcome"]
    assert {x.id: x.outcome for x in out.collect() if x.op == "get"} == want


def test_dedup_drops_inside_interval(spark):
    df = spark.createDataFrame([("p", x * S, i) for i, x in enumerate([0, 4, 9, 10, 12, 21])],
                               "key string, t long, id long")
    assert sorted(r.id for r in ev.dedup_events(df, 10 * S).collect()) == [0, 3, 5]


def test_hot_key_is_spread_over_tasks(spark):
    df = spark.createDataFrame(skewed(4000, 10_000, seed=2), "key string, t long, id long")
    out = throttle.token_bucket(df, 10, 1, hot_key_rows=200)
    hot = out.withColumn("p", F.spark_partition_id()).filter("key = 'hot'").groupBy("p").count().collect()
    assert len(hot) > 5 and max(r["count"] for r in hot) < 1200


def test_keys_stay_together_after_a_join_on_the_key(spark):
    """The join is planned on shuffled keys, and turned into a broadcast while it runs."""
    from askloom.session import checkpointed

    rows = skewed(3000, 40 * 86_400, seed=8)
    log = checkpointed(spark.createDataFrame(rows, "key string, t long, id long").repartition(6, "id"), spark)
    side = checkpointed(log.select("key").distinct().withColumn("valid", F.lit(True)).repartition(3), spark)
    out = cache.cache_replay(log.join(side, "key"), valid="valid")
    got = {x.id: x.outcome for x in out.collect()}
    assert got == cache_model([(*x, True) for x in rows], 3600)
    # the replay's own exchange must survive: the join's may be gone by the time it runs
    assert "REPARTITION_BY_COL" in out._jdf.queryExecution().executedPlan().toString()


def test_pieces_describe_a_run_exactly():
    r = random.Random(1)
    for _ in range(200):
        rule = Rule(period=r.randint(1, 40), burst=r.choice([0, 0, 30, 95]))
        ts = sorted(r.randint(0, 300) for _ in range(r.randint(1, 30)))
        p = Pieces()
        for t in ts:
            p.take(t, rule.period, rule.burst)
        for start in [FRESH] + list(range(-120, 360, 3)):
            state = start
            for t in ts:
                state = rule.step(state, t, 0, 0)[2]
            assert evaluate(p.parts, start) == state


def test_every_rate_is_accepted(spark):
    assert Rule.bucket(3, 1 / 7200).period == 7200 * S
    assert Rule.bucket(3, 1 / 7_000_000).period == 7_000_000 * S
    for rate in (0.1234567890123, 0.0123456789, 1 / 7_000_000, 3.7, 1e-9, 1e-300):
        rows = skewed(200, max(10, min(40_000_000, int(60 / rate))), seed=9)
        df = spark.createDataFrame(rows, "key string, t long, id long")
        got = {r.id: r.allowed for r in throttle.token_bucket(df, 3, rate, None).collect()}
        assert got == {i: v[0] for i, v in bucket_model(rows, 3, rate).items()}


def test_cache_key_golden_rows(spark):
    q = "How does vector indexing work in ChromaDB?"
    df = spark.createDataFrame([(q, "user_dev_01", "abc123hash"), (f"  {q.upper()}\n", None, ""), ],
                               "q string, u string, d string")
    got = [r[0] for r in df.select(cache.cache_key("q", "u", "d")).collect()]
    assert got == [
        "rag_response:e8298aba3aef465360028c1ee95f82c29c191deb85128eee51a9a38288d1dbf5",
        "rag_response:45aa1e78f2208ec7729c4afd649a4773cc53588296d2526ff016b5c5f368ccb4"]


def test_payload_round_trip(spark):
    df = spark.createDataFrame([("q", 'a "b"\n', ["x", "y"])], "q string, a string, s array<string>")
    back = df.select(cache.from_payload(cache.to_payload("q", "a", "s"))).first()[0]
    assert (back.query, back.answer, back.sources) == ("q", 'a "b"\n', ["x", "y"])
    empty = spark.createDataFrame([("",), (None,)], "p string").select(cache.from_payload("p").alias("p"))
    assert [r.p for r in empty.collect()] == [None, None]
