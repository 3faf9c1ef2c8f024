"""Token-bucket throttling, replayed over a log of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from askloom.operators.replay import Rule, replay

# The limiter's settings.
CAPACITY = 10.0
REFILL_PER_S = 1.0
IDLE_S = 86_400


def bucket_columns(rule: Rule) -> list[Column]:
    """Decision, tokens left and seconds to wait, from what the replay returns."""
    ok, lead, second = F.col("ok"), F.col("lead"), 1_000_000 * rule.scale
    return [
        ok.alias("allowed"),
        F.when(ok, F.floor(lead / rule.period)).otherwise(F.lit(0)).cast("bigint").alias("remaining"),
        F.when(~ok, F.ceil(-lead / second)).cast("bigint").alias("retry_after_s"),
    ]


def token_bucket(events: DataFrame, capacity: float = CAPACITY, refill_per_s: float = REFILL_PER_S,
                 idle_s: int | None = IDLE_S, **how) -> DataFrame:
    """``key, t, id`` (and carried columns) -> plus ``allowed, remaining, retry_after_s``.

    A refused request leaves the bucket as it is. A bucket nobody asked for ``idle_s`` seconds is
    full again; ``None`` keeps it for ever.
    """
    rule = Rule.bucket(capacity, refill_per_s, idle_s)
    return replay(events, rule=rule, **how).select(*events.columns, *bucket_columns(rule))
