"""Requests per key and calendar day, over a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY_US = 86_400_000_000
SLICE_US = 60_000_000


def day_columns(t: Column, zone: str) -> tuple[Column, Column]:
    """Day number in the zone, and the instant at which the next day begins there."""
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_micros(t).cast("timestamp_ntz")))
    midnight = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.date_add(local, 1).cast("timestamp_ntz"))
    return F.unix_date(local), F.unix_micros(midnight.cast("timestamp"))


def quota_columns(per_day: int, rank: Column, t: Column, until: Column) -> list[Column]:
    ok = rank <= per_day
    return [ok.alias("allowed"), F.greatest(F.lit(per_day) - rank, F.lit(0)).cast("bigint").alias("remaining"),
            F.when(~ok, F.ceil((until - t) / 1_000_000)).cast("bigint").alias("retry_after_s")]


def daily_quota(events: DataFrame, per_day: int, zone: str = "UTC", slice_us: int = SLICE_US) -> DataFrame:
    """``key, t, id`` (and carried columns) -> plus ``allowed, remaining, retry_after_s``.

    The first ``per_day`` requests of a key on a calendar day of ``zone`` are allowed, in the order of
    (t, id); a refused one waits for the next midnight there. ``t`` is in microseconds; the session
    time zone must be UTC. A null key is a key. Requests of equal t and id count one by one.

    Two levels: a day is cut into slices of ``slice_us``. Counts per slice are added up over the
    slices of a day, and only requests in slices that begin below the quota are numbered, slice by
    slice, so no task gets a key's whole day.
    """
    day, until = day_columns(F.col("t"), zone)
    rows = events.withColumns({"_day": day, "_until": until, "_slice": F.floor(F.col("t") / slice_us)})
    group = ["key", "_day", "_slice"]
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("key", "_day").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in group]
    rows = rows.alias("r").join(counts.alias("c"), same).select("r.*", "_before")
    late = rows.where(F.col("_before") >= per_day).withColumn("_rank", F.lit(per_day + 1).cast("bigint"))
    early = rows.where(F.col("_before") < per_day).withColumn(
        "_rank", F.col("_before") + F.row_number().over(Window.partitionBy(*group).orderBy("t", "id")))
    return early.unionByName(late).select(
        *events.columns, *quota_columns(per_day, F.col("_rank"), F.col("t"), F.col("_until")))
