"""File-event logs: when a file is settled, repeated events, last action per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from askloom.functions.text import has_extension
from askloom.operators.replay import replay

MAX_POLLS = 15


def settled_files(observations: DataFrame, max_polls: int = MAX_POLLS) -> DataFrame:
    """First observation per path whose size is positive and equal to the one before.

    Input ``path, t, obs_id, size``. Only the first ``max_polls`` observations count. The row
    limit is pushed below the shuffle, so a path polled without end moves few rows.
    """
    by_path = Window.partitionBy("path").orderBy("t", "obs_id")
    first = observations.withColumn("poll", F.row_number().over(by_path)).filter(
        F.col("poll") <= max_polls)
    settled = first.withColumn("before", F.lag("size").over(by_path)).filter(
        (F.col("size") > 0) & (F.col("size") == F.col("before")))
    return settled.groupBy("path").agg(
        F.min("poll").alias("poll"), F.min_by("t", "poll").alias("t"),
        F.min_by("size", "poll").alias("size"))


def dedup_events(events: DataFrame, busy_us: int, **how) -> DataFrame:
    """Drop events that fall in the busy interval opened by an earlier kept one.

    Input has ``key, t, id``. An interval starts at the kept event and lasts ``busy_us``.
    """
    out = replay(events, period=busy_us, **how)
    return out.filter("ok").drop("ok", "lead")


def file_changes(events: DataFrame, ext: str = ".pdf") -> DataFrame:
    """Last change per source: ``source, change (ingest/delete), event_id``; see ``last_changes``."""
    return last_changes(events, ext).select("source", "last.change", "last.event_id")


def last_changes(events: DataFrame, ext: str = ".pdf") -> DataFrame:
    """``source, last``: the last change per source, a struct that orders as changes do.

    Its fields are t, event_id, seq (a move's steps) and change (ingest/delete). Input ``event_id, t, action, src, dest``. A move deletes the old path and, when the new
    one has the extension, ingests it. Partial maxima are taken before the shuffle.
    """

    def step(source: Column, change: str, seq: int) -> Column:
        return F.struct(source.alias("source"), F.lit(change).alias("change"), F.lit(seq).alias("seq"))

    src, dest = F.col("src"), F.col("dest")
    steps = (
        F.when(F.col("action").isin("created", "modified"), F.array(step(src, "ingest", 0)))
        .when(F.col("action") == "deleted", F.array(step(src, "delete", 0)))
        .when((F.col("action") == "moved") & dest.isNotNull() & has_extension("dest", ext),
              F.array(step(src, "delete", 0), step(dest, "ingest", 1)))
        .when((F.col("action") == "moved") & dest.isNotNull(), F.array(step(src, "delete", 0)))
    )
    flat = events.filter(has_extension("src", ext)).select("t", "event_id", F.inline(steps))
    return flat.groupBy("source").agg(F.max(F.struct("t", "event_id", "seq", "change")).alias("last"))
