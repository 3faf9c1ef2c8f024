"""The replay machine on live streams: token bucket, cache and event deduplication per key.

One micro-batch is sorted by ``(t, id)`` per key before it is replayed; rows that arrive in a later
micro-batch than their successors are decided in arrival order. What one key can bring into memory
is a micro-batch at most, so bound that at the source (``maxFilesPerTrigger`` and the like).

Every row is decided, however late it comes, and every key's state is kept. With a ``lateness`` a
key's state is dropped in event time instead: once the watermark has passed the instant from which
the state cannot be told from a fresh one, no row can come that would notice, so silent keys hold
nothing. The price is that Spark then leaves out rows later than ``lateness`` behind the newest
event of earlier micro-batches: give it only where the source is in time order up to that much.

Python is called once per block of keys and micro-batch, since a call costs as much as hundreds of
rows; only with a ``lateness``, where a key has its own timer, once per key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from askloom.operators.replay import FRESH, TAKE, Rule

#: Added to event times, since a watermark starts at the epoch and leaves out what is not after it.
_SHIFT_MS = 1 << 42
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Blocks of keys, of all and of one day: part of the state's layout, so fixed for the life of a stream.
KEY_BLOCKS = 512
DAY_BLOCKS = 64


def _name(events: DataFrame) -> Column:
    """The key as a text that is not null and that no other key has."""
    key = F.col("key")
    text = F.hex(key) if isinstance(events.schema["key"].dataType, T.BinaryType) else key.cast("string")
    return F.coalesce(F.concat(F.lit("="), text), F.lit(""))


def _blocked(events: DataFrame, blocks: int, **more: Column) -> tuple[DataFrame, T.StructType, list[Column]]:
    """Rows with ``name_``, ``block_`` and more columns; the schema without these; the rows' own columns.

    Long columns carry no nulls on the way, which would make pandas read all numbers of a block as
    doubles; the columns returned put them back.
    """
    longs = [f.name for f in events.schema.fields if isinstance(f.dataType, T.LongType)]
    flags = {f"no_{c}_": F.col(c).isNull() for c in longs}
    rows = events.withColumns({"name_": _name(events), **more, **flags}).withColumns(
        {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in longs}).withColumn(
        "block_", F.pmod(F.xxhash64("name_"), F.lit(blocks)))
    schema = T.StructType(events.schema.fields + [T.StructField(c, T.BooleanType()) for c in flags])
    back = [F.when(~F.col(f"no_{c}_"), F.col(c)).alias(c) if c in longs else F.col(c) for c in events.columns]
    return rows, schema, back


def _sorted(rows, *first: str) -> pd.DataFrame:
    """A micro-batch's rows of a group by time and id, nulls last."""
    parts = list(rows)
    pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    by = [x for c in ("t", "id") for x in (f"no_{c}_", c) if x == c or x in pdf.columns and pdf[x].any()]
    return pdf.sort_values([*first, *by], kind="stable", ignore_index=True)


class _Replay(StatefulProcessor):
    def __init__(self, rule: Rule, columns: list[str], expires: bool):
        self.rule, self.columns, self.expires = rule, columns, expires

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("bucket", "at bigint, last bigint, timer bigint")

    def _fresh_ms(self, at: int) -> int:
        """Event time in milliseconds from which a state is as good as none."""
        return max(0, min(1 << 52, _SHIFT_MS - (-(at + self.rule.burst) // (1000 * self.rule.scale)) + 1))

    def handleInputRows(self, key, rows, timerValues):
        rule = self.rule
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["t", "id"], kind="stable")
        at, last, timer = self.state.get() if self.state.exists() else (FRESH, None, None)
        has_op = "op" in pdf.columns
        ok, lead = [], []
        for i, t in enumerate((pdf["t"] * rule.scale).tolist()):
            if last is not None and rule.idle is not None and t - last >= rule.idle:
                at = FRESH
            op = int(pdf["op"].iat[i]) if has_op else TAKE
            arg = int(pdf["arg"].iat[i]) * rule.scale if has_op else 0
            o, l, at = rule.step(at, t, op, arg)
            last = t
            ok.append(o)
            lead.append(l)
        if timer is None and self.expires:
            timer = self._fresh_ms(at)
            self.handle.registerTimer(timer)
        self.state.update((at, last, timer))
        yield pdf.assign(ok=ok, lead=lead)[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            at, last, timer = self.state.get()
            due = self._fresh_ms(at)
            if due <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
            else:  # the key was used since the timer was set
                self.handle.registerTimer(due)
                self.state.update((at, last, due))
        return iter([])

    def close(self):
        pass


class _BlockReplay(StatefulProcessor):
    """The same for a block of keys, without timers: the state of a key is an entry of the block's map."""

    def __init__(self, rule: Rule, columns: list[str]):
        self.rule, self.columns = rule, columns

    def init(self, handle):
        self.state = handle.getMapState("buckets", "name string", "at bigint, last bigint")

    def handleInputRows(self, key, rows, timerValues):
        rule = self.rule
        pdf = _sorted(rows, "name_")
        names, untimed = pdf["name_"].tolist(), pdf["no_t_"].tolist()
        times = pdf["t"].tolist()
        ops = pdf["op"].tolist() if "op" in pdf.columns else None
        args = pdf["arg"].tolist() if ops is not None else None
        ok, lead = [False] * len(names), [None] * len(names)
        known = self.state.exists()     # asked once: a block's first batch need not ask for every key
        ends = [i for i in range(1, len(names)) if names[i] != names[i - 1]] + [len(names)]
        for lo, hi in zip([0] + ends, ends):
            at, last = (self.state.getValue((names[lo],)) if known else None) or (FRESH, None)
            for i in range(lo, hi):
                if untimed[i]:      # of no time: never possible, and it changes nothing
                    continue
                t = times[i] * rule.scale
                if last is not None and rule.idle is not None and t - last >= rule.idle:
                    at = FRESH
                ok[i], lead[i], at = rule.step(
                    at, t, TAKE if ops is None else int(ops[i]), 0 if args is None else int(args[i]) * rule.scale)
                last = t
            self.state.updateValue((names[lo],), (at, last))
        yield pdf.assign(ok=ok, lead=pd.array(lead, dtype="Int64"))[self.columns]

    def close(self):
        pass


def replay_stream(events: DataFrame, rule: Rule, lateness: str | None = None) -> DataFrame:
    """Streaming ``key, t, id`` (``op, arg``) -> plus ``ok, lead``; all rows, unless ``lateness`` is given."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    found = [T.StructField("ok", T.BooleanType()), T.StructField("lead", T.LongType())]
    if lateness is None:
        blocked, schema, back = _blocked(events, KEY_BLOCKS)
        schema = T.StructType(schema.fields + found)
        out = blocked.groupBy("block_").transformWithStateInPandas(
            statefulProcessor=_BlockReplay(rule, schema.names), outputStructType=schema,
            outputMode="Append", timeMode="None")
        return out.select(*back, "ok", "lead")
    timed = events.withColumn(
        "_seen", F.timestamp_micros(F.col("t") + _SHIFT_MS * 1000)).withWatermark("_seen", lateness)
    schema = T.StructType(events.schema.fields + found)
    return timed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Replay(rule, schema.names, True), outputStructType=schema,
        outputMode="Append", timeMode="EventTime")


def token_bucket_stream(events: DataFrame, capacity, refill_per_s, idle_s: int | None = None,
                        lateness: str | None = None) -> DataFrame:
    from askloom.operators.throttle import bucket_columns

    rule = Rule.bucket(capacity, refill_per_s, idle_s)
    return replay_stream(events, rule, lateness).select(*events.columns, *bucket_columns(rule))


def cache_stream(events: DataFrame, ttl_s: int, lateness: str | None = None) -> DataFrame:
    out = replay_stream(events, Rule(int(ttl_s * 1_000_000)), lateness)
    return out.select(*events.columns, F.when(F.col("ok"), "MISS").otherwise("HIT").alias("outcome"))


def dedup_events_stream(events: DataFrame, busy_us: int, lateness: str | None = None) -> DataFrame:
    return replay_stream(events, Rule(busy_us), lateness).filter("ok").drop("ok", "lead")


class _Count(StatefulProcessor):
    """Numbers the rows of every key of a block on one day: those of a micro-batch by time, after those
    of the batches before. The block's counts are one value, an Arrow table: a day that is over is not
    touched again, and a late row of it rewrites one block."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle):
        self.state = handle.getValueState("counts", "counts binary")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _sorted(rows)
        names, n = [], np.zeros(0, np.int64)
        if self.state.exists():
            held = pa.ipc.open_stream(self.state.get()[0]).read_all()
            names, n = held.column("name").to_pylist(), held.column("n").to_numpy()
        code, every = pd.factorize(np.array(names + pdf["name_"].tolist(), object))
        before = np.zeros(len(every), np.int64)
        before[code[:len(names)]] = n
        code = code[len(names):]
        rank = before[code] + pd.Series(code).groupby(code).cumcount().to_numpy() + 1
        table = pa.table({"name": pa.array(every, pa.string()), "n": before + np.bincount(code, minlength=len(every))})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(),))
        yield pdf.assign(rank=rank)[self.columns]

    def close(self):
        pass


def daily_quota_stream(events: DataFrame, per_day: int, zone: str = "UTC") -> DataFrame:
    """Streaming form of ``daily_quota``; a late request takes what is left of its day. Every key's days stay."""
    from askloom.operators.quota import day_columns, quota_columns

    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    day, until = day_columns(F.col("t"), zone)
    # no null in what is grouped by: Spark's state then takes later keys of the task for null as well
    blocked, schema, back = _blocked(events, DAY_BLOCKS, day_=F.coalesce(day, F.lit(-(1 << 31))))
    schema = T.StructType(schema.fields + [T.StructField("rank", T.LongType())])
    counted = blocked.groupBy("day_", "block_").transformWithStateInPandas(
        statefulProcessor=_Count(schema.names), outputStructType=schema, outputMode="Append", timeMode="None")
    return counted.select(*back, "rank").select(
        *events.columns, *quota_columns(per_day, F.col("rank"), F.col("t"), until))
