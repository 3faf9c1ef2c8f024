"""Replay of time-ordered decisions per key: one machine for token buckets and TTL caches.

State per key is one integer, the instant from which the next token (or the next cache miss)
is possible. An event at ``t`` is *ok* when that instant has come; taking it moves the instant
to ``max(instant, t - burst) + period``. A token bucket of capacity c and rate r is
``period = 1/r``, ``burst = (c-1)/r``; a cache entry is ``period = ttl``, ``burst = 0``, where
*ok* means miss. Integer time makes the result independent of how the work is cut up.

Decisions of one key depend on each other, so they are made in time order, streaming through
Arrow batches. When no key is large, one hash exchange brings every key to one task. When one is
(by a count that is combined before its shuffle), rows are range-partitioned by
``(key, t, id)`` instead, so the key is spread over many tasks in time order: a first pass
describes each partition as a function from incoming to outgoing state, the driver
chains one number per partition, and a second pass decides the rows of all partitions at once.
"""

from __future__ import annotations

import bisect
import heapq
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from askloom.session import checkpointed

FRESH = -(1 << 62)
_LONGEST = 1 << 60
HOT_KEY_ROWS = 2_000_000
MAX_PIECES = 50_000

TAKE, SET, CLEAR, READ = 0, 1, 2, 3


def _exact(x) -> Fraction:
    """The short fraction a number stands for, 1/7200 as a float means one in 7200; else its exact value."""
    short = Fraction(x).limit_denominator(1_000_000_000)
    return short if float(short) == float(x) else Fraction(x)


class Rule:
    """The numbers of the machine, in units of ``1/scale`` microseconds."""

    def __init__(self, period: int, burst: int = 0, idle: int | None = None, scale: int = 1):
        self.period, self.burst, self.scale = period * scale, burst * scale, scale
        self.idle = None if idle is None else idle * scale

    @classmethod
    def bucket(cls, capacity, rate_per_s, idle_s=None) -> "Rule":
        """Token-bucket numbers in a unit of a microsecond or, for fractions of one, finer.

        They are exact where a nanosecond or a coarser unit holds them, and else rounded to a
        nanosecond; where one of them is beyond some 36,000 years, both shrink until it is not.
        """
        rate, size = _exact(rate_per_s), _exact(capacity)
        period = 1_000_000 / rate
        burst = (size - 1) * period
        scale = min(1000, math.lcm(period.denominator, burst.denominator))
        longest = max(period, burst)
        if longest * scale > _LONGEST:
            scale = 1
        if longest > _LONGEST:
            period, burst = period * _LONGEST / longest, burst * _LONGEST / longest
        rule = cls(0, 0, None if idle_s is None else int(idle_s * 1_000_000), scale)
        rule.period, rule.burst = max(1, round(period * scale)), round(burst * scale)
        return rule

    def step(self, state, t, op, arg):
        """(state, t) -> (ok, lead, state): lead is how long ago ``ok`` became possible."""
        floor = t - self.burst
        at = state if state > floor else floor
        ok = at <= t
        if op == TAKE:
            return ok, t - at, (at + self.period if ok else state)
        if op == SET:
            return ok, t - at, t + arg
        if op == CLEAR:
            return ok, t - at, FRESH
        return ok, t - at, state


class Pieces:
    """Outgoing state as a function of incoming state, while a run of events goes by.

    Kept as groups of intervals of the incoming state that share one outgoing value, and single
    intervals on which the outgoing value still follows the incoming one. A heap gives the groups an
    event can change; groups that meet in one value become one, so few are left once the incoming
    state stops mattering.
    """

    def __init__(self):
        self.count = self.made = 0
        self.heap = []
        self._put(FRESH, [(FRESH, -FRESH)], 1)

    def _put(self, value, intervals, slope):
        self.made += 1
        self.count += len(intervals)
        heapq.heappush(self.heap, (value, self.made, intervals, slope))

    def constant(self):
        """The outgoing value when it no longer depends on the incoming one."""
        return self.heap[0][0] if len(self.heap) == 1 and self.heap[0][3] == 0 else None

    def reset(self, value):
        self.count, self.heap = 0, []
        self._put(value, [(FRESH, -FRESH)], 0)

    def take(self, t, period, burst):
        floor, full, moved = t - burst, [], []
        while self.heap and self.heap[0][0] <= t:
            value, _, intervals, slope = heapq.heappop(self.heap)
            self.count -= len(intervals)
            if slope == 0 and value <= floor:
                full = _joined(full, intervals)
            elif slope == 0:
                if moved and moved[-1][0] == value + period and moved[-1][2] == 0:
                    moved[-1] = (value + period, _joined(moved[-1][1], intervals), 0)
                else:
                    moved.append((value + period, intervals, 0))
            else:
                lo, hi = intervals[0]
                if value <= floor:                  # the bucket is full: all end in one value
                    end = min(hi, lo + floor - value)
                    full.append((lo, end))
                    value, lo = value + end + 1 - lo, end + 1
                if lo <= hi and value <= t:         # taken, and still following
                    end = min(hi, lo + t - value)
                    moved.append((value + period, [(lo, end)], 1))
                    value, lo = value + end + 1 - lo, end + 1
                if lo <= hi:                        # refused, so unchanged
                    moved.append((value, [(lo, hi)], 1))
        for part in moved:
            self._put(*part)
        if full:
            self._put(floor + period, full, 0)

    def feed(self, rule, t, op, arg):
        if op == TAKE:
            self.take(t, rule.period, rule.burst)
        elif op == SET:
            self.reset(t + arg)
        elif op == CLEAR:
            self.reset(FRESH)

    @property
    def parts(self):
        """``(low incoming, high incoming, outgoing at low, slope)`` by incoming state."""
        out = []
        for lo, hi, value, slope in sorted(
                (lo, hi, value, slope) for value, _, intervals, slope in self.heap for lo, hi in intervals):
            if out and slope == 0 == out[-1][3] and out[-1][2] == value:
                out[-1] = (out[-1][0], hi, value, 0)
            else:
                out.append((lo, hi, value, slope))
        return out


def _joined(a, b):
    if len(a) < len(b):
        a, b = b, a
    a.extend(b)
    return a


def evaluate(parts, state):
    at = bisect.bisect_right([p[0] for p in parts], state) - 1
    lo, _, v, slope = parts[at]
    return v + (state - lo) if slope else v


def _columns(batch, has_op, scale):
    key = batch.column(batch.schema.get_field_index("key")).to_pylist()
    t = batch.column(batch.schema.get_field_index("t")).to_pylist()
    if scale != 1:
        t = [x * scale for x in t]
    if not has_op:
        return key, t, None, None
    op = batch.column(batch.schema.get_field_index("op")).to_pylist()
    arg = batch.column(batch.schema.get_field_index("arg")).to_pylist()
    return key, t, op, [0 if a is None else a * scale for a in arg]


def _decide(rule: Rule, has_op: bool, entering=None):
    """Add ``ok`` and ``lead`` to rows sorted by key and time within the partition."""

    def run(batches):
        current, state, last = object(), FRESH, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            key, t, op, arg = _columns(batch, has_op, rule.scale)
            if entering is not None and last is None:
                seg = batch.column(batch.schema.get_field_index("seg"))[0].as_py()
                if seg in entering:
                    state, current, last = entering[seg][0], key[0], entering[seg][1]
            oks, leads = [False] * n, [0] * n
            if not has_op and rule.idle is None:    # the common case, without calls per row
                burst, period = rule.burst, rule.period
                for i, (k, now) in enumerate(zip(key, t)):
                    if k != current:
                        current, state = k, FRESH
                    at = now - burst
                    if state > at:
                        at = state
                    leads[i] = now - at
                    if at <= now:
                        oks[i], state = True, at + period
                last = t[-1]
            for i in range(n) if has_op or rule.idle is not None else ():
                if key[i] != current:
                    current, state, last = key[i], FRESH, t[i]
                elif rule.idle is not None and t[i] - last >= rule.idle:
                    state = FRESH
                last = t[i]
                oks[i], leads[i], state = rule.step(
                    state, t[i], op[i] if has_op else TAKE, arg[i] if has_op else 0)
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array(oks, pa.bool_()), pa.array(leads, pa.int64())],
                schema=batch.schema.append(pa.field("ok", pa.bool_())).append(
                    pa.field("lead", pa.int64())))

    return run


def _describe(rule: Rule, has_op: bool, max_pieces: int, entering=None):
    """One row per partition: its key range, its time range and the state it hands on.

    With ``entering`` the incoming state is known and only one number comes out.
    """

    def run(batches):
        seg = first = current = t_first = last = None
        runs, pieces, state, overflow = 0, None, FRESH, False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key, t, op, arg = _columns(batch, has_op, rule.scale)
            if seg is None:
                seg = batch.column(batch.schema.get_field_index("seg"))[0].as_py()
                first, t_first = key[0], t[0]
            starts = [i for i in range(len(key)) if i == 0 or key[i] != key[i - 1]]
            for lo, hi in zip(starts, starts[1:] + [len(key)]):
                goes_on = runs > 0 and key[lo] == current
                if not goes_on:
                    runs, current, state = runs + 1, key[lo], FRESH
                    pieces = Pieces() if runs == 1 and entering is None else None
                    if runs == 1 and entering is not None:
                        state = entering
                if runs > 1 and hi < len(key):
                    last = t[hi - 1]
                    continue        # this key is over: it began and ends inside the partition
                for i in range(lo, hi):
                    o, a = (op[i], arg[i]) if has_op else (TAKE, 0)
                    gap = rule.idle is not None and (i > lo or goes_on) and t[i] - last >= rule.idle
                    last = t[i]
                    if pieces is not None:
                        if gap:
                            pieces.reset(FRESH)
                        pieces.feed(rule, t[i], o, a)
                        if pieces.count > max_pieces:
                            overflow, pieces = True, None
                        elif pieces.constant() is not None:
                            state, pieces = pieces.constant(), None
                    else:
                        if gap:
                            state = FRESH
                        state = rule.step(state, t[i], o, a)[2]
        if seg is None:
            return
        if runs == 1 and overflow:
            parts = None
        elif runs == 1 and pieces is not None:
            parts = pieces.parts
        else:
            parts = [(FRESH, -FRESH, state, 0)]
        yield pa.RecordBatch.from_pydict({
            "seg": [seg], "first_key": [repr(first)], "last_key": [repr(current)],
            "t_first": [t_first], "t_last": [last],
            "parts": [None if parts is None else [
                {"lo": p[0], "hi": p[1], "v": p[2], "slope": p[3]} for p in parts]],
        }, schema=_SUMMARY_ARROW)

    return run


_SUMMARY_ARROW = pa.schema([
    ("seg", pa.int32()), ("first_key", pa.string()), ("last_key", pa.string()),
    ("t_first", pa.int64()), ("t_last", pa.int64()),
    ("parts", pa.list_(pa.struct([
        ("lo", pa.int64()), ("hi", pa.int64()), ("v", pa.int64()), ("slope", pa.int32())]))),
])
_SUMMARY = ("seg int, first_key string, last_key string, t_first bigint, t_last bigint, "
            "parts array<struct<lo: bigint, hi: bigint, v: bigint, slope: int>>")


def _entering_states(segments: DataFrame, rule: Rule, has_op: bool, max_pieces: int) -> dict:
    """State and last instant with which each partition starts, where a key goes on into it."""
    rows = sorted(
        segments.mapInArrow(_describe(rule, has_op, max_pieces), _SUMMARY).collect(),
        key=lambda r: r.seg)
    entering, before, out = {}, None, FRESH
    for r in rows:
        state = FRESH
        if before is not None and before.last_key == r.first_key:
            state = out
            if rule.idle is not None and r.t_first - before.t_last >= rule.idle:
                state = FRESH
            entering[r.seg] = (state, before.t_last)
        if r.parts is None:     # too many pieces to describe: run this partition by itself
            alone = segments.filter(F.col("seg") == r.seg).mapInArrow(
                _describe(rule, has_op, max_pieces, state), _SUMMARY).first()
            out = alone.parts[0].v
        else:
            out = evaluate([(p.lo, p.hi, p.v, p.slope) for p in r.parts], state)
        before = r
    return entering


def replay(events: DataFrame, period: int | None = None, rule: Rule | None = None,
           hot_key_rows: int = HOT_KEY_ROWS, max_pieces: int = MAX_PIECES) -> DataFrame:
    """Decide every event in ``(t, id)`` order per key; adds ``ok`` and ``lead``.

    ``events`` has ``key``, ``t`` (microseconds), ``id``, optionally ``op`` and ``arg``, and any
    columns to carry along.
    """
    rule = rule or Rule(period)
    has_op = "op" in events.columns
    spark = events.sparkSession
    extra = [T.StructField("ok", T.BooleanType()), T.StructField("lead", T.LongType())]
    counts = events.groupBy("key").count().agg(
        F.max("count").alias("top"), F.sum("count").alias("all")).first()
    if (counts["top"] or 0) <= hot_key_rows:
        # Not by "key" itself: after a join on it the planner would drop this exchange, and adaptive
        # execution may then turn that join into one that leaves the rows unpartitioned.
        ordered = events.repartition(F.xxhash64("key")).sortWithinPartitions("key", "t", "id")
        return ordered.mapInArrow(
            _decide(rule, has_op), T.StructType(events.schema.fields + extra))
    n = max(2, -(-counts["all"] // hot_key_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    segments = checkpointed(
        events.repartitionByRange(n, "key", "t", "id").sortWithinPartitions("key", "t", "id")
        .withColumn("seg", F.spark_partition_id()), spark)
    entering = _entering_states(segments, rule, has_op, max_pieces)
    return segments.mapInArrow(
        _decide(rule, has_op, entering), T.StructType(segments.schema.fields + extra)).drop("seg")
