"""Daily quota and file events that come late."""

import random
from collections import Counter
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from askloom.operators import quota
from askloom.streaming import ingest as live, replay as streams
from test_index import LONG, rows_of

SCHEMA = "key string, t bigint, id bigint, note string"


def _plain(rows, per_day, zone):
    used, out = Counter(), Counter()
    for key, t, i, note in sorted(rows, key=lambda r: r[1:3]):
        local = datetime.fromtimestamp(t // 1_000_000, ZoneInfo(zone))
        day = local.date()
        used[key, day] += 1
        left = per_day - used[key, day]
        midnight = datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone)) + timedelta(days=1)
        wait = None if left >= 0 else -((t - int(midnight.timestamp()) * 1_000_000) // 1_000_000)
        out[key, t, i, note, left >= 0, max(left, 0), wait] += 1
    return out


def _log(n, seed):
    rnd = random.Random(seed)
    start = int(datetime(2024, 3, 30, tzinfo=ZoneInfo("UTC")).timestamp()) * 1_000_000
    return [(rnd.choice(["hot"] * 6 + ["a", "b", None]), start + rnd.randrange(3 * 86_400) * 1_000_000 + rnd.randrange(3) * 400_000, i, "x") for i in range(n)]


def test_quota_counts_calendar_days(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = _log(900, 1)
    log = spark.createDataFrame(rows, SCHEMA)
    for zone in ("UTC", "Europe/Paris"):  # a day of 23 hours is among them
        for per_day, piece in ((0, 60_000_000), (7, 3_600_000_000), (100, 1)):
            got = Counter(tuple(r) for r in quota.daily_quota(log, per_day, zone, piece).collect())
            assert got == _plain(rows, per_day, zone)
    assert quota.daily_quota(log.where("false"), 3).count() == 0


def test_a_hot_user_is_numbered_by_slices(spark):
    """No window holds more than a slice's rows, and none those after the quota is used up."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = [("hot", i * 1_000_000, i, "x") for i in range(20_000)]
    out = quota.daily_quota(spark.createDataFrame(rows, SCHEMA), 50, slice_us=600_000_000)
    assert out.where("allowed").count() == 50 and out.where("allowed").agg({"id": "max"}).first()[0] == 49
    numbered = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number()" in x and "Window [" in x]
    assert len(numbered) == 1 and "_slice" in numbered[0]


def test_quota_stream_goes_on_between_batches(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = sorted(_log(300, 2), key=lambda r: r[1:3])
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for lo in range(0, 300, 100):
        spark.createDataFrame([r for r in rows[lo:lo + 100]], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        streams.daily_quota_stream(stream, 9, "Europe/Paris").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert Counter(tuple(r) for r in spark.read.parquet(out).collect()) == _plain(rows, 9, "Europe/Paris")


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, t long, action string, src string, dest string")


def test_a_late_event_does_not_undo_a_newer_one(spark, tmp_path):
    path = str(tmp_path / "ix")
    live.create_index(spark, path)
    docs = spark.createDataFrame([(f"/{x}.pdf", f"{x} {LONG}", i) for i, x in enumerate("abcd")], "source string, content string, seq long")
    live.event_batch(spark, path, _events(spark, [(1, 200, "created", "/a.pdf", None), (2, 300, "deleted", "/b.pdf", None)]), docs, 0)
    late = _events(spark, [(3, 100, "deleted", "/a.pdf", None), (4, 250, "created", "/b.pdf", None), (5, 120, "moved", "/c.pdf", "/d.pdf")])
    live.event_batch(spark, path, late, docs, 1)
    assert [s for s, _ in rows_of(spark, path)] == ["/a.pdf", "/d.pdf"]
    live.event_batch(spark, path, late, docs, 1)  # the same batch again
    live.compact_index(spark, path)
    live.event_batch(spark, path, _events(spark, [(6, 90, "created", "/c.pdf", None), (7, 119, "deleted", "/d.pdf", None),
                                                  (1, 200, "deleted", "/x.pdf", None)]), docs, 2)
    assert [s for s, _ in rows_of(spark, path)] == ["/a.pdf", "/d.pdf"]
    live.event_batch(spark, path, _events(spark, [(8, 400, "created", "/b.pdf", None), (9, 400, "deleted", "/a.pdf", None)]), docs, 3)
    assert [s for s, _ in rows_of(spark, path)] == ["/b.pdf", "/d.pdf"]


def test_any_order_of_events_gives_the_same_index(spark, tmp_path):
    rnd = random.Random(5)
    docs = spark.createDataFrame([(f"/{x}.pdf", f"{x} {LONG}", i) for i, x in enumerate("abcde")], "source string, content string, seq long")
    log = [(i, rnd.randrange(40), rnd.choice(["created", "modified", "deleted", "moved"]), f"/{rnd.choice('abcde')}.pdf", f"/{rnd.choice('abcde')}.pdf")
           for i in range(24)]
    last = {}
    for i, t, action, src, dest in sorted(log, key=lambda e: (e[1], e[0])):
        last[src] = action in ("created", "modified")
        if action == "moved":
            last[dest] = True
    rnd.shuffle(log)
    src, path = str(tmp_path / "in"), str(tmp_path / "ix")
    live.create_index(spark, path)
    schema = "event_id long, t long, action string, src string, dest string"
    for lo in range(0, 24, 8):
        _events(spark, log[lo:lo + 8]).coalesce(1).write.mode("append").parquet(src)
        live.stream_events(spark.readStream.schema(schema).parquet(src), lambda: docs, path, str(tmp_path / "log"), availableNow=True).awaitTermination()
    assert [s for s, _ in rows_of(spark, path)] == sorted(s for s, here in last.items() if here)


def test_quota_stream_calls_python_once_a_block(spark, tmp_path):
    """One call for each user and day took longer than the work itself."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    day = 86_400_000_000
    big = (1 << 60) + 1                                  # no double holds it
    rows = [(f"u{i % 700}", (i % 2) * day + i, big + i, "x") for i in range(2_000)]
    rows += [(None, 5, big - 1, "x"), (None, 6, big - 2, None), ("", 5, big - 3, "x")]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(src)
    query = streams.daily_quota_stream(spark.readStream.schema(SCHEMA).parquet(src), 2).writeStream.format("parquet").option(
        "path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert Counter(tuple(r) for r in spark.read.parquet(out).collect()) == _plain(rows, 2, "UTC")
    # a block and day is one state; before, each of the 1,402 users and days was
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * streams.DAY_BLOCKS


def test_quota_stream_counts_rows_without_a_time_or_key_apart(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = [(None if i % 5 == 0 else f"u{i % 11}", None if i % 7 == 0 else i * 3_600_000_000, i, "x") for i in range(400)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    log = spark.createDataFrame(rows, SCHEMA)
    log.coalesce(1).write.parquet(src)
    streams.daily_quota_stream(spark.readStream.schema(SCHEMA).parquet(src), 2).writeStream.format("parquet").option(
        "path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert Counter(tuple(r) for r in spark.read.parquet(out).collect()) == Counter(tuple(r) for r in quota.daily_quota(log, 2).collect())
