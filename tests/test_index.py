import pytest
from pyspark.sql import functions as F

from askloom.operators import index
from askloom.sources import events as ev, files
from askloom.streaming import ingest as live, replay as live_replay


def test_status_and_work_list(spark):
    src = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h1")], "source string, file_hash string")
    stored = spark.createDataFrame([("a", "h1", "x"), ("b", "h1", "y"), ("b", "h1", "z")],
                                   "source string, file_hash string, id string")
    st = index.index_status(src, index.index_manifest(stored))
    assert {r.source: r.status for r in st.collect()} == {"a": "UNCHANGED", "b": "MODIFIED", "c": "NEW"}
    assert {r.source for r in index.work_list(st).collect()} == {"b", "c"}


def test_settled(spark):
    sizes = {"late": [0, 0, 5, 9, 9], "soon": [4, 4], "empty": [0, 0, 0], "slow": list(range(1, 16)) + [15]}
    rows = [(p, i, i, s) for p, v in sizes.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "path string, t long, obs_id long, size long")
    assert {r.path: r.poll for r in ev.settled_files(df).collect()} == {"late": 5, "soon": 2}


def test_upsert_replaces_sources_and_ids(spark):
    schema = "id string, source string, v int"
    old = spark.createDataFrame([("1", "a", 0), ("2", "a", 0), ("3", "b", 0), ("4", "c", 0)], schema)
    new = spark.createDataFrame([("1", "a", 1, 1), ("3", "d", 1, 2), ("3", "e", 2, 3)], schema + ", seq long")
    got = {(r.id, r.source, r.v) for r in index.upsert_index(old, new).collect()}
    assert got == {("1", "a", 1), ("3", "e", 2), ("4", "c", 0)}
    again = {(r.id, r.source, r.v) for r in index.upsert_index(
        spark.createDataFrame(sorted(got), schema), new).collect()}
    assert again == got


def test_file_changes(spark):
    rows = [(1, 1, "created", "/a.pdf", None), (2, 2, "moved", "/a.pdf", "/b.PDF"), (3, 3, "moved", "/c.pdf", "/c.txt"),
            (4, 4, "modified", "/d.txt", None), (5, 5, "deleted", "/e.pdf", None), (6, 6, "modified", "/e.pdf", None)]
    df = spark.createDataFrame(rows, "event_id long, t long, action string, src string, dest string")
    got = {r.source: r.change for r in ev.file_changes(df).collect()}
    assert got == {"/a.pdf": "delete", "/b.PDF": "ingest", "/c.pdf": "delete", "/e.pdf": "ingest"}


def test_scan_directory(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"same bytes")
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "d.pdf").write_bytes(b"x")
    both = files.scan_directory(spark, str(tmp_path)).collect()
    assert sorted(r.filename for r in both) == ["a.pdf", "b.PDF"]
    assert len({r.file_hash for r in both}) == 1 and len(both[0].doc_hash) == 8
    assert [r.filename for r in files.scan_directory(spark, str(tmp_path), ignore_case=False).collect()] == ["a.pdf"]


def test_html(spark):
    html = "<p>a &lt;b&gt;</p><script>x<y</script><!-- <p> -->\n<style>p{}</style><b>c</b> &amp;amp;<br>d"
    assert spark.createDataFrame([(html,)], "h string").select(files.html_to_text("h")).first()[0] == \
        "a <b>\nc &amp;\nd"


LONG = " ".join(["some words of text that make a page long enough"] * 3)


def rows_of(spark, path):
    return sorted((r.source, r.text[:6]) for r in live.read_index(spark, path).collect())


def test_batches_merge_and_repeat(spark, tmp_path):
    path = str(tmp_path / "ix")
    live.create_index(spark, path)

    def batch(n, docs, gone=None):
        df = spark.createDataFrame(docs, "source string, content string, seq long")
        g = None if gone is None else spark.createDataFrame([(x,) for x in gone], "source string")
        live.ingest_batch(spark, path, df, n, gone=g, embed=lambda c: F.array(F.lit(0.0).cast("float")))

    batch(0, [("/a", "one " + LONG, 1), ("/b", "two " + LONG, 2), ("/c", "tiny", 3)])
    want = [("/a", "one so"), ("/b", "two so")]
    assert rows_of(spark, path) == want
    batch(1, [("/a", "one " + LONG, 1), ("/b", "new " + LONG, 4)])      # a unchanged, b modified
    want = [("/a", "one so"), ("/b", "new so")]
    assert rows_of(spark, path) == want
    assert spark.read.parquet(f"{path}/chunks/batch=1").select("source").distinct().count() == 1
    batch(1, [("/a", "one " + LONG, 1), ("/b", "new " + LONG, 4)])      # the batch is run again
    assert rows_of(spark, path) == want
    batch(2, [("/d", "new " + LONG, 5)])                                # same bytes: ids go over to d
    assert rows_of(spark, path) == [("/a", "one so"), ("/d", "new so")]
    live.compact_index(spark, path)
    assert rows_of(spark, path) == [("/a", "one so"), ("/d", "new so")]
    batch(3, [("/e", "one " + LONG, 6)], gone=["/d"])
    assert rows_of(spark, path) == [("/e", "one so")]
    live.compact_index(spark, path)
    assert rows_of(spark, path) == [("/e", "one so")]


def test_modified_source_without_chunks_is_gone(spark, tmp_path):
    path = str(tmp_path / "ix")
    live.create_index(spark, path)
    schema = "source string, content string, seq long"
    live.ingest_batch(spark, path, spark.createDataFrame([("/a", "one " + LONG, 1), ("/b", "two " + LONG, 2)], schema), 0)
    live.ingest_batch(spark, path, spark.createDataFrame([("/a", "tiny", 3), ("/b", "two " + LONG, 4)], schema), 1)
    assert [s for s, _ in rows_of(spark, path)] == ["/b"]
    index_ = spark.createDataFrame([("i1", "/a", "h1"), ("i2", "/b", "h2"), ("i3", "/c", "h3")], "id string, source string, file_hash string")
    changes = spark.createDataFrame([("/a", "ingest"), ("/b", "ingest"), ("/c", "delete"), ("/x", "ingest")], "source string, change string")
    now = spark.createDataFrame([("/a", "h9"), ("/b", "h2"), ("/c", "h3")], "source string, file_hash string")
    rows = spark.createDataFrame([("new", "/b", "h2", 1)], "id string, source string, file_hash string, seq long")
    from askloom.operators import index
    assert [tuple(r) for r in index.apply_changes(index_, changes, rows, now).collect()] == [("i2", "/b", "h2")]


def test_event_batch(spark, tmp_path):
    path = str(tmp_path / "ix")
    live.create_index(spark, path)
    docs = spark.createDataFrame([(f"/{x}.pdf", f"{x} {LONG}", i) for i, x in enumerate("abc")],
                                 "source string, content string, seq long")
    live.ingest_batch(spark, path, docs.limit(2), 0)
    events = spark.createDataFrame([(1, 1, "moved", "/a.pdf", "/c.pdf"), (2, 2, "deleted", "/b.pdf", None)],
                                   "event_id long, t long, action string, src string, dest string")
    live.event_batch(spark, path, events, docs, 1)
    assert [s for s, _ in rows_of(spark, path)] == ["/c.pdf"]


def test_stream_of_files(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "ix")
    live.create_index(spark, path)
    schema = "source string, content string, seq long"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        live.stream_ingest(stream, path, str(tmp_path / "log"), availableNow=True).awaitTermination()

    arrive([("/a", "one " + LONG, 1), ("/b", "two " + LONG, 2)])
    arrive([("/a", "six " + LONG, 3)])
    assert rows_of(spark, path) == [("/a", "six so"), ("/b", "two so")]


def test_streamed_bucket_keeps_state_between_batches(spark, tmp_path):
    from askloom.operators import throttle
    from test_replay import skewed

    rows = sorted(skewed(300, 600, seed=4), key=lambda r: (r[1], r[2]))
    schema, src, out = "key string, t long, id long", str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:100], rows[100:200], rows[200:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        live_replay.token_bucket_stream(stream, 5, 0.25).writeStream.format("parquet").option(
            "path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(
            availableNow=True).start().awaitTermination()
    key = lambda df: sorted(tuple(r) for r in df.select("id", "allowed", "remaining", "retry_after_s").fillna(-1).collect())
    assert key(spark.read.parquet(out)) == key(throttle.token_bucket(spark.createDataFrame(rows, schema), 5, 0.25))


def test_streamed_dedup_drops_inside_interval(spark, tmp_path):
    schema, src, out = "key string, t long, id long", str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("p", x, i) for i, x in enumerate([0, 4, 9, 10, 12, 21])], schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    live_replay.dedup_events_stream(stream, 10).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 3, 5]


def test_state_of_silent_keys_is_dropped_in_event_time(spark, tmp_path):
    """A slow backlog must not lose live state, and a key whose bucket is full again holds none."""
    schema, src, out = "key string, t long, id long", str(tmp_path / "in"), str(tmp_path / "out")
    hour = 3_600_000_000
    days = [[("a", 0, 0), ("a", 1, 1), ("b", 2, 2)], [("c", 90 * hour, 3)], [("c", 91 * hour, 4)], [("c", 92 * hour, 5), ("a", 92 * hour, 6)]]
    for part in days:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        query = live_replay.token_bucket_stream(stream, 2, 1 / 7200).writeStream.format("parquet").option(
            "path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert {r.id: r.remaining for r in spark.read.parquet(out).collect()} == {0: 1, 1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # c, a and their timers


@pytest.mark.parametrize("lateness", [None, "1 day"])
def test_files_in_reverse_time_order_lose_no_row(spark, tmp_path, lateness):
    """All rows are decided in arrival order; only a lateness that is asked for leaves some out and drops state."""
    from askloom.operators.replay import FRESH, Rule

    schema, src, rule = "key string, t long, id long", str(tmp_path / "in"), Rule.bucket(2, 1 / 7200)
    hour = 3_600_000_000
    parts = [[("a", 900 * hour, 0), ("b", 901 * hour, 1)], [("a", 500 * hour, 2), ("c", 500 * hour, 3), ("c", 501 * hour, 4)],
             [("a", 1 * hour, 5), ("b", 2 * hour, 6), ("d", 3 * hour, 7)]]
    state, want = {}, {}
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        for key, t, i in part:
            want[i], _, state[key] = rule.step(state.get(key, FRESH), t * rule.scale, 0, 0)
    streams = {"bucket": live_replay.token_bucket_stream, "cache": live_replay.cache_stream, "dedup": live_replay.dedup_events_stream}
    how = {"bucket": (2, 1 / 7200), "cache": (60,), "dedup": (60,)}
    got, size = {}, {}
    for name, stream in streams.items():
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        asked = {} if lateness is None else {"lateness": lateness}
        query = stream(events, *how[name], **asked).writeStream.format("parquet").option(
            "path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / (name + "-log"))).trigger(
            availableNow=True).start()
        query.awaitTermination()
        got[name] = {r.id: r for r in spark.read.parquet(str(tmp_path / name)).collect()}
        size[name] = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    if lateness is None:
        assert {i: r.allowed for i, r in got["bucket"].items()} == want
        assert set(got["cache"]) == set(range(8)) and {3, 4, 7} <= set(got["dedup"]) and set(size.values()) == {4}
    else:
        assert all({0, 1} <= set(g) and not {5, 6, 7} & set(g) for g in got.values())
