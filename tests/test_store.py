"""The stored index against the plain operators, and what a reader sees of a failed change."""

import os

import pytest

from askloom.operators import index, store

ROWS = "id string, source string, file_hash string, seq long"


def _rows(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def _all(df):
    return sorted(tuple(r) for r in df.select("id", "source", "file_hash", "seq").collect())


def test_changes_equal_the_plain_operators(spark, tmp_path):
    path = str(tmp_path / "ix")
    plain = _rows(spark, [(f"i{k}", f"/{k % 9}", f"h{k % 9}", k) for k in range(40)])
    assert store.create_store(path, plain, buckets=4) == 0
    assert _all(store.read_store(spark, path)) == _all(plain)
    new = _rows(spark, [("i3", "/new", "x", 50), ("n1", "/2", "y", 51), ("n1", "/5", "y", 52)])
    store.upsert_store(path, new)
    plain = index.upsert_index(plain, new)
    assert _all(store.read_store(spark, path)) == _all(plain)
    assert _all(store.read_store(spark, path, "/new")) == [("i3", "/new", "x", 50)]
    gone = spark.createDataFrame([("/4",), ("/absent",)], "source string")
    store.delete_from_store(spark, path, gone)
    plain = index.delete_sources(plain, gone)
    assert _all(store.read_store(spark, path)) == _all(plain)
    changes = spark.createDataFrame([("/0", "ingest"), ("/1", "delete"), ("/6", "ingest"), ("/7", "ingest")], "source string, change string")
    now = spark.createDataFrame([("/0", "h0"), ("/6", "other"), ("/7", "more")], "source string, file_hash string")
    fresh = _rows(spark, [("z", "/0", "h0", 60), ("m", "/7", "more", 61)])
    store.change_store(path, changes, fresh, now)
    assert _all(store.read_store(spark, path)) == _all(index.apply_changes(plain, changes, fresh, now))


def test_only_touched_buckets_are_written_and_half_a_change_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "ix")
    store.create_store(path, _rows(spark, [(f"i{k}", f"/{k}", "h", k) for k in range(64)]), buckets=8)
    before = _all(store.read_store(spark, path))
    version = store.upsert_store(path, _rows(spark, [("i7", "/7", "new", 99)]))
    assert len([d for d in os.listdir(f"{path}/data/version={version}") if d.startswith("bucket=")]) == 1
    after = _all(store.read_store(spark, path))
    assert after != before
    os.makedirs(f"{path}/current/version={version + 1}")  # a writer died before its names were complete
    assert _all(store.read_store(spark, path)) == after
    with pytest.raises(ValueError):
        store.read_store(spark, str(tmp_path / "none"))
