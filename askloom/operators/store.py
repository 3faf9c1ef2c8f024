"""The index as a stored table: parquet in buckets of the source, with versions that swap at once.

``path/data/version=V/bucket=B`` holds a bucket's rows as version V left them, and
``path/current/version=V`` one row per bucket that names the version to read it from. A version
exists when its file of names is complete, so readers see all of a change or nothing of it, and a
repeated or failed write leaves no trace. One writer at a time. A change reads and writes only the buckets of its sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askloom.operators.index import apply_changes, delete_sources, upsert_index

_NAMES = "bucket int, version long"


def bucket_of(source, buckets: int) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName()[8:]) for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _current(spark: SparkSession, path: str) -> dict[int, int]:
    """Version of every bucket; as many rows as there are buckets."""
    versions = _versions(spark, path)
    if not versions:
        raise ValueError(f"no index at {path}")
    rows = spark.read.schema(_NAMES).parquet(f"{path}/current/version={versions[-1]}").collect()
    return {r["bucket"]: r["version"] for r in rows}


def _read(spark: SparkSession, path: str, names: dict[int, int]) -> DataFrame:
    schema = spark.read.parquet(f"{path}/shape").schema
    folders = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(names.items()) if v >= 0]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def _write(spark: SparkSession, path: str, rows: DataFrame, touched: list[int], names: dict[int, int]) -> int:
    version = max([-1, *_versions(spark, path)]) + 1
    n = len(names)
    (rows.withColumn("bucket", bucket_of("source", n)).repartition(F.col("bucket"), F.pmod(F.xxhash64("id"), F.lit(8)))
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}"))
    written = spark.read.parquet(f"{path}/data/version={version}").select("bucket").distinct().collect() if rows.take(1) else []
    full = {r["bucket"] for r in written}
    new = names | {b: (version if b in full else -1) for b in touched}
    spark.createDataFrame(sorted(new.items()), _NAMES).coalesce(1).write.mode("overwrite").parquet(f"{path}/current/version={version}")
    return version


def create_store(path: str, rows: DataFrame, buckets: int = 256) -> int:
    """A new stored index with these rows (id, source and any other columns); gives its version."""
    spark = rows.sparkSession
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/shape")
    return _write(spark, path, rows, list(range(buckets)), {b: -1 for b in range(buckets)})


def read_store(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """All rows of the current version, or those of one source, for which one bucket is read."""
    names = _current(spark, path)
    if source is None:
        return _read(spark, path, names)
    b = spark.range(1).select(bucket_of(F.lit(source), len(names))).first()[0]
    return _read(spark, path, {b: names[b]}).filter(F.col("source") == source)


def _touched(sources: DataFrame, n: int) -> list[int]:
    """Buckets of the sources; at most as many as there are."""
    return sorted(r[0] for r in sources.select(bucket_of("source", n)).distinct().collect())


def _change(spark, path, touched, make) -> int:
    names = _current(spark, path)
    old = _read(spark, path, {b: names[b] for b in touched})
    return _write(spark, path, make(old), touched, names)


def upsert_store(path: str, new_rows: DataFrame, order: str = "seq") -> int:
    """``upsert_index`` on the stored index.

    Sources in different buckets can hold equal bytes and so equal ids; the buckets where those
    ids are now are found through the id column alone and changed with the others.
    """
    spark = new_rows.sparkSession
    names = _current(spark, path)
    n = len(names)
    taken = _read(spark, path, names).select("id", "source").join(new_rows.select("id").distinct(), "id", "left_semi")
    touched = _touched(new_rows.select("source").unionByName(taken.select("source")), n)
    return _change(spark, path, touched, lambda old: upsert_index(old, new_rows, order))


def delete_from_store(spark: SparkSession, path: str, sources: DataFrame) -> int:
    touched = _touched(sources, len(_current(spark, path)))
    return _change(spark, path, touched, lambda old: delete_sources(old, sources))


def change_store(path: str, changes: DataFrame, new_rows: DataFrame, sources: DataFrame, order: str = "seq") -> int:
    """``apply_changes`` on the stored index: deletes, modified and new sources in one version."""
    spark = changes.sparkSession
    names = _current(spark, path)
    taken = _read(spark, path, names).select("id", "source").join(new_rows.select("id").distinct(), "id", "left_semi")
    touched = _touched(changes.select("source").unionByName(taken.select("source")), len(names))
    return _change(spark, path, touched, lambda old: apply_changes(old, changes, new_rows, sources, order))
