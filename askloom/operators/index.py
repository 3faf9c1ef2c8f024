"""The index table: change detection, upsert, delete and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def index_manifest(index: DataFrame) -> DataFrame:
    """One stored hash per source, taken from the row with the smallest id."""
    return index.groupBy("source").agg(F.min_by("file_hash", "id").alias("stored_hash"))


def index_status(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """NEW, UNCHANGED or MODIFIED per source, by comparing hashes."""
    return sources.join(manifest, "source", "left").withColumn(
        "status",
        F.when(F.col("stored_hash").isNull(), "NEW")
        .when(F.col("stored_hash") == F.col("file_hash"), "UNCHANGED")
        .otherwise("MODIFIED")).drop("stored_hash")


def work_list(statuses: DataFrame) -> DataFrame:
    return statuses.filter(F.col("status") != "UNCHANGED")


def latest_per_id(rows: DataFrame, order: str) -> DataFrame:
    """Last written row of each id. The limit acts before the shuffle, so copies do not pile up."""
    last = Window.partitionBy("id").orderBy(F.col(order).desc(), F.col("source").desc())
    return rows.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") == 1).drop("_n")


def delete_sources(index: DataFrame, sources: DataFrame) -> DataFrame:
    return index.join(sources.select("source").distinct(), "source", "left_anti").select(*index.columns)


def upsert_index(index: DataFrame, new_rows: DataFrame, order: str = "seq") -> DataFrame:
    """Replace all rows of the sources in ``new_rows``, then insert or replace by id.

    A source without new rows keeps its old ones. ``order`` says which of several new rows with
    one id was written last; it may be left out of ``index``.
    """
    new = latest_per_id(new_rows, order)
    kept = delete_sources(index, new_rows).join(new.select("id"), "id", "left_anti")
    return kept.select(*index.columns).unionByName(new.select(*index.columns))


def apply_changes(index: DataFrame, changes: DataFrame, new_rows: DataFrame, sources: DataFrame,
                  order: str = "seq") -> DataFrame:
    """Last change per source applied to the index.

    ``sources`` has source and file_hash of what is there now, ``new_rows`` the chunks made of it.
    A source that is as it is stored keeps its rows. A modified one loses its old rows before its
    new ones come, so it is gone if it yields none.
    """
    asked = changes.filter(F.col("change") == "ingest").select("source")
    statuses = index_status(sources.select("source", "file_hash").join(asked, "source", "left_semi"), index_manifest(index))
    todo = work_list(statuses)
    lost = changes.filter(F.col("change") == "delete").select("source").unionByName(
        todo.filter(F.col("status") == "MODIFIED").select("source"))
    ingested = new_rows.join(todo.select("source"), "source", "left_semi")
    return upsert_index(delete_sources(index, lost), ingested, order)


def index_lookup(index: DataFrame, source: str, n: int = 1, fields=("id", "file_hash")) -> DataFrame:
    """First ``n`` rows of one source, by id."""
    return index.filter(F.col("source") == source).orderBy("id").limit(n).select(*fields)
