"""Keeping an index table current from a stream of files.

The table is a base plus one folder per micro-batch with the chunks that came in and the sources
that were deleted. A micro-batch only writes what is new, and writing it again after a failure
replaces the same folder. Readers merge the batches onto the base with anti joins whose right
sides are the small ones; ``compact_index`` folds the batches into a new base.

File events may come late. The last change of every source, a delete as well, is kept as its mark;
an event older than the mark of its source changes nothing, in whichever batch it comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from askloom.operators.index import (
    delete_sources, index_manifest, index_status, latest_per_id, work_list)
from askloom.operators.embed import embed_text
from askloom.plans.ingest import INDEX_COLUMNS, INDEX_SCHEMA, index_rows
from askloom.sources.events import last_changes
from askloom.sources.files import with_fingerprint

_ROWS = INDEX_SCHEMA + ", seq bigint"
_MARKS = "source string, last struct<t: bigint, event_id: bigint, seq: int, change: string>"


def create_index(spark: SparkSession, path: str) -> None:
    """An empty index table."""
    _write(spark.createDataFrame([], _ROWS), f"{path}/base/upto=-1")
    _write(spark.createDataFrame([], _ROWS), f"{path}/chunks/batch=-1")
    _write(spark.createDataFrame([], "source string"), f"{path}/gone/batch=-1")
    _write(spark.createDataFrame([], _MARKS), f"{path}/marks/batch=-1")
    _write(spark.createDataFrame([], _MARKS), f"{path}/oldmarks/upto=-1")


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _parts(spark: SparkSession, path: str):
    base = spark.read.schema(_ROWS + ", upto bigint").parquet(f"{path}/base")
    upto = base.agg(F.max("upto")).first()[0]
    if upto is None:            # only empty files so far
        upto = -1
    chunks = spark.read.schema(_ROWS + ", batch bigint").parquet(f"{path}/chunks")
    gone = spark.read.schema("source string, batch bigint").parquet(f"{path}/gone")
    after = F.col("batch") > upto
    return base.filter(F.col("upto") == upto).drop("upto"), chunks.filter(after), gone.filter(after)


def _merged(base: DataFrame, chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose id was written last by a source that was not touched in a later batch."""
    touched = chunks.select("source", "batch").unionByName(gone).groupBy("source").agg(
        F.max("batch").alias("last"))
    written = latest_per_id(chunks.withColumn(
        "_order", F.struct("batch", "seq")), "_order").drop("_order")
    alive = written.join(touched, "source").filter(F.col("batch") == F.col("last"))
    kept = base.join(touched, "source", "left_anti").join(
        chunks.select("id").distinct(), "id", "left_anti")
    columns = INDEX_COLUMNS + ["seq"]
    return kept.select(*columns).unionByName(alive.select(*columns))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return _merged(*_parts(spark, path)).select(*INDEX_COLUMNS)


def compact_index(spark: SparkSession, path: str) -> None:
    """Fold all batches into a new base. Run it while no batch is being written."""
    _compact_marks(spark, path)
    base, chunks, gone = _parts(spark, path)
    last = chunks.select("batch").unionByName(gone.select("batch")).agg(F.max("batch")).first()[0]
    if last is not None:
        _write(_merged(base, chunks, gone), f"{path}/base/upto={last}")


def ingest_batch(spark: SparkSession, path: str, documents: DataFrame, batch: int,
                 gone: DataFrame | None = None, embed=embed_text) -> None:
    """One micro-batch: ``source, content, seq`` rows that are new or changed, and deleted sources."""
    before = _before(spark, path, batch)
    if gone is not None:
        before = delete_sources(before, gone)
    last = documents.groupBy("source").agg(F.max_by("content", "seq").alias("content"),
                                           F.max("seq").alias("seq"))
    todo = work_list(index_status(with_fingerprint(last), index_manifest(before)))
    # a modified source loses its old rows even if its new content yields none
    lost = todo.filter(F.col("status") == "MODIFIED").select("source")
    _write((lost if gone is None else lost.unionByName(gone.select("source"))).distinct(), f"{path}/gone/batch={batch}")
    _write(index_rows(todo, embed, carry=["seq"]), f"{path}/chunks/batch={batch}")


def _before(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The index as it was before this batch, so that a repeated batch sees the same."""
    base, chunks, gone = _parts(spark, path)
    return _merged(base, chunks.filter(F.col("batch") < batch), gone.filter(F.col("batch") < batch))


def _newest(marks: DataFrame) -> DataFrame:
    return marks.groupBy("source").agg(F.max("last").alias("last"))


def _mark_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Marks folded together, and those of later batches."""
    old = spark.read.schema(_MARKS + ", upto bigint").parquet(f"{path}/oldmarks")
    upto = old.agg(F.max("upto")).first()[0]
    upto = -1 if upto is None else upto
    new = spark.read.schema(_MARKS + ", batch bigint").parquet(f"{path}/marks")
    return old.where(F.col("upto") == upto).drop("upto"), new.where(F.col("batch") > upto)


def _compact_marks(spark: SparkSession, path: str) -> None:
    old, new = _mark_parts(spark, path)
    last = new.agg(F.max("batch")).first()[0]
    if last is not None:
        _write(_newest(old.unionByName(new.drop("batch"))), f"{path}/oldmarks/upto={last}")


def newer_changes(spark: SparkSession, path: str, events: DataFrame, batch: int) -> DataFrame:
    """``source, last``: the last change per source of these events where no earlier batch had a newer
    one. An event that an earlier batch had already is not newer."""
    here = last_changes(events.withColumns({"t": F.col("t").cast("bigint"), "event_id": F.col("event_id").cast("bigint")}))
    old, new = _mark_parts(spark, path)
    seen = old.unionByName(new.where(F.col("batch") < batch).drop("batch"))
    seen = _newest(seen.join(here.select("source"), "source", "left_semi")).withColumnRenamed("last", "mark")
    return here.join(seen, "source", "left").where(F.col("mark").isNull() | (F.col("last") > F.col("mark"))).drop("mark")


def event_batch(spark: SparkSession, path: str, events: DataFrame, documents: DataFrame,
                batch: int, embed=embed_text) -> None:
    """One micro-batch of file events, with the present content of the files in ``documents``.

    Events may be late and come again: only a change newer than all of its source's before takes
    effect. The batch's marks are written first and its rows last, each over what a failed try left;
    a batch that is run again sees only the marks of earlier ones.
    """
    _write(newer_changes(spark, path, events, batch), f"{path}/marks/batch={batch}")
    changes = spark.read.schema(_MARKS).parquet(f"{path}/marks/batch={batch}").select("source", "last.change")
    moved_in = changes.filter(F.col("change") == "ingest").select("source")
    ingest_batch(spark, path, documents.join(moved_in, "source", "left_semi"), batch,
                 gone=changes.filter(F.col("change") == "delete"), embed=embed)


def stream_events(events: DataFrame, documents, path: str, checkpoint: str, embed=embed_text, **trigger):
    """Start the upkeep of an index from a stream of file events; returns the running query.

    ``documents`` is called once a micro-batch and gives the present ``source, content, seq``.
    """
    def one(batch_df, batch_id):
        event_batch(batch_df.sparkSession, path, batch_df, documents(), batch_id, embed)

    return events.writeStream.foreachBatch(one).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_ingest(documents: DataFrame, path: str, checkpoint: str, embed=embed_text, **trigger):
    """Start the ingest of a stream of ``source, content, seq``; returns the running query.

    ``trigger`` is passed on, for example ``availableNow=True`` for a backfill.
    """
    def one(batch_df, batch_id):
        ingest_batch(batch_df.sparkSession, path, batch_df, batch_id, embed=embed)

    return documents.writeStream.foreachBatch(one).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
