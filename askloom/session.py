"""Session helpers: where shared files go, and instants as integers."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, SparkSession, functions as F

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names for checkpoints. Only a local session may do without one."""
    path = spark.conf.get(_CONF, None)
    if path:
        return path
    sc = spark.sparkContext
    if not re.match(r"local(\[|$)", sc.master):  # local-cluster has executors of its own
        raise ValueError(f"set {_CONF} to a folder that every executor can reach")
    path = getattr(spark, "_askloom_shared_dir", None)
    if path is None:
        path = tempfile.mkdtemp(prefix="askloom-")
        spark._askloom_shared_dir = path
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df, spark: SparkSession):
    """Cut the lineage through files in the shared folder, so lost executors cost nothing."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df, name: str):
    """The rows through files below the shared folder. Unlike a checkpoint's their size is known to the
    planner, so a small table is broadcast to a join instead of the large side being shuffled."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def micros(ts) -> Column:
    """Microseconds since the epoch. Zone-less timestamps are read in the session time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def spread(df):
    """Use all cores when the input came in fewer splits than there are; larger inputs stay put."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session; needless where it is installed."""
    if getattr(spark.sparkContext, "_askloom_shipped", False):
        return
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="askloom-"), "askloom"), "zip", home, "askloom")
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._askloom_shipped = True
