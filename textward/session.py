"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str | None = None,
    app: str = "textward",
    shuffle_partitions: int | None = None,
    scratch: str | None = None,
) -> SparkSession:
    """A session with the settings this package is tuned for.

    ``scratch`` becomes ``spark.checkpoint.dir`` where the environment names none.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # text work is heavy per byte: small shuffles keep all cores busy instead of being merged
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call sites are not recorded for every column: plans are built faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        # one JVM: its heap must be set before it starts
        builder = builder.config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if scratch and not SparkConf().get("spark.checkpoint.dir"):
        builder = builder.config("spark.checkpoint.dir", scratch)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``.

    All executors must see it, so a local folder is used in local mode only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = os.path.join(tempfile.gettempdir(), "textward")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether Spark removes the shuffle files of a job when it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, codec: str | None = None, tidy: bool = False) -> DataFrame:
    """Write a frame that is used several times to the scratch folder and read it back.

    Unlike a cache it survives the loss of executors and cuts the plan.  ``codec`` is for frames
    that are large: zstd takes less disk than the session's default.  With ``tidy`` the shuffle
    files of the job go when it has ended, instead of at the driver's next collection of garbage.
    """
    if tidy:
        path = stage_path(df, name, codec)
    else:
        path = scratch_dir(df.sparkSession, name)
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_path(df: DataFrame, name: str, codec: str | None = None, by: str | None = None) -> str:
    """As :func:`stage` with ``tidy``, in a folder for each value of ``by``; gives the path."""
    conf, path = df.sparkSession.conf, scratch_dir(df.sparkSession, name)
    before = conf.get(_TIDY, "false")
    conf.set(_TIDY, "true")
    try:
        df.write.parquet(path, partitionBy=by, compression=codec)
    finally:
        conf.set(_TIDY, before)
    return path
