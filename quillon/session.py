"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import count

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on. `conf` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own: on a cluster a
    machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="quillon-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dropped(spark: SparkSession, folder: str) -> None:
    """Remove a folder, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def stored_for_a_while(df: DataFrame, purpose: str) -> Iterator[DataFrame]:
    """`df` written to the shared folder and read again; the files go at the end of the block."""
    folder = f"{checkpoint_folder(df.sparkSession)}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(folder)
    finally:
        dropped(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession, purpose: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a DataFrame as a table of one shared folder and reads it again; the folder goes at the end.

    A written table cuts the lineage as a checkpoint does, in one job, and its size is known to the planner.
    """
    folder = f"{checkpoint_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    number = count()

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(number)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        dropped(spark, folder)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written as a compressed table in the shared folder, and read again."""
    folder = f"{checkpoint_folder(df.sparkSession)}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
