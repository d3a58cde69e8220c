"""Session helpers: settings for local runs and the shared folder for data that must outlive a stage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

LOCAL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Recording the Python call site of every column expression costs more than building the plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quorumql")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
    )
    for key, value in LOCAL_SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Folders made so far, innermost scope last; the first list holds those of no scope.
_made: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=([],))


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session, or its checkpoint directory.

    A session without either gets a temporary folder if its master is local; on a cluster that is an error, since
    every executor would write to a disk of its own. The session's own settings are never changed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = _local_folder()
    return folder.rstrip("/")


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="quorumql-")


def new_folder(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder; the innermost ``scratch`` removes it."""
    path = f"{shared_folder(spark)}/quorumql/{label}-{uuid.uuid4().hex}"
    _made.get()[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving what was written below the shared folder inside; results must be used up or stored before."""
    before = _made.get()
    token = _made.set((*before, []))
    try:
        yield
    finally:
        made = _made.get()[-1]
        _made.reset(token)
        remove_folders(spark, made)


def remove_folders(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


def freeze(df: DataFrame, label: str = "frozen") -> DataFrame:
    """Write ``df`` once and read it back.

    Used where values depend on how a stage was partitioned (partition ids, row numbers inside a partition):
    after the write they are plain data, so a lost executor cannot change them, and later plans read only the
    columns they need. The files stay until the ``scratch`` around the call ends; without one they stay in the
    shared folder, like any reliable checkpoint.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
