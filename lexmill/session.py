"""Session settings for tests and benchmarks; operators never change a session's settings."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "lexmill", **extra: str) -> SparkSession:
    """A local session in UTC with adaptive execution on."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        # Python workers import this package, whatever the driver's working folder is.
        .config("spark.executorEnv.PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. A local session that names none gets a temporary one."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexmill-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


#: Folders that queries of this process have made.
_landed: list[str] = []


def landing_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; drop_landed removes it."""
    _landed.append(f"{shared_folder(spark)}/lexmill-{name}-{uuid.uuid4().hex}")
    return _landed[-1]


#: What else is to be done when landed folders go: functions of the session that return a number of things removed.
_also: list[Callable[[SparkSession], int]] = []


def also_drop(action: Callable[[SparkSession], int]) -> None:
    _also.append(action)


def drop_landed(spark: SparkSession) -> int:
    """Remove what queries have landed in the shared folder, once their results are read. Returns the number of things removed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    gone = sum(action(spark) for action in _also)
    for text in _landed:
        path = hadoop.Path(text)
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _landed.clear()
    return gone


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder: later plans read the same rows in the same partitions. Spark removes the files once nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
