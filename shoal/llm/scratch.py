"""Staged tables: lineage is cut by writing Parquet to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid

from pyspark.sql import DataFrame, SparkSession

from shoal import session

_SEEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only where a single process is all there is."""
    _SEEN[spark.sparkContext.applicationId] = spark
    return session.shared_dir(spark)


@atexit.register
def _at_exit() -> None:
    """What was staged goes with the application, if its context still runs."""
    for spark in _SEEN.values():
        with contextlib.suppress(Exception):  # the context or its gateway may be gone
            if spark.sparkContext._jsc is not None:
                clear(spark)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once and read it back: later jobs start from files, whichever executors are lost.

    The planner then knows the table's real size, so it broadcasts it only below
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges with skew splitting.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shoal_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a staged table that no later step reads."""
    path = getattr(df, "_shoal_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application staged; nothing made from it can be read any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_HELD: dict = {}


def held(key, make=None):
    """What a worker process keeps from task to task: one thing at a time, as a worker serves one operator after another and what
    each keeps is large. ``held(None)`` keeps nothing."""
    if key not in _HELD:
        _HELD.clear()
        with contextlib.suppress(OSError, AttributeError):  # glibc keeps what is freed unless told otherwise
            ctypes.CDLL(None).malloc_trim(0)
        _HELD[key] = make and make()
    return _HELD[key]


def bounded(texts, size, limit: int = 2_000_000):
    """Groups of texts (null: empty) of about ``limit`` in all; a longer text is a group of its own."""
    group, total = [], 0
    for t in texts:
        t = t or ""
        if group and total + size(t) > limit:
            yield group
            group, total = [], 0
        group.append(t)
        total += size(t) + 1
    if group:
        yield group
