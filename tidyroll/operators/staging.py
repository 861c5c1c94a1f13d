"""Intermediate tables that outlive the executors, and their end.

A staged table lies in the folder that the cluster names in `spark.checkpoint.dir`; where
that is unset, in a folder of the session's warehouse. A warehouse on local disks is refused unless
the session is a single process, as executors elsewhere would not see its files. `release` deletes
what a session has staged; `settled` keeps the result of a step and deletes what led to it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
WAREHOUSE = "spark.sql.warehouse.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_staged: dict[str, list[tuple[str, DataFrame | None]]] = {}


#: Masters whose tasks all run in the driver's process.
_ONE_PROCESS = re.compile(r"local(\[[^\]]*\])?$")
#: Paths without a scheme or with that of local files.
_LOCAL_PATH = re.compile(r"(file:|[^:]*$)")


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables; reading it changes no setting of the session."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    folder = spark.conf.get(WAREHOUSE)
    if _LOCAL_PATH.match(folder) and not _ONE_PROCESS.match(spark.conf.get("spark.master", "")):
        raise ValueError(f"set {SETTING} to a folder that all executors share; the warehouse {folder} is local")
    return folder.rstrip("/") + "/_staged"


def _of_session(spark: SparkSession) -> list[tuple[str, DataFrame | None]]:
    return _staged.setdefault(spark.sparkContext.applicationId, [])


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder, which `release` deletes too."""
    path = f"{shared_folder(spark)}/tidyroll/{name}-{uuid.uuid4().hex}"
    _of_session(spark).append((path, None))
    return path


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go when it has ended: its table replaces them."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder now, and read it back.

    For a table that several later steps read. They start from files with known sizes, a lost
    executor costs no more than the current step, and the plans stay small.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidyroll/{name}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path, partitionBy=partition_by)
    table = spark.read.schema(df.schema).parquet(path)
    _of_session(spark).append((path, table))
    return table


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to `path` to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables: those given, or all of the session.

    Frames that still read them can't be evaluated afterwards, so a report has to be written
    or collected first.
    """
    kept = []
    for path, table in _of_session(spark):
        if tables and not any(table is t for t in tables):
            kept.append((path, table))
        else:
            _delete(spark, path)
    _staged[spark.sparkContext.applicationId] = kept


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str, *read: DataFrame) -> DataFrame:
    """The result of `make`, staged, with everything deleted that was staged on the way to it, and
    the staged tables `read` that nothing needs from here on."""
    before = len(_of_session(spark))
    result = stage(make(), name)
    staged = _of_session(spark)
    for path, _ in staged[before:-1]:
        _delete(spark, path)
    _staged[spark.sparkContext.applicationId] = [*staged[:before], staged[-1]]
    if read:
        release(spark, *read)
    return result


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end whatever was staged inside."""
    before = len(_of_session(spark))
    try:
        yield
    finally:
        new = _of_session(spark)[before:]
        for path, _ in new:
            _delete(spark, path)
        _staged[spark.sparkContext.applicationId] = _of_session(spark)[:before]
