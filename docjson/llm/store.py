"""Durable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_DIRS: dict[str, str] = {}
_PATHS: dict[int, tuple[str, weakref.ref]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A local one is made only where it is unset and all tasks run in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _DIRS:
        _DIRS[app] = "file://" + tempfile.mkdtemp(prefix="docjson-")
        spark.sparkContext.setCheckpointDir(_DIRS[app])
    return _DIRS[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a re-read instead of a recomputation, and a table with several readers is computed once.
    The files go when the application ends, or with :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop, spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(made)] = path, weakref.ref(made)
    return made


def discard(df: DataFrame) -> None:
    """Remove the files of a table that :func:`materialise` made, once nothing will read it any more."""
    path, made = _PATHS.pop(id(df), (None, None))
    if path is not None and made() is df:
        _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # already stopped
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
