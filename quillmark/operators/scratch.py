"""Tables that cut lineage: written once to the folder that every executor sees, dropped when nothing reads them any more."""

from __future__ import annotations

import atexit
import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Deletes the shuffle files of a finished execution at once, not whenever the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: dict[str, SparkSession] = {}


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quillmark-")


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may do without: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or _own_folder()


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once and read back from its table; the shuffle files of the write go as soon as it ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/quillmark-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _written[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._quillmark_table = path
    return back


def drop(*frames: DataFrame) -> None:
    """Delete the tables of frames that ``written`` gave."""
    for df in frames:
        _delete(df._quillmark_table)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Delete every table; frames that still read one must not be used afterwards."""
    while _written:
        try:
            _delete(next(iter(_written)))
        except Exception:  # the session may be gone already
            return


atexit.register(release)
