"""What the training-data operators share: tables, scratch tables, order neighbours.

Rows are told apart by ``(doc_id, hash of the text)``, so repeated ids, repeated
rows and null ids never multiply rows in a join: equal rows share one decision.
"""

from __future__ import annotations

import atexit
import functools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A side is broadcast only if its measured size is below this many bytes.
BROADCAST_BYTES = 24 * 1024 * 1024

#: Deletes the shuffle files of a finished execution at once, not whenever the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scratch: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quillmark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees. Only a local session may do without one: it gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or _own_folder()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write go as soon as it ends; the table goes with ``drop`` or ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillmark-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _scratch[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._quillmark_path = path
    return back


def drop(*frames: DataFrame) -> None:
    """Delete the scratch tables of frames that ``materialize`` gave and that nothing reads any more."""
    for df in frames:
        _delete(df._quillmark_path)


def _delete(path: str) -> None:
    spark = _scratch.pop(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Delete every scratch table; frames that still read them must not be used afterwards."""
    while _scratch:
        try:
            _delete(next(iter(_scratch)))
        except Exception:  # the session may be gone already
            return


atexit.register(release)


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def same(left: DataFrame, right: DataFrame, *pairs: tuple[str, str]) -> Column:
    """Null-safe equality of the pairs of columns."""
    return functools.reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def with_neighbours(keys: DataFrame, order: list[str], take: list[str]) -> DataFrame:
    """Add the ``take`` columns of the previous and next row in the order of ``order``.

    ``keys`` holds light rows only (ids, short strings). They are range-partitioned
    and written once, so the cut points stay fixed; within a range a window gives
    the neighbours, and a table of one row per range gives those across a cut.
    Adds structs ``_prev`` and ``_next`` (null at the ends). ``order`` should be
    unique; equal rows come in any order.
    """
    spark = keys.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(keys.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    pack = F.struct(*take)
    w = W.partitionBy("_pid").orderBy(*order)
    rows = placed.withColumn("_p", F.lag(pack).over(w)).withColumn("_n", F.lead(pack).over(w))
    o = F.struct(*order)
    ends = placed.groupBy("_pid").agg(F.min_by(pack, o).alias("_first"), F.max_by(pack, o).alias("_last"))
    by_pid = W.orderBy("_pid")  # one row for each range, so at most as many as shuffle partitions
    ends = ends.select(F.col("_pid").alias("_pid2"), F.lag("_last").over(by_pid).alias("_before"), F.lead("_first").over(by_pid).alias("_after"))
    out = rows.join(F.broadcast(ends), rows["_pid"] == ends["_pid2"])  # one row for each range
    return out.withColumn("_prev", F.coalesce("_p", "_before")).withColumn("_next", F.coalesce("_n", "_after")).drop("_p", "_n", "_before", "_after", "_pid", "_pid2")
