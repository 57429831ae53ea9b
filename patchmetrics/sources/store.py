"""Materialised intermediates: parquet tables under the session's ``spark.checkpoint.dir``.

A written table cuts the lineage like ``checkpoint()`` (lost executors recompute nothing upstream) and, unlike an
RDD checkpoint, is read back with vectorised parquet scans, column pruning and filter pushdown.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


_WRITTEN: list[str] = []   # tables of this driver process; ``release`` empties it
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def release(spark: SparkSession, written: list[str] = _WRITTEN) -> None:
    """Delete every table written by ``materialize`` (runs when the driver's Python exits), or those of a caller's list."""
    with contextlib.suppress(Exception):   # the JVM may be gone by then
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while written:
            at = jvm.org.apache.hadoop.fs.Path(written.pop())
            at.getFileSystem(conf).delete(at, True)


def materialize(df: DataFrame, name: str, written: list[str] | None = None) -> DataFrame:
    """``df`` written and read back. It lasts until the driver exits, or with ``written`` until the caller releases that list."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    if written is None:
        if not _WRITTEN:
            atexit.register(release, spark)
        written = _WRITTEN
    written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """The shuffle files of every write inside go when it ends, not when the driver next happens to collect its garbage."""
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
