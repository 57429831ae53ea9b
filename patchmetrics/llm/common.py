"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Letters of the word pattern ``[^\x20\x09-\x0D]+``: every run without ASCII white space is a word.
WHITE_SPACE = " \t\n\x0b\x0c\r"
TASKS_PER_CORE = 3
ROW_GROUP = 16 << 20     # bytes a task holds before it writes them, for each table that it writes
NON_SPACE = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


class Scratch:
    """A folder under the cluster's ``spark.checkpoint.dir`` for written intermediates of one operator call.

    Written tables cut the lineage and survive lost executors. The folder goes when the Python driver exits; tables
    that the returned frame does not read can be dropped earlier with ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
        """Write ``df`` and return the written table.

        ``narrow`` tables (a few numbers a row) are written by at most ``TASKS_PER_CORE`` tasks per core of the
        cluster: as parallel as it can run, without a file and a task for each of many near-empty partitions.
        """
        self._n += 1
        if narrow:
            df = df.coalesce(TASKS_PER_CORE * max(1, self.spark.sparkContext.defaultParallelism))
        path = f"{self.path}/{self._n:02d}-{name}"
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the named written tables, or (without arguments) the whole folder."""
        paths = [f._scratch_path for f in frames] or [self.path]
        with contextlib.suppress(Exception):  # the JVM may be gone at exit
            jvm = self.spark.sparkContext._jvm
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            for p in paths:
                at = jvm.org.apache.hadoop.fs.Path(p)
                at.getFileSystem(conf).delete(at, True)


def give_back() -> None:
    """Hand memory that this process has freed back to the system: a Python worker outlives its task, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):   # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that few Python strings live at once; freed memory goes back before and after."""
    give_back()
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    give_back()


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Helper column names that ``docs`` does not have (underscores are put before a name that it has)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def crc32_mod(col: Column, n: int) -> Column:
    """``crc32(text of the id) mod n``; null for a null id."""
    return F.crc32(col.cast("string")) % F.lit(n)


def global_rank(df: DataFrame, order: list[str], scratch: Scratch, name: str = "rank") -> DataFrame:
    """0-based position of each row in the order of ``order`` (ascending, nulls last), without a one-task sort.

    Range partitions are written once, so their numbers stay fixed; each is then numbered by itself and shifted by the
    rows of the partitions before it (one row per partition is broadcast).
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in order]
    parts = scratch.save(df.repartitionByRange(shuffle_partitions(spark), *keys)
                         .withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, at = [], 0
    for part, n in sizes:
        before.append((part, at))
        at += n
    shifts = spark.createDataFrame(before or [(0, 0)], "_part int, _before long")
    w = Window.partitionBy("_part").orderBy(*keys)
    return (parts.withColumn("_at", F.row_number().over(w)).join(F.broadcast(shifts), "_part")
            .withColumn(name, F.col("_at") + F.col("_before") - 1).drop("_part", "_at", "_before"))
