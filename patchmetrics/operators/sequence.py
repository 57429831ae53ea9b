"""Ordinal numbering without a hot task, in DataFrame operations only (no value ever leaves the JVM).

``row_number() OVER (PARTITION BY k ORDER BY o)`` sends every row of one key to one task; if a single file holds a
third of all attempts, that task sorts a third of the data. ``sequence_within`` computes the same numbers with the
key split across tasks:

1. range-partition on ``(k, o)``, so a hot key spans several partitions, and write the rows with their partition
   number under ``spark.checkpoint.dir`` (AQE or a lost executor cannot change the partitions afterwards);
2. number the rows of each ``(partition, key)`` with ``row_number``;
3. only keys that span partitions need a carry: they are at most as many as partitions, and so are their counts per
   partition; the running sum of those counts is broadcast and added.

``dense_index`` is the key-less case: a contiguous 0-based id in a global order (never a one-partition window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffle_partitions
from ..sources.store import materialize

_PID, _OWN = "_sq_pid", "_sq_own"
HOT_ROWS = 200_000     # rows of a group that one task may sort


def sequence_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "seq",
                    num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based ordinal of each row within ``keys`` ordered by ``order`` (ascending, nulls first).

    Ties in ``order`` get distinct, arbitrary ordinals, as with ``row_number``. Make ``order`` unique within a key
    for reproducible numbers.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys, order = list(keys), list(order)
    n = num_partitions or shuffle_partitions(spark)
    parts = materialize(df.repartitionByRange(n, *keys, *order).withColumn(_PID, F.spark_partition_id()), "sequence")
    numbered = parts.withColumn(_OWN, F.row_number().over(Window.partitionBy(_PID, *keys).orderBy(*order)))

    names = [f"_sq_k{i}" for i in range(len(keys))]
    narrow = parts.select(F.col(_PID).alias("_sq_p"), *[F.col(k).alias(a) for k, a in zip(keys, names)])
    if keys:
        split = (narrow.groupBy(*names).agg(F.min("_sq_p").alias("lo"), F.max("_sq_p").alias("hi"))
                 .where("lo < hi").select(*[F.col(a).alias(f"{a}s") for a in names]))   # at most n keys
        same = [F.col(a).eqNullSafe(F.col(f"{a}s")) for a in names]
        narrow = narrow.join(F.broadcast(split), same, "left_semi")
    counts = narrow.groupBy("_sq_p", *names).agg(F.count(F.lit(1)).alias("_sq_n"))
    earlier = Window.partitionBy(*names).orderBy("_sq_p") if keys else Window.partitionBy(F.lit(0)).orderBy("_sq_p")
    carry = counts.withColumn("_sq_before", F.sum("_sq_n").over(earlier) - F.col("_sq_n")).drop("_sq_n")
    on = [F.col(_PID) == F.col("_sq_p"), *[F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, names)]]
    out = numbered.join(F.broadcast(carry), on, "left")
    return out.withColumn(name, (F.col(_OWN) + F.coalesce(F.col("_sq_before"), F.lit(0))).cast("bigint")) \
        .select(*df.columns, name)


def sequences_within(df: DataFrame, group: Sequence[str], ordinals: dict[str, tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """Add several ordinals, ``name -> (keys, order)``, where all ``keys`` hold those of ``group``; else as ``sequence_within``.

    Groups of at most ``HOT_ROWS`` rows are shuffled once, by ``group``, and numbered there for every ordinal. Larger ones
    are few (rows / ``HOT_ROWS`` at most) and go through ``sequence_within``, so none lands in one task.
    """
    names = [f"_sq_g{i}" for i in range(len(group))]
    sizes = df.groupBy(*[F.col(k).alias(a) for k, a in zip(group, names)]).agg(F.count(F.lit(1)).alias("_sq_n"))
    hot = materialize(sizes.where(F.col("_sq_n") > HOT_ROWS).select(*names), "hot_groups")
    same = [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(group, names)]
    if hot.isEmpty():
        cold, large = df, None
    else:
        cold, large = df.join(F.broadcast(hot), same, "left_anti"), df.join(F.broadcast(hot), same, "left_semi")
    for name, (keys, order) in sorted(ordinals.items(), key=lambda x: len(x[1][0])):     # the group's own keys first
        cold = cold.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
        large = large and sequence_within(large, keys, order, name)
    return cold if large is None else cold.unionByName(large)


def dense_index(df: DataFrame, order: Sequence[str], name: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """Contiguous 0-based index in the global order of ``order``; distributed (no single-partition window)."""
    out = sequence_within(df, [], order, name=name, num_partitions=num_partitions)
    return out.withColumn(name, F.col(name) - 1)
