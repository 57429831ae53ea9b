"""Corpus preparation (C1) and systematic sampling (C5's selection).

``prepare_corpus``: keep one language, give every kept row a contiguous 0-based ``sample_id`` in corpus order
*before* dropping blanks (so blanks leave gaps, as in the reference), strip code fences, drop blank code, derive
``sample_<id>.py``. The id is a distributed dense index, never a single-partition window: in the order of the source
files it is computed from row counts per split, and no text moves (``index_by_source_order``); any other order sorts
(``operators.sequence.dense_index``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip_fences
from ..sources.io import ORDER_COLS
from ..sources.store import materialize
from .sequence import dense_index

# File naming of prepared samples.
FILENAME_PREFIX, FILENAME_SUFFIX = "sample_", ".py"


def filter_language(df: DataFrame, lang: str, lang_col: str = "lang") -> DataFrame:
    """Exact, case-sensitive equality (pushed down to the parquet scan)."""
    return df.filter(F.col(lang_col) == F.lit(lang))


def sample_filename(sample_id) -> F.Column:
    """P4."""
    sid = F.col(sample_id) if isinstance(sample_id, str) else sample_id
    return F.concat(F.lit(FILENAME_PREFIX), sid.cast("string"), F.lit(FILENAME_SUFFIX))


def index_by_source_order(df: DataFrame, name: str = "idx") -> DataFrame:
    """``df`` with its contiguous 0-based row number in the order of its source files, without moving a row.

    ``df`` is a file scan with ``ORDER_COLS`` (``sources.io.with_source_order``), filtered or projected at will. One narrow
    pass counts the rows of each split and notes the task-local number of its first one; prefix sums of the counts, within
    each file and over the files, give the split's offset. The second pass adds a row's place within its split. Task-local
    numbers of a file scan depend on its splits alone, so a repeated task (a lost executor) numbers its rows as before.
    The only thing sent to all tasks is two numbers per split (13 MB for 100 TB in splits of 128 MB).
    """
    file, block = ORDER_COLS
    rows = df.withColumn("_at", F.monotonically_increasing_id())
    splits = materialize(rows.groupBy(file, block).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), "splits")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy(file).agg(F.sum("_n").alias("_t"))          # one narrow row per file
    before = files.select(F.col(file).alias("_f"), F.coalesce(F.sum("_t").over(earlier(Window.orderBy(file))), F.lit(0)).alias("_files"))
    inside = F.coalesce(F.sum("_n").over(earlier(Window.partitionBy(file).orderBy(block))), F.lit(0))
    placed = splits.withColumn("_inside", inside).join(before, F.col(file) == F.col("_f"))
    shift = placed.select(F.xxhash64(file, block).alias("_split"), (F.col("_files") + F.col("_inside") - F.col("_first")).alias("_shift"))
    shift = materialize(shift, "split_offsets")
    numbered = rows.join(F.broadcast(shift), F.xxhash64(file, block) == F.col("_split"))
    return numbered.withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_split", "_shift")


def prepare_corpus(df: DataFrame, lang: str = "python", code_col: str = "chosen", order_cols: Sequence[str] = (),
                   lang_col: str = "lang") -> DataFrame:
    """C1 = P1 -> P3 -> X1 -> P2 -> P4.

    ``order_cols`` fixes "corpus order": ``sources.io.ORDER_COLS`` for the order of the source files (no row is moved), or
    any stable key; the original columns are kept, so the old position stays available. Output adds ``sample_id``,
    ``code``, ``filename``.
    """
    kept = filter_language(df, lang, lang_col)
    if not order_cols:
        raise ValueError("prepare_corpus needs order_cols: a stable corpus order for the contiguous ids")
    by_source = list(order_cols) == ORDER_COLS
    indexed = index_by_source_order(kept, "sample_id") if by_source else dense_index(kept, list(order_cols), "sample_id")
    cleaned = indexed.withColumn("code", strip_fences(F.col(code_col)))
    return cleaned.filter(~is_blank(F.col("code"))).withColumn("filename", sample_filename("sample_id"))


def systematic_sample(df: DataFrame, id_col: str, start: int = 0, stop: int = 420, step: int = 5) -> DataFrame:
    """S9 + J9: rows whose id is in ``range(start, stop, step)``.

    Membership in an arithmetic range is a predicate, not a join: the range bounds push down to the scan and no
    id list is materialised or broadcast, whatever the range size.
    """
    if step <= 0:
        raise ValueError("step must be positive")
    i = F.col(id_col)
    return df.filter((i >= start) & (i < stop) & (F.pmod(i - F.lit(start), F.lit(step)) == 0))


def sample_ids(spark, start: int = 0, stop: int = 420, step: int = 5) -> DataFrame:
    """S9 as a table of ids (``spark.range``), for callers that want the id list itself."""
    return spark.range(start, stop, step).withColumnRenamed("id", "sample_id")
