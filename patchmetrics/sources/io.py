"""Sources and sinks (S1-S7). Every reader takes an explicit schema; nothing is inferred.

Paths are anything Spark can read (local, HDFS, object stores); on a cluster they must be shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import AUDIT_LOG_DDL, CORPUS_DDL

ORDER_COLS = ["_src_file", "_src_block"]


def with_source_order(df: DataFrame) -> DataFrame:
    """``df``, a file scan, with the columns ``_src_file, _src_block``: the file and the first byte of the scanned split.

    Rows of one split are read in file order by one task, so these two and the place within the split are the corpus
    order (``operators.corpus.index_by_source_order``).
    """
    return df.select("*", F.col("_metadata.file_path").alias("_src_file"), F.col("_metadata.file_block_start").alias("_src_block"))


def read_corpus_jsonl(spark: SparkSession, path: str, schema: str = CORPUS_DDL) -> DataFrame:
    """JSON Lines corpus with a stable corpus order.

    ``_src_file, _src_block`` (``with_source_order``) give rows their place in the files, which is what
    ``prepare_corpus(order_cols=ORDER_COLS)`` needs for the 0-based row index. Blank lines produce no row.
    """
    return with_source_order(spark.read.schema(schema).json(path))


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Audit log JSON Lines; blank lines are skipped, a malformed line fails the read (FAILFAST), a missing
    path raises ``AnalysisException``."""
    return spark.read.schema(AUDIT_LOG_DDL).option("mode", "FAILFAST").json(path)


def read_text_files(spark: SparkSession, path_glob: str) -> DataFrame:
    """One row per file, ``(path, text)`` with the whole UTF-8 content, byte-exact.

    The ``binaryFile`` source keeps every byte (the text source's whole-file mode drops a final newline).
    """
    df = spark.read.format("binaryFile").load(path_glob)
    return df.select(F.col("path"), F.decode(F.col("content"), "UTF-8").alias("text"))


def write_corpus(prepared: DataFrame, path: str, as_text_files: bool = False) -> None:
    """The prepared corpus. Default: one parquet dataset keyed by ``sample_id`` (no small-files problem).
    ``as_text_files`` writes one folder per ``filename`` holding the code text, for tools that want files."""
    cols = prepared.select("sample_id", "filename", "code")
    if as_text_files:
        cols.select("filename", "code").write.mode("overwrite").partitionBy("filename").text(path)
    else:
        cols.write.mode("overwrite").parquet(path)


def append_audit_log(log: DataFrame, path: str) -> None:
    """Append audit records as JSON Lines (each record one line, decimal costs kept exact)."""
    log.write.mode("append").json(path)


def write_patched_code(df: DataFrame, path: str, partition_col: str = "batch") -> None:
    """Overwrite patched code per batch partition, leaving other batches untouched (dynamic overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(path))


def read_scan_reports(spark: SparkSession, path_glob: str) -> DataFrame:
    """Scanner JSON reports, one file per scanned document: ``(path, report)`` for ``explode_scan_report``."""
    return read_text_files(spark, path_glob).withColumnRenamed("text", "report")
