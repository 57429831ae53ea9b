"""S6 + C4: an audit log that grows by batches, may be appended twice, and is reported from additive states.

``append_batch`` writes a batch (its records as gzipped JSON Lines and the report's states over them) into a folder of its own
and then commits it with one manifest file named after the batch. Readers see the folders named by manifests only, so

* a failed or half-written append leaves nothing visible;
* appending a batch again, after a rerun or a lost reply, changes nothing;
* of two writers of one batch the first to commit wins.

Renaming a file to a name that must not exist is the one atomic step asked of the file system (as HDFS has it).

The report's figures are sums, so a batch stores one row of file sums, one of attempt sums and one row per severity and
rule. What is not additive is kept as rows: a record of a file without vulnerabilities contributes its traces if another
record of the same file has some (J2), and that record may be in another batch. Such traces and attempts, and the ids of
valid files, are stored narrow; ``report_of_batches`` settles them with one semi join and never reads a log record.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report
from .io import read_audit_log
from .store import materialize, release, shuffles_freed

TABLES = ("files", "attempts", "traces", "valid_ids", "open_traces", "open_attempts")
FILE_RECORDS = 100_000     # records of one file: a gzipped file is read by one task


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _manifest(path: str, batch: str) -> str:
    if not batch or "/" in batch or batch.startswith((".", "_")):
        raise ValueError("a batch name is not empty, has no slash and starts with neither dot nor underscore")
    return f"{path.rstrip('/')}/manifests/{batch}.json"


def committed(spark: SparkSession, path: str) -> dict[str, str]:
    """Folder of every committed batch, by batch name."""
    fs, folder = _fs(spark, f"{path.rstrip('/')}/manifests")
    if not fs.exists(folder):
        return {}
    names = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")]
    if not names:
        return {}
    rows = spark.read.schema("batch string, folder string").json([str(n) for n in names]).collect()   # one row per batch
    return {r["batch"]: f"{path.rstrip('/')}/{r['folder']}" for r in rows}


def _marked(log: DataFrame, written: list[str] | None = None) -> DataFrame:
    """The records of a batch parsed once, with ``in_valid``: some record of the batch has vulnerabilities in that file.

    A record with vulnerabilities settles that itself; only the others are shuffled, to the ids of the valid files.
    """
    trace = lambda v: F.struct(v["test_id"].alias("test_id"), v["severity"].alias("severity"), v["status"].alias("status"),
                               F.transform(v["attempts"], attempt).alias("attempts"))
    attempt = lambda x: F.struct(x["level"].alias("level"), x["status"].alias("status"),
                                 F.struct(x["tokens"]["total_tokens"].alias("total_tokens")).alias("tokens"))
    own = F.col("meta.file_uid").isNotNull() & F.coalesce(F.col("input_stats.vuln_count") > 0, F.lit(False))
    read = materialize(log.select(F.struct("meta.file_uid").alias("meta"), "input_stats", "security_summary", "total_cost_usd",
                                  F.transform("vulnerabilities", trace).alias("vulnerabilities"), own.alias("in_valid")),
                       "batch_marked", written)
    valid = report.valid_files(read).select(F.col("meta.file_uid").alias("_uid")).distinct()
    rest = read.where("NOT in_valid").join(valid, F.col("meta.file_uid") == F.col("_uid"), "left")
    settled = materialize(rest.withColumn("in_valid", F.col("_uid").isNotNull()).drop("_uid"), "batch_marked_rest", written)
    return read.where("in_valid").unionByName(settled)


def _states(log: DataFrame, written: list[str] | None = None) -> dict[str, DataFrame]:
    known = _marked(log, written)
    files = report.log_tables(known)[0]
    entries = known.where("in_valid")
    # Records of files that no record of this batch makes valid: settled when all batches are known.
    waiting = known.where("NOT in_valid")
    return {"files": report.file_state(files), "attempts": report.attempt_state(report.explode_attempts(entries)),
            "traces": report.trace_state(report.explode_vulnerabilities(entries)),
            "valid_ids": files.where("vuln_count > 0").select("file_uid").distinct(),
            "open_traces": report.explode_vulnerabilities(waiting), "open_attempts": report.explode_attempts(waiting)}


def append_batch(log: DataFrame, path: str, batch: str) -> bool:
    """Append ``log`` as ``batch``; False (and nothing written) if that batch is there already.

    The lines are gzipped (their keys repeat in every attempt), and what a batch needs beside its folder goes with it.
    """
    spark = log.sparkSession
    fs, manifest = _fs(spark, _manifest(path, batch))
    if fs.exists(manifest):
        return False
    folder = f"batches/{batch}-{uuid.uuid4().hex}"
    at = f"{path.rstrip('/')}/{folder}"
    written: list[str] = []
    with shuffles_freed(spark):
        try:
            log.write.option("maxRecordsPerFile", FILE_RECORDS).json(f"{at}/log", compression="gzip")
            stored = read_audit_log(spark, f"{at}/log")       # the states are those of the records as written
            for name, table in _states(stored, written).items():
                table.write.parquet(f"{at}/{name}")
        finally:
            release(spark, written)
    return commit(spark, path, batch, folder)


def commit(spark: SparkSession, path: str, batch: str, folder: str) -> bool:
    """Name ``folder`` in the batch's manifest: written beside it, then renamed to a name that must not exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, manifest = _fs(spark, _manifest(path, batch))
    _, draft = _fs(spark, f"{path.rstrip('/')}/manifests/_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"batch": batch, "folder": folder}), "utf-8"))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, manifest, options)
    except Exception:
        if not fs.exists(manifest):
            raise
        _, lost = _fs(spark, f"{path.rstrip('/')}/{folder}")
        fs.delete(lost, True)                          # another writer of this batch was first
        fs.delete(draft, False)
        return False
    return True


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The records of all committed batches (S2's rules)."""
    folders = committed(spark, path)
    if not folders:
        raise ValueError(f"no batch is committed under {path}")
    return read_audit_log(spark, [f"{f}/log" for f in folders.values()])


def report_of_batches(spark: SparkSession, path: str) -> DataFrame:
    """A25 over all committed batches, from their states: equal to ``kpi_report`` of all their records."""
    folders = committed(spark, path)
    if not folders:
        raise ValueError(f"no batch is committed under {path}")
    t = {name: spark.read.parquet(*[f"{f}/{name}" for f in folders.values()]) for name in TABLES}
    ids = t["valid_ids"].distinct()
    late = {name: t[f"open_{name}"].join(ids, "file_uid", "left_semi") for name in ("traces", "attempts")}
    attempts = t["attempts"].unionByName(report.attempt_state(late["attempts"]))
    traces = t["traces"].unionByName(report.trace_state(late["traces"]))
    return report.report_rows(report.add_states(t["files"]), report.add_states(attempts),
                              report.add_states(traces, ["severity", "test_id", "gid"]))
