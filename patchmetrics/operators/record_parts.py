"""A1 / A10 for hot files: nested audit records in parts of bounded size.

``audit.build_audit_log`` makes one record per file, as large as the file's attempts. Here a record is a chain of parts: each
has the columns of a record, its place in the chain (``part`` of ``n_parts``) and at most ``part_attempts`` attempts, in the
order of the traces' first appearance and then of the attempts. Attempts of one trace follow each other, so only the first
trace of a part can go on from the part before; ``continues`` says that it does. File-level and trace-level fields are
those of the whole file and trace in every part.

A reader needs no part beside another: files are the parts 0, traces are those of all parts but a continued first one,
attempts are those of all parts (``part_tables``). No step gathers more than one part: an attempt's place in its file is a
hot-safe running number (``sequence.sequences_within``), everything else is an aggregate or a join per trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialize
from . import audit, report
from .sequence import sequences_within

PART_ATTEMPTS = 4096


def build_audit_log_parts(priced: DataFrame, facts: DataFrame, part_attempts: int = PART_ATTEMPTS,
                          leftovers: DataFrame | None = None, **record) -> DataFrame:
    """The columns of ``audit.build_audit_log`` and ``part, n_parts, continues``; ``record`` are its other parameters."""
    traces = materialize(audit.vuln_traces(priced), "traces")
    shown = ["severity", "confidence_score", "status", "fixed_at_level", "time_to_remediation_s", "total_cost_usd"]
    whole_trace = traces.select(F.col("file_uid").alias("_f"), F.col("vulnerability_id").alias("_v"), "first_seq",
                                F.struct(*shown).alias("_trace"))
    known = priced.select("file_uid", "vulnerability_id", "attempt_seq", audit.attempt_struct().alias("_a")).join(
        whole_trace, (F.col("file_uid") == F.col("_f")) & (F.col("vulnerability_id") == F.col("_v"))).drop("_f", "_v")
    # The numbering shuffles by file; both groupings of a part find its rows together already.
    placed = sequences_within(known, ["file_uid"], {"_place": (["file_uid"], ["first_seq", "vulnerability_id", "attempt_seq"])})
    placed = placed.withColumn("part", F.floor((F.col("_place") - 1) / part_attempts).cast("int"))

    inner = placed.groupBy("file_uid", "vulnerability_id", "part").agg(
        F.min("attempt_seq").alias("_from"), F.first("first_seq").alias("first_seq"), F.first("_trace").alias("_trace"),
        F.transform(F.array_sort(F.collect_list(F.struct("attempt_seq", F.col("_a").alias("a")))), lambda x: x["a"]).alias("attempts"))
    trace = F.struct(F.col("vulnerability_id").alias("test_id"), *[F.col(f"_trace.{c}").alias(c) for c in shown], "attempts")
    parts = inner.groupBy(F.col("file_uid").alias("_pf"), "part").agg(
        F.max(F.col("_from") > F.col("first_seq")).alias("continues"),
        F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "vulnerability_id", trace.alias("t")))), lambda x: x["t"]).alias("_traces"))

    per_file = audit.with_leftovers(audit.file_rollup(traces), leftovers)
    sizes = traces.groupBy(F.col("file_uid").alias("_sf")).agg(F.ceil(F.sum("n_attempts") / part_attempts).cast("int").alias("_n"))
    files = facts.join(per_file, "file_uid", "left").join(sizes, F.col("file_uid") == F.col("_sf"), "left")
    whole = files.join(parts, F.col("file_uid") == F.col("_pf"), "left")
    return whole.select(*audit.record_columns(facts.columns, F.col("_traces"), **record), F.coalesce("part", F.lit(0)).alias("part"),
                        F.coalesce("_n", F.lit(1)).alias("n_parts"), F.coalesce("continues", F.lit(False)).alias("continues"))


def part_tables(parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(files, vulns, attempts)`` as ``report.log_tables`` gives them for whole records, without putting parts together."""
    files = report.log_tables(parts.where("part = 0"))[0]
    shown = F.when(F.col("continues"), F.slice("vulnerabilities", 2, F.greatest(F.size("vulnerabilities") - 1, F.lit(0)))) \
        .otherwise(F.col("vulnerabilities"))
    vulns = report.explode_vulnerabilities(parts.withColumn("vulnerabilities", shown))
    return files, report.of_valid_files(files, vulns), report.of_valid_files(files, report.explode_attempts(parts))


def kpi_report_of_parts(parts: DataFrame) -> DataFrame:
    """A25 over records in parts."""
    return report.kpi_report_flat(*part_tables(parts))
