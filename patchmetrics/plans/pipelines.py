"""Composite pipelines: C1 prepare, C2 remediate, C3 audit log, C4 report, C5 sample run.

Each is a plain chain of DataFrame functions -- no scheduler or workflow runtime.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, report
from ..operators.cascade import remediate
from ..operators.corpus import prepare_corpus, systematic_sample
from ..sources.io import append_audit_log, write_patched_code

__all__ = ["prepare_corpus", "remediate", "before_after", "build_audit_log_from_run", "kpi_report", "run_sample"]

kpi_report = report.kpi_report


def before_after(before: DataFrame, after: DataFrame, key: str = "file_uid") -> DataFrame:
    """Statistics of both versions of a file side by side, suffixed ``_before`` and ``_after``."""
    side = lambda df, end: df.select(key, *[F.col(c).alias(f"{c}_{end}") for c in df.columns if c != key])
    return side(before, "before").join(side(after, "after"), key)


def build_audit_log_from_run(attempts: DataFrame, before: DataFrame, after: DataFrame, findings_after: DataFrame,
                             leftovers: DataFrame, pricing: DataFrame, dataset: str, churn: DataFrame | None = None,
                             key: str = "doc_id") -> DataFrame:
    """C3 from a cascade run.

    ``before`` / ``after``: ``key, loc, cc`` per file (caller's statistics, e.g. ``churn.code_stats`` over its block
    table); ``churn``: ``key, normalized_loc_churn, ast_churn`` (null without); ``findings_after``: the re-scan of
    the final code; ``leftovers``: one row per unresolved finding. Files of attempts without statistics stay, with
    null statistics.
    """
    name = lambda df: df.withColumnRenamed(key, "file_uid")
    n_after = name(findings_after).groupBy("file_uid").agg(F.count(F.lit(1)).alias("vuln_count_after"))
    facts = before_after(name(before), name(after)).join(attempts.select("file_uid").distinct(), "file_uid", "full_outer")
    if churn is None:
        facts = facts.withColumn("normalized_loc_churn", F.lit(None).cast("bigint")).withColumn(
            "ast_churn", F.lit(None).cast("bigint"))
    else:
        facts = facts.join(name(churn), "file_uid", "left")
    facts = facts.join(n_after, "file_uid", "left").withColumn(
        "vuln_count_after", F.coalesce("vuln_count_after", F.lit(0)))
    priced = audit.price_attempts(audit.normalize_attempts(attempts), pricing)
    return audit.build_audit_log(priced, facts, dataset=dataset, leftovers=name(leftovers))


def run_sample(corpus: DataFrame, findings: DataFrame, responder, rescan, statistics, pricing: DataFrame, log_path: str,
               code_path: str, start: int = 0, stop: int = 420, step: int = 5, dataset: str = "corpus",
               models=None, batch: str = "run") -> DataFrame:
    """Systematic sample of prepared samples -> cascade -> audit log appended (S6) -> patched code.

    ``corpus``: prepared corpus (``sample_id, code``); ``findings`` keyed by ``sample_id`` as ``doc_id``;
    ``statistics``: function from a code table to ``doc_id, loc, cc``. Returns the audit log of the run.
    """
    docs = systematic_sample(corpus, "sample_id", start, stop, step).select(
        F.col("sample_id").alias("doc_id"), "code")
    f = findings.join(docs.select("doc_id"), "doc_id", "left_semi")
    attempts, patched, left = remediate(docs, f, responder, rescan, models=models)
    log = build_audit_log_from_run(attempts, statistics(docs), statistics(patched), rescan(patched), left, pricing,
                                   dataset)
    append_audit_log(log, log_path)
    write_patched_code(patched.withColumn("batch", F.lit(batch)), code_path)
    return log
