"""Explicit schemas (no inference anywhere) for the library's record types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS_DDL = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
ATTEMPT_DDL = (f"struct<level:int,model:string,status:string,finish_reason:string,duration_s:double,"
               f"cost_usd:decimal(18,6),tokens:{TOKENS_DDL}>")
TRACE_DDL = (f"struct<test_id:string,severity:string,confidence_score:string,status:string,fixed_at_level:int,"
             f"time_to_remediation_s:double,total_cost_usd:decimal(18,6),attempts:array<{ATTEMPT_DDL}>>")
CODE_STATS_DDL = "struct<loc:bigint,avg_cyclomatic_complexity:double,vuln_count:bigint>"

# Audit log, one record per file.
AUDIT_LOG_DDL = (
    "meta struct<file_uid:string,dataset:string,implementation_version:string,timestamp:string,"
    "total_pipeline_duration_s:double>, "
    f"input_stats {CODE_STATS_DDL}, "
    "language string, "
    f"security_summary struct<fixed_count:bigint,new_issues_introduced:bigint,final_code_stats:{CODE_STATS_DDL},"
    "normalized_loc_churn:bigint,ast_churn:bigint>, "
    "total_cost_usd decimal(18,6), "
    f"vulnerabilities array<{TRACE_DDL}>"
)

# Raw attempt as produced by a patching step (token counts flattened).
RAW_ATTEMPT_DDL = ("file_uid string, vulnerability_id string, attempt_seq bigint, level_attempted int, model string, "
                   "status string, finish_reason string, prompt_tokens bigint, completion_tokens bigint, "
                   "total_tokens bigint, llm_time_taken double, severity string, confidence string")

# Scanner report (one JSON object per scanned document).
SCAN_REPORT_DDL = ("struct<results:array<struct<issue_confidence:string,issue_severity:string,issue_text:string,"
                   "line_range:array<int>,test_id:string,test_name:string,more_info:string,code:string>>>")

# Code-sample corpus (JSON Lines); only these two columns are used.
CORPUS_DDL = "lang string, chosen string"

# Allowed values.
ATTEMPT_STATUSES = ("SUCCESS", "FAILED", "SYNTAX_ERROR")
TRACE_STATUSES = ("FIXED", "FAILED")


def reject_invalid_audit_rows(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a parsed audit log into ``(valid, rejected)`` by its required fields.

    Required: ``meta.file_uid``, ``input_stats.vuln_count``, ``security_summary.fixed_count``, ``total_cost_usd``,
    and every trace's ``test_id``/``status`` with ``status`` in FIXED/FAILED.
    """
    trace_ok = F.forall(F.coalesce(F.col("vulnerabilities"), F.array()),
                        lambda v: v["test_id"].isNotNull() & v["status"].isin(*TRACE_STATUSES))
    ok = (F.col("meta.file_uid").isNotNull() & F.col("input_stats.vuln_count").isNotNull()
          & F.col("security_summary.fixed_count").isNotNull() & F.col("total_cost_usd").isNotNull() & trace_ok)
    flagged = log.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return flagged.filter("_ok").drop("_ok"), flagged.filter(~F.col("_ok")).drop("_ok")
