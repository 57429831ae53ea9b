"""KPI report semantics (J2, A15-A23, D18, P15) and the JSON round trip (S6 -> S2 -> C4)."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from patchmetrics.operators import report
from patchmetrics.schemas import AUDIT_LOG_DDL
from patchmetrics.sources.io import append_audit_log, read_audit_log


def entry(uid, vuln_count, fixed, cost, traces, churn=1, ast=2, cc=(1.0, 1.5)):
    return {"meta": {"file_uid": uid, "dataset": "d", "implementation_version": "v", "timestamp": "t",
                     "total_pipeline_duration_s": 1.0},
            "input_stats": {"loc": 10, "avg_cyclomatic_complexity": cc[0], "vuln_count": vuln_count},
            "language": "python",
            "security_summary": {"fixed_count": fixed, "new_issues_introduced": 0,
                                 "final_code_stats": {"loc": 10, "avg_cyclomatic_complexity": cc[1], "vuln_count": 0},
                                 "normalized_loc_churn": churn, "ast_churn": ast},
            "total_cost_usd": cost, "vulnerabilities": traces}


def trace(tid, sev, status, attempts):
    return {"test_id": tid, "severity": sev, "confidence_score": "HIGH", "status": status, "fixed_at_level": None,
            "time_to_remediation_s": 1.0, "total_cost_usd": 0.0,
            "attempts": [{"level": lv, "model": "m", "status": st, "finish_reason": "stop", "duration_s": 1.0,
                          "cost_usd": 0.0, "tokens": {"prompt_tokens": 1, "completion_tokens": 1, "total_tokens": tok}}
                         for lv, st, tok in attempts]}


LOG = [
    entry("a", 2, 1, 0.5, [trace("B1", "HIGH", "FIXED", [(1, "SUCCESS", 100)]),
                           trace("B2", "LOW", "FAILED", [(1, "FAILED", 10), (2, "FAILED", 30)])]),
    entry("b", 0, 0, 0.0, [trace("B1", "HIGH", "FAILED", [(1, "FAILED", 5)])]),          # zero-vuln, excluded
    entry("a", 0, 0, 0.25, [trace("B3", "HIGH", "FIXED", [(2, "SUCCESS", 300)])]),       # duplicate uid
    entry("c", 1, 1, 0.25, [trace("B1", "HIGH", "FIXED", [(1, "SUCCESS", 200)])], churn=None),
]


def log_df(spark, rows=LOG):
    path = tempfile.mkdtemp(prefix="pm-log-")
    with open(os.path.join(path, "log.jsonl"), "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n\n")   # blank lines are skipped
    return read_audit_log(spark, path)


def test_sections(spark):
    log = log_df(spark)
    assert report.dataset_counts(log).collect()[0].asDict() == {"loaded": 4, "analyzed": 2, "excluded": 2}
    entries = report.valid_entries(log)
    assert sorted(r.file_uid for r in report.explode_vulnerabilities(entries).collect()) == ["a", "a", "a", "c"]
    files = report.valid_files(log)
    fr = report.vuln_fix_rate(files).collect()[0]
    assert (fr.fixed, fr.detected) == (2, 3)
    assert report.file_remediation_rate(files).collect()[0].remediated_files == 1
    lv = {r.level: r for r in report.level_success_rate(report.explode_attempts(entries)).collect()}
    assert (lv[1].attempts, lv[1].successes, lv[2].attempts, lv[2].successes) == (3, 2, 2, 1)
    tok = report.avg_tokens_per_fix(report.explode_attempts(entries)).collect()[0]
    assert tok.avg_tokens_per_fix == 200.0                       # (100 + 300 + 200) / 3
    assert report.cost_per_fix(files).collect()[0].cost_per_fix == 0.375
    ch = report.avg_churn(files).collect()[0]
    assert (ch.avg_loc_churn, ch.avg_ast_churn) == (1.0, 2.0)    # null churn skipped
    assert report.complexity_delta(files).collect()[0].avg_cc_delta == 0.5
    sev = {r.severity: r for r in report.severity_breakdown(report.explode_vulnerabilities(entries)).collect()}
    assert str(sev["HIGH"].fixed_pct) == "100.00" and str(sev["LOW"].fixed_pct) == "0.00"
    rules = report.success_by_test_id(report.explode_vulnerabilities(entries)).collect()
    assert [(r.test_id, r.total_cases, str(r.success_rate)) for r in rules] == [
        ("B1", 2, "100.0"), ("B3", 1, "100.0"), ("B2", 1, "0.0")]


def test_no_attempts_and_missing_columns(spark):
    empty = spark.createDataFrame([], AUDIT_LOG_DDL)
    lv = report.level_success_rate(report.explode_attempts(report.valid_entries(empty))).collect()
    assert [(r.level, r.attempts, r.success_rate_pct) for r in sorted(lv)] == [(1, 0, None), (2, 0, None)]
    assert report.cost_per_fix(empty).collect()[0].cost_per_fix == 0.0
    no_churn = log_df(spark).withColumn("security_summary", F.col("security_summary").dropFields(
        "normalized_loc_churn", "ast_churn"))
    r = report.avg_churn(report.valid_files(no_churn)).collect()[0]
    assert r.avg_loc_churn is None and r.avg_ast_churn is None


def test_half_even_rounding(spark):
    from patchmetrics.functions.money import half_even_ratio
    df = spark.createDataFrame([(1, 8), (3, 8), (1, 400), (3, 400), (0, 0)], "n long, d long")
    got = [str(r[0]) if r[0] is not None else None
           for r in df.select(half_even_ratio(F.col("n"), F.col("d"), 1)).collect()]
    assert got == ["12.5", "37.5", "0.2", "0.8", None]           # 0.25 -> 0.2, 0.75 -> 0.8


def test_round_trip_report(spark):
    from patchmetrics.plans import audit_pipeline as ap
    from tests.conftest import SF_SMALL
    log = ap.build_log(spark, SF_SMALL)
    path = os.path.join(tempfile.mkdtemp(prefix="pm-rt-"), "log")
    append_audit_log(log, path)
    back = read_audit_log(spark, path)
    a = sorted(tuple(r) for r in report.kpi_report(log).collect())
    b = sorted(tuple(r) for r in report.kpi_report(back).collect())
    assert a == b and len(a) > 10


def test_validation_splits_rejects(spark):
    from patchmetrics.schemas import reject_invalid_audit_rows
    bad = dict(LOG[0])
    bad = {**bad, "vulnerabilities": [{**LOG[0]["vulnerabilities"][0], "status": "MAYBE"}]}
    nouid = {**LOG[3], "meta": {**LOG[3]["meta"], "file_uid": None}}
    valid, rejected = reject_invalid_audit_rows(log_df(spark, [LOG[1], bad, nouid]))
    assert valid.count() == 1 and rejected.count() == 2


def test_long_form_report_equals_nested(spark):
    from patchmetrics.operators import audit
    from patchmetrics.plans import audit_pipeline as ap
    from tests.conftest import SF_SMALL
    from patchmetrics.sources import fixtures
    files, vulns, atts = audit.long_form_log(ap.priced_attempts(spark, SF_SMALL), fixtures.file_facts(spark, SF_SMALL))
    flat = sorted(tuple(r) for r in report.kpi_report_flat(files, vulns, atts, restrict_to_valid=True).collect())
    nested = sorted(tuple(r) for r in report.kpi_report(ap.build_log(spark, SF_SMALL)).collect())
    assert flat == nested
