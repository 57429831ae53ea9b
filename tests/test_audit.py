"""Audit-log decisions D1-D3, D7 and the nested record, on hand-written attempts."""

from decimal import Decimal

from pyspark.sql import functions as F

from patchmetrics.operators import audit
from patchmetrics.schemas import RAW_ATTEMPT_DDL

ROWS = [
    # file, vid, seq, level, model, status, finish_reason, p, c, total, time, sev, conf
    ("f1", "B101", 1, 1, "alibaba-qwen3-32b", "failed_level_1", "stop", 100, 50, 150, 1.5, "HIGH", "HIGH"),
    ("f1", "B101", 2, 2, "deepseek-r1-distill-llama-70b", "success", "stop", 200, 100, 300, 2.5, "LOW", "LOW"),
    ("f1", "B102", 3, 1, "alibaba-qwen3-32b", "success", "Syntax error near x", 10, 10, 20, 1.0, "MEDIUM", "HIGH"),
    ("f1", "B103", 4, 1, "alibaba-qwen3-32b", "error", "timeout", None, None, None, None, "LOW", "MEDIUM"),
    ("f2", "B200", 1, 1, "not-priced", "success", "stop", 1000, 1000, 2000, 0.5, "HIGH", "HIGH"),
    ("f2", "B201", 2, 1, "alibaba-qwen3-32b", "failed_level_1", "stop", 2, 0, 2, 0.0, "LOW", "LOW"),
    ("f3", None, 1, None, None, None, None, None, None, None, None, None, None),
]


def priced(spark):
    raw = spark.createDataFrame(ROWS, RAW_ATTEMPT_DDL)
    return audit.price_attempts(audit.normalize_attempts(raw), audit.pricing_table(spark))


def test_normalisation_defaults_and_syntax_override(spark):
    rows = {(r.file_uid, r.attempt_seq): r for r in audit.normalize_attempts(
        spark.createDataFrame(ROWS, RAW_ATTEMPT_DDL)).collect()}
    assert rows[("f1", 3)].status == "SYNTAX_ERROR"          # D3: overrides a success
    assert rows[("f1", 4)].status == "FAILED"                # error -> FAILED
    f3 = rows[("f3", 1)]
    assert (f3.vulnerability_id, f3.level, f3.model, f3.pricing_model, f3.status) == ("UNKNOWN", 1, "unknown", "", "FAILED")
    assert (f3.prompt_tokens, f3.total_tokens, f3.severity) == (0, 0, "UNKNOWN")


def test_costs_are_exact_decimals(spark):
    rows = {(r.file_uid, r.attempt_seq): r.cost_usd for r in priced(spark).collect()}
    assert rows[("f1", 1)] == Decimal("0.000053")            # 100*0.25 + 50*0.55 = 52.5 -> half up
    assert rows[("f1", 2)] == Decimal("0.000297")
    assert rows[("f2", 1)] == Decimal("0.000000")            # unknown model costs nothing
    assert rows[("f2", 2)] == Decimal("0.000001")            # D7 tie: 2 tokens x 0.25 = 5e-7 -> 1e-6


def test_traces(spark):
    t = {(r.file_uid, r.vulnerability_id): r for r in audit.vuln_traces(priced(spark)).collect()}
    b101 = t[("f1", "B101")]
    assert (b101.status, b101.fixed_at_level, b101.severity, b101.confidence_score) == ("FIXED", 2, "HIGH", "HIGH")
    assert b101.total_cost_usd == Decimal("0.000350") and b101.time_to_remediation_s == 4.0
    assert t[("f1", "B102")].status == "FAILED" and not t[("f1", "B102")].is_leftover   # syntax but raw success
    assert t[("f1", "B103")].is_errored and not t[("f1", "B103")].is_leftover           # D2
    assert t[("f2", "B201")].is_leftover


def test_file_summary_and_nested_log(spark):
    facts = spark.createDataFrame(
        [("f1", 10, 12, 1.5, 2.0, 3, 4, 2), ("f2", 5, 5, 1.0, 1.0, None, 0, 0), ("f9", 1, 1, 1.0, 1.0, 0, 0, 0)],
        "file_uid string, loc_before int, loc_after int, cc_before double, cc_after double, "
        "normalized_loc_churn int, ast_churn int, vuln_count_after int")
    s = {r.file_uid: r for r in audit.file_summary(audit.vuln_traces(priced(spark)), facts).collect()}
    # f1: B101 fixed; B102 syntax (not leftover), B103 errored -> vuln_count 1
    assert (s["f1"].vuln_count, s["f1"].fixed_count, s["f1"].errored_count) == (1, 1, 1)
    assert s["f1"].new_issues_introduced == 2
    assert (s["f2"].vuln_count, s["f2"].leftover_count) == (2, 1)
    assert (s["f9"].vuln_count, s["f9"].total_cost_usd) == (0, Decimal("0.000000"))
    log = audit.build_audit_log(priced(spark), facts, dataset="d", timestamp=F.lit("t"))
    rec = {r.meta.file_uid: r for r in log.collect()}
    v = rec["f1"].vulnerabilities
    assert [x.test_id for x in v] == ["B101", "B102", "B103"]          # order of first appearance
    assert [a.level for a in v[0].attempts] == [1, 2]                   # attempt order
    assert rec["f1"].input_stats.vuln_count == 1 and rec["f9"].vulnerabilities == []
    assert rec["f1"].total_cost_usd == Decimal("0.000358")
