"""DuckDB SQL oracles for the keyed queries (the driver runs them on the same parquet tables).

Each entry is plain SQL over the pre-registered views (``lineitem``, ``orders``, ``documents``, ``pages``,
``conversations``, ``events``). Fixture derivations are repeated as CTEs so every oracle is self-contained.
"""

from __future__ import annotations

from .operators.audit import PRICING_PER_1M

# ----------------------------------------------------------------------------------------------- CTE blocks
ATTEMPTS = r"""
keyed AS (
  SELECT l_orderkey AS file_uid,
         CONCAT('B', CAST(100 + (l_orderkey * 7 + l_partkey % 3) % 20 AS VARCHAR)) AS vulnerability_id,
         l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax, l_returnflag, l_linestatus
  FROM lineitem),
seqd AS (
  SELECT keyed.*,
    row_number() OVER (PARTITION BY file_uid ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS attempt_seq,
    row_number() OVER (PARTITION BY file_uid, vulnerability_id
                       ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS vuln_seq
  FROM keyed),
attempts AS (
  SELECT file_uid, vulnerability_id, CAST(attempt_seq AS BIGINT) AS attempt_seq,
    CASE WHEN vuln_seq = 1 THEN 1 ELSE 2 END AS level_attempted,
    CASE WHEN l_suppkey % 10 = 0 THEN 'unlisted-model' WHEN vuln_seq = 1 THEN 'alibaba-qwen3-32b'
         ELSE 'deepseek-r1-distill-llama-70b' END AS model,
    CASE WHEN l_quantity = 50 THEN 'error' WHEN l_linestatus = 'F' THEN 'success'
         WHEN vuln_seq = 1 THEN 'failed_level_1' ELSE 'failed_level_2' END AS status,
    CASE WHEN l_tax = 0.08 THEN 'Syntax error in reply' WHEN l_quantity = 50 THEN 'timeout' ELSE 'stop' END AS finish_reason,
    CASE WHEN l_quantity = 50 THEN NULL ELSE CAST(floor(l_quantity * 40) AS BIGINT) + l_partkey % 97 END AS prompt_tokens,
    CASE WHEN l_quantity = 50 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) % 3000 END AS completion_tokens,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS llm_time_taken,
    CASE l_returnflag WHEN 'A' THEN 'HIGH' WHEN 'N' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    CASE WHEN l_partkey % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
  FROM seqd),
norm AS (
  SELECT file_uid, coalesce(vulnerability_id, 'UNKNOWN') AS vulnerability_id, attempt_seq,
    CAST(coalesce(level_attempted, 1) AS INTEGER) AS level, coalesce(model, 'unknown') AS model,
    coalesce(model, '') AS pricing_model, status AS raw_status,
    CASE WHEN contains(lower(coalesce(finish_reason, '')), 'syntax') THEN 'SYNTAX_ERROR'
         WHEN upper(coalesce(status, 'failed')) = 'SUCCESS' THEN 'SUCCESS' ELSE 'FAILED' END AS status,
    finish_reason, coalesce(llm_time_taken, 0) AS duration_s,
    CAST(coalesce(prompt_tokens, 0) AS BIGINT) AS prompt_tokens,
    CAST(coalesce(completion_tokens, 0) AS BIGINT) AS completion_tokens,
    CAST(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) AS BIGINT) AS total_tokens,
    coalesce(severity, 'UNKNOWN') AS severity, coalesce(confidence, 'UNKNOWN') AS confidence
  FROM attempts),
pricing AS (
  SELECT * FROM (VALUES ('alibaba-qwen3-32b', CAST(0.250 AS DECIMAL(9,3)), CAST(0.550 AS DECIMAL(9,3))),
    ('deepseek-r1-distill-llama-70b', CAST(0.990 AS DECIMAL(9,3)), CAST(0.990 AS DECIMAL(9,3)))) AS t(model, input, output)),
priced AS (
  SELECT n.*, CAST(round(CAST((n.prompt_tokens * coalesce(p.input, 0) + n.completion_tokens * coalesce(p.output, 0))
           AS DECIMAL(24,3)) * CAST(0.000001 AS DECIMAL(7,6)), 6) AS DECIMAL(18,6)) AS cost_usd
  FROM norm n LEFT JOIN pricing p ON p.model = n.pricing_model),
traces AS (
  SELECT file_uid, vulnerability_id,
    arg_min(severity, attempt_seq) AS severity, arg_min(confidence, attempt_seq) AS confidence_score,
    CASE WHEN bool_or(status = 'SUCCESS') THEN 'FIXED' ELSE 'FAILED' END AS status,
    arg_max(level, attempt_seq) FILTER (WHERE status = 'SUCCESS') AS fixed_at_level,
    CAST(sum(duration_s) AS DOUBLE) AS time_to_remediation_s,
    CAST(sum(cost_usd) AS DECIMAL(18,6)) AS total_cost_usd,
    min(attempt_seq) AS first_seq, count(*) AS n_attempts,
    arg_max(raw_status, attempt_seq) AS last_raw_status,
    CAST(CASE WHEN max(level) >= 2 THEN count_if(starts_with(raw_status, 'failed') AND level >= 2)
              ELSE count_if(starts_with(raw_status, 'failed')) END AS BIGINT) AS n_leftover
  FROM priced GROUP BY file_uid, vulnerability_id),
traces2 AS (
  SELECT *, (status = 'FAILED' AND coalesce(starts_with(last_raw_status, 'failed'), false)) AS is_leftover,
            (status = 'FAILED' AND coalesce(last_raw_status = 'error', false)) AS is_errored
  FROM traces),
facts AS (
  SELECT o_orderkey AS file_uid, o_orderpriority AS dataset, 20 + o_custkey % 300 AS loc_before,
    20 + (o_custkey + o_orderkey) % 300 AS loc_after,
    CAST(CAST(10 + o_custkey % 90 AS DOUBLE) / 10 AS DECIMAL(6,2)) AS cc_before,
    CAST(CAST(10 + o_orderkey % 90 AS DOUBLE) / 10 AS DECIMAL(6,2)) AS cc_after,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 40 END AS normalized_loc_churn,
    o_orderkey % 120 AS ast_churn, o_orderkey % 4 AS vuln_count_after
  FROM orders),
roll AS (
  SELECT file_uid, CAST(sum(total_cost_usd) AS DECIMAL(18,6)) AS total_cost_usd,
    count_if(status = 'FIXED') AS fixed_count, CAST(sum(n_leftover) AS BIGINT) AS leftover_count,
    count_if(is_errored) AS errored_count, count(*) AS n_traces
  FROM traces2 GROUP BY file_uid),
logf AS (
  SELECT CAST(f.file_uid AS VARCHAR) AS file_uid, f.dataset, f.loc_before, f.loc_after,
    CAST(f.cc_before AS DOUBLE) AS cc_before, CAST(f.cc_after AS DOUBLE) AS cc_after,
    CAST(f.normalized_loc_churn AS BIGINT) AS normalized_loc_churn, CAST(f.ast_churn AS BIGINT) AS ast_churn,
    CAST(f.vuln_count_after AS BIGINT) AS vuln_count_after,
    CAST(coalesce(r.fixed_count, 0) + coalesce(r.leftover_count, 0) AS BIGINT) AS vuln_count,
    CAST(coalesce(r.fixed_count, 0) AS BIGINT) AS fixed_count,
    CAST(f.vuln_count_after - coalesce(r.leftover_count, 0) AS BIGINT) AS new_issues_introduced,
    coalesce(r.total_cost_usd, CAST(0 AS DECIMAL(18,6))) AS total_cost_usd,
    CAST(coalesce(r.n_traces, 0) AS BIGINT) AS n_traces
  FROM facts f LEFT JOIN roll r ON r.file_uid = f.file_uid),
valid AS (SELECT * FROM logf WHERE vuln_count > 0),
vvulns AS (
  SELECT CAST(t.file_uid AS VARCHAR) AS file_uid, t.vulnerability_id AS test_id, t.severity, t.status
  FROM traces2 t WHERE CAST(t.file_uid AS VARCHAR) IN (SELECT file_uid FROM valid)),
vatts AS (
  SELECT CAST(p.file_uid AS VARCHAR) AS file_uid, p.vulnerability_id AS test_id, p.level, p.status, p.total_tokens
  FROM priced p WHERE CAST(p.file_uid AS VARCHAR) IN (SELECT file_uid FROM valid))
"""


def with_(blocks: str, body: str) -> str:
    return "WITH " + blocks.strip() + "\n" + body.strip()


def pct(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0) * 100.0"


def half_even(num: str, den: str, digits: int, percent: bool = True) -> str:
    """Integer half-even rounding of (100*)num/den to `digits` places, as DECIMAL(18,digits)."""
    scale = 10 ** (digits + (2 if percent else 0))
    t = f"(CAST({num} AS BIGINT) * {scale})"
    d = f"NULLIF(CAST({den} AS BIGINT), 0)"
    q = f"({t} // {d})"
    r = f"({t} % {d})"
    bump = f"(CASE WHEN 2 * {r} > {d} THEN 1 WHEN 2 * {r} = {d} AND {q} % 2 = 1 THEN 1 ELSE 0 END)"
    return f"CAST(CAST({q} + {bump} AS DECIMAL(18,0)) / {10 ** digits} AS DECIMAL(18,{digits}))"


AUDIT_SQL = {
    "attempt_normalize": "SELECT * FROM norm",
    "attempt_cost": """SELECT file_uid, vulnerability_id, attempt_seq, model, pricing_model, prompt_tokens,
        completion_tokens, cost_usd FROM priced""",
    "audit_log_parts": """SELECT CAST(o.o_orderkey AS VARCHAR) AS file_uid, coalesce(p.part, 0)::INTEGER AS part,
          coalesce(ceil(max(n) OVER (PARTITION BY o.o_orderkey) / 3), 1)::INTEGER AS n_parts,
          coalesce(max((p.lo > p.first_seq)::INT) OVER (PARTITION BY o.o_orderkey, p.part) = 1, false) AS continues,
          f.vuln_count, (CASE WHEN p.test_id IS NOT NULL THEN row_number() OVER (PARTITION BY o.o_orderkey, p.part ORDER BY p.first_seq) - 1 END)::INTEGER
            AS trace_pos, p.test_id, t.status AS trace_status, p.n_attempts, p.total_tokens
        FROM orders o LEFT JOIN (
          SELECT file_uid, (place - 1) // 3 AS part, vulnerability_id AS test_id, first_seq, min(attempt_seq) AS lo,
            count(*)::INTEGER AS n_attempts, sum(total_tokens)::BIGINT AS total_tokens, any_value(n) AS n
          FROM (SELECT *, row_number() OVER (PARTITION BY file_uid ORDER BY first_seq, attempt_seq) AS place, count(*) OVER (PARTITION BY file_uid) AS n
                FROM (SELECT *, min(attempt_seq) OVER (PARTITION BY file_uid, vulnerability_id) AS first_seq FROM priced))
          GROUP BY ALL) p ON p.file_uid = o.o_orderkey
        LEFT JOIN traces t ON t.file_uid = o.o_orderkey AND t.vulnerability_id = p.test_id
        JOIN logf f ON f.file_uid = CAST(o.o_orderkey AS VARCHAR)""",
    "attempt_cost_by_model": f"""SELECT m.model, count(*)::BIGINT AS attempts, sum(n.prompt_tokens)::BIGINT AS prompt_tokens,
        sum(n.completion_tokens)::BIGINT AS completion_tokens, sum(CAST(round(CAST((n.prompt_tokens * m.input + n.completion_tokens * m.output)
          AS DECIMAL(24,3)) * CAST(0.000001 AS DECIMAL(7,6)), 6) AS DECIMAL(18,6)))::DECIMAL(18,6) AS cost_usd
        FROM norm n JOIN (VALUES {", ".join(f"({i}, '{m}', CAST({a} AS DECIMAL(9,3)), CAST({b} AS DECIMAL(9,3)))"
                                            for i, (m, a, b) in enumerate([*PRICING_PER_1M, ("unlisted-model", "0", "0")]))}) AS m(i, model, input, output)
          ON m.i = (n.prompt_tokens + n.attempt_seq) % {len(PRICING_PER_1M) + 1}
        GROUP BY m.model""",
    "attempt_sequence": """SELECT file_uid, vulnerability_id, level, attempt_seq,
        CAST(row_number() OVER (PARTITION BY file_uid ORDER BY level, attempt_seq) AS BIGINT) AS seq FROM norm""",
    "attempt_union_levels": """SELECT file_uid, vulnerability_id, attempt_seq, level, model, status, cost_usd
        FROM priced WHERE level = 1 UNION ALL
        SELECT file_uid, vulnerability_id, attempt_seq, level, model, status, cost_usd FROM priced WHERE level = 2""",
    "vuln_trace": "SELECT * FROM traces2",
    "vuln_trace_history": """SELECT file_uid, vulnerability_id,
        min(attempt_seq) OVER (PARTITION BY file_uid, vulnerability_id) AS first_seq,
        CAST(row_number() OVER (PARTITION BY file_uid, vulnerability_id ORDER BY attempt_seq) - 1 AS INTEGER) AS pos,
        level, model, status, finish_reason, CAST(duration_s AS DOUBLE) AS duration_s, cost_usd, prompt_tokens,
        completion_tokens, total_tokens FROM priced""",
    "audit_log_nested": """SELECT l.file_uid, l.dataset, l.vuln_count, l.fixed_count, l.new_issues_introduced,
        l.total_cost_usd AS file_cost_usd, t.trace_pos, t.vulnerability_id AS test_id, t.severity, t.confidence_score,
        t.status AS trace_status, t.fixed_at_level, t.time_to_remediation_s, t.total_cost_usd AS trace_cost_usd, p.pos,
        p.level, p.model, p.status, p.finish_reason, CAST(p.duration_s AS DOUBLE) AS duration_s, p.cost_usd,
        p.prompt_tokens, p.completion_tokens, p.total_tokens
        FROM logf l LEFT JOIN (SELECT *, CAST(row_number() OVER (PARTITION BY file_uid ORDER BY first_seq) - 1 AS INTEGER)
            AS trace_pos FROM traces2) t ON CAST(t.file_uid AS VARCHAR) = l.file_uid
        LEFT JOIN (SELECT *, CAST(row_number() OVER (PARTITION BY file_uid, vulnerability_id ORDER BY attempt_seq) - 1
            AS INTEGER) AS pos FROM priced) p ON p.file_uid = t.file_uid AND p.vulnerability_id = t.vulnerability_id""",
    "escalation_routing": """SELECT file_uid, vulnerability_id, attempt_seq, severity, confidence, 2 AS next_level
        FROM norm WHERE level = 1 AND starts_with(raw_status, 'failed')""",
    "file_summary": """SELECT CAST(file_uid AS BIGINT) AS file_uid, vuln_count, fixed_count,
        CAST(vuln_count - fixed_count AS BIGINT) AS leftover_count,
        CAST(coalesce((SELECT errored_count FROM roll r WHERE CAST(r.file_uid AS VARCHAR) = logf.file_uid), 0) AS BIGINT)
          AS errored_count,
        new_issues_introduced, total_cost_usd, n_traces FROM logf""",
    "audit_flatten": """SELECT file_uid AS "meta.file_uid", dataset AS "meta.dataset",
        'v1.0.0' AS "meta.implementation_version", '1970-01-01T00:00:00' AS "meta.timestamp",
        CAST(0.0 AS DOUBLE) AS "meta.total_pipeline_duration_s", CAST(loc_before AS BIGINT) AS "input_stats.loc",
        cc_before AS "input_stats.avg_cyclomatic_complexity", vuln_count AS "input_stats.vuln_count",
        'python' AS language, fixed_count AS "security_summary.fixed_count",
        new_issues_introduced AS "security_summary.new_issues_introduced",
        CAST(loc_after AS BIGINT) AS "security_summary.final_code_stats.loc",
        cc_after AS "security_summary.final_code_stats.avg_cyclomatic_complexity",
        vuln_count_after AS "security_summary.final_code_stats.vuln_count",
        normalized_loc_churn AS "security_summary.normalized_loc_churn", ast_churn AS "security_summary.ast_churn",
        total_cost_usd FROM logf""",
    "audit_dataset_counts": """SELECT count(*) AS loaded, CAST(count_if(vuln_count > 0) AS BIGINT) AS analyzed,
        CAST(count(*) - count_if(vuln_count > 0) AS BIGINT) AS excluded FROM logf""",
    "valid_file_semi_join": """SELECT file_uid, vuln_count, fixed_count, n_traces FROM logf
        WHERE file_uid IN (SELECT DISTINCT file_uid FROM valid)""",
    "explode_vulnerabilities": "SELECT * FROM vvulns",
    "explode_attempts": "SELECT * FROM vatts",
    "vuln_fix_rate": f"""SELECT CAST(sum(fixed_count) AS BIGINT) AS fixed, CAST(sum(vuln_count) AS BIGINT) AS detected,
        {pct('sum(fixed_count)', 'sum(vuln_count)')} AS fix_rate_pct FROM valid""",
    "file_remediation_rate": f"""SELECT CAST(count_if(vuln_count = fixed_count) AS BIGINT) AS remediated_files,
        count(*) AS files,
        {pct('count_if(vuln_count = fixed_count)', 'count(*)')} AS remediation_rate_pct FROM valid""",
    "level_success_rate": f"""SELECT l.level, CAST(coalesce(a.attempts, 0) AS BIGINT) AS attempts,
        CAST(coalesce(a.successes, 0) AS BIGINT) AS successes,
        {pct('coalesce(a.successes, 0)', 'coalesce(a.attempts, 0)')} AS success_rate_pct
        FROM (VALUES (1), (2)) AS l(level)
        LEFT JOIN (SELECT level, count(*) AS attempts, count_if(status = 'SUCCESS') AS successes FROM vatts GROUP BY level) a
        ON a.level = l.level""",
    "avg_tokens_per_fix": """SELECT CAST(sum(total_tokens) FILTER (WHERE status = 'SUCCESS') AS BIGINT) AS success_tokens,
        CAST(count_if(status = 'SUCCESS') AS BIGINT) AS successes,
        CAST(sum(total_tokens) FILTER (WHERE status = 'SUCCESS') AS DOUBLE)
          / NULLIF(CAST(count_if(status = 'SUCCESS') AS DOUBLE), 0) AS avg_tokens_per_fix FROM vatts""",
    "cost_per_fix": """SELECT CAST(sum(total_cost_usd) AS DECIMAL(18,6)) AS total_cost_usd,
        CAST(sum(fixed_count) AS BIGINT) AS fixed,
        coalesce(CAST(CAST(sum(total_cost_usd) AS DECIMAL(18,6)) AS DOUBLE) / NULLIF(CAST(sum(fixed_count) AS DOUBLE), 0), 0.0)
          AS cost_per_fix FROM valid""",
    "avg_churn": """SELECT CAST(sum(normalized_loc_churn) AS BIGINT) AS loc_churn_sum, count(normalized_loc_churn) AS loc_churn_n,
        CAST(sum(ast_churn) AS BIGINT) AS ast_churn_sum, count(ast_churn) AS ast_churn_n,
        CAST(sum(normalized_loc_churn) AS DOUBLE) / NULLIF(CAST(count(normalized_loc_churn) AS DOUBLE), 0) AS avg_loc_churn,
        CAST(sum(ast_churn) AS DOUBLE) / NULLIF(CAST(count(ast_churn) AS DOUBLE), 0) AS avg_ast_churn FROM valid""",
    "before_after_delta": """SELECT CAST(sum(CAST(cc_after AS DECIMAL(18,2)) - CAST(cc_before AS DECIMAL(18,2))) AS DECIMAL(18,2))
          AS cc_delta_sum, count(CAST(cc_after AS DECIMAL(18,2)) - CAST(cc_before AS DECIMAL(18,2))) AS cc_delta_n,
        CAST(sum(CAST(cc_after AS DECIMAL(18,2)) - CAST(cc_before AS DECIMAL(18,2))) AS DOUBLE)
          / NULLIF(CAST(count(CAST(cc_after AS DECIMAL(18,2)) - CAST(cc_before AS DECIMAL(18,2))) AS DOUBLE), 0)
          AS avg_cc_delta FROM valid""",
    "severity_breakdown": f"""SELECT severity, count(*) AS total, CAST(count_if(status = 'FIXED') AS BIGINT) AS fixed,
        CAST(count_if(status = 'FAILED') AS BIGINT) AS failed,
        {half_even("count_if(status = 'FIXED')", 'count(*)', 2)} AS fixed_pct,
        {half_even("count_if(status = 'FAILED')", 'count(*)', 2)} AS failed_pct
        FROM vvulns GROUP BY severity""",
    "success_by_test_id": f"""SELECT test_id, count(*) AS total_cases, CAST(count_if(status = 'FIXED') AS BIGINT) AS fixed,
        {half_even("count_if(status = 'FIXED')", 'count(*)', 1)} AS success_rate
        FROM vvulns GROUP BY test_id ORDER BY total_cases DESC, success_rate DESC, test_id""",
}


def _kpi_sql() -> str:
    d38 = "DECIMAL(38,6)"
    row = lambda s, m, k, n, d, v: (f"SELECT '{s}' AS section, '{m}' AS metric, CAST({k} AS VARCHAR) AS key, "  # noqa: E731
                                    f"CAST({n} AS {d38}) AS numerator, CAST({d} AS {d38}) AS denominator, "
                                    f"CAST({v} AS DOUBLE) AS value")
    parts = [
        row("dataset", "loaded", "NULL", "(SELECT count(*) FROM logf)", "NULL", "(SELECT count(*) FROM logf)"),
        row("dataset", "analyzed", "NULL", "(SELECT count(*) FROM valid)", "NULL", "(SELECT count(*) FROM valid)"),
        row("dataset", "excluded", "NULL", "(SELECT count(*) FROM logf) - (SELECT count(*) FROM valid)", "NULL",
            "(SELECT count(*) FROM logf) - (SELECT count(*) FROM valid)"),
        row("effectiveness", "vuln_fix_rate", "NULL", "sum(fixed_count)", "sum(vuln_count)",
            pct("sum(fixed_count)", "sum(vuln_count)")) + " FROM valid",
        row("effectiveness", "file_remediation_rate", "NULL", "count_if(vuln_count = fixed_count)", "count(*)",
            pct("count_if(vuln_count = fixed_count)", "count(*)")) + " FROM valid",
        row("cost", "cost_per_fix", "NULL", "CAST(sum(total_cost_usd) AS DECIMAL(18,6))", "sum(fixed_count)",
            "coalesce(CAST(CAST(sum(total_cost_usd) AS DECIMAL(18,6)) AS DOUBLE) / NULLIF(CAST(sum(fixed_count) AS DOUBLE), 0), 0.0)")
        + " FROM valid",
        row("quality", "avg_loc_churn", "NULL", "sum(normalized_loc_churn)", "count(normalized_loc_churn)",
            "CAST(sum(normalized_loc_churn) AS DOUBLE) / NULLIF(CAST(count(normalized_loc_churn) AS DOUBLE), 0)") + " FROM valid",
        row("quality", "avg_ast_churn", "NULL", "sum(ast_churn)", "count(ast_churn)",
            "CAST(sum(ast_churn) AS DOUBLE) / NULLIF(CAST(count(ast_churn) AS DOUBLE), 0)") + " FROM valid",
        row("quality", "avg_complexity_change", "NULL",
            "CAST(sum(CAST(cc_after AS DECIMAL(18,2)) - CAST(cc_before AS DECIMAL(18,2))) AS DECIMAL(18,2))",
            "count(CAST(cc_after AS DECIMAL(18,2)) - CAST(cc_before AS DECIMAL(18,2)))",
            "CAST(sum(CAST(cc_after AS DECIMAL(18,2)) - CAST(cc_before AS DECIMAL(18,2))) AS DOUBLE) / "
            "NULLIF(CAST(count(CAST(cc_after AS DECIMAL(18,2)) - CAST(cc_before AS DECIMAL(18,2))) AS DOUBLE), 0)") + " FROM valid",
        row("tiers", "level_success_rate", "level", "successes", "attempts", "success_rate_pct")
        + " FROM (" + AUDIT_SQL["level_success_rate"] + ")",
        row("cost", "avg_tokens_per_fix", "NULL", "success_tokens", "successes", "avg_tokens_per_fix")
        + " FROM (" + AUDIT_SQL["avg_tokens_per_fix"] + ")",
        row("severity", "fixed_share_pct", "severity", "count_if(status = 'FIXED')", "count(*)",
            half_even("count_if(status = 'FIXED')", "count(*)", 2)) + " FROM vvulns GROUP BY severity",
        row("rule", "success_rate_pct", "test_id", "count_if(status = 'FIXED')", "count(*)",
            half_even("count_if(status = 'FIXED')", "count(*)", 1)) + " FROM vvulns GROUP BY test_id",
    ]
    return "\nUNION ALL\n".join(parts)


AUDIT_SQL["kpi_report"] = AUDIT_SQL["incremental_report"] = _kpi_sql()


def _rendered_sql() -> str:
    from .operators.report import NO_ATTEMPTS, NOT_AVAILABLE, REPORT_FORMATS, REPORT_LABELS
    lb = {k: "'" + v + "'" for k, v in REPORT_LABELS.items()}
    f = lambda k, alt=None: (f"coalesce(printf('{REPORT_FORMATS[k]}', value), '{alt}')" if alt
                             else f"printf('{REPORT_FORMATS[k]}', value)")
    n, d = "CAST(CAST(numerator AS BIGINT) AS VARCHAR)", "CAST(CAST(denominator AS BIGINT) AS VARCHAR)"
    level = "replace(" + lb["level_success_rate"] + ", '{}', key)"
    return f"""SELECT section, metric, key, CASE
        WHEN section = 'dataset' THEN metric || ': ' || {n}
        WHEN metric = 'vuln_fix_rate' THEN {lb['vuln_fix_rate']} || {f('pct')} || ' (' || {n} || '/' || {d} || ')'
        WHEN metric = 'file_remediation_rate' THEN {lb['file_remediation_rate']} || {f('pct')} || ' (' || {n} || '/' || {d} || ' files clean)'
        WHEN metric = 'level_success_rate' AND denominator = 0 THEN {level} || '{NO_ATTEMPTS}'
        WHEN metric = 'level_success_rate' THEN {level} || {f('pct')} || ' (' || {n} || '/' || {d} || ')'
        WHEN metric = 'avg_tokens_per_fix' THEN {lb['avg_tokens_per_fix']} || {f('tokens', 'nan')}
        WHEN metric = 'cost_per_fix' THEN {lb['cost_per_fix']} || {f('cost')}
        WHEN metric = 'avg_loc_churn' THEN {lb['avg_loc_churn']} || {f('loc_churn', NOT_AVAILABLE)}
        WHEN metric = 'avg_ast_churn' THEN {lb['avg_ast_churn']} || {f('ast_churn', NOT_AVAILABLE)}
        WHEN metric = 'avg_complexity_change' THEN {lb['avg_complexity_change']} || {f('delta', 'nan')}
        WHEN section = 'severity' THEN rpad(key, 10, ' ') || {f('pct')}
        WHEN section = 'rule' THEN rpad(key, 20, ' ') || ' | ' || {f('rule_rate')} || '   | ' || rpad({d}, 5, ' ')
        END AS line FROM ({AUDIT_SQL["kpi_report"]})"""


AUDIT_SQL["kpi_rendered"] = _rendered_sql()


# ----------------------------------------------------------------------------------------------- documents, pages
NL = "chr(10)"
RAW_SAMPLES = r"""
raw AS (
  SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN '```python' || chr(10) || '   ' || chr(10) || '```'
    WHEN doc_id % 3 = 0 THEN '```python' || chr(10) || text || chr(10) || '```'
    WHEN doc_id % 3 = 1 THEN '```' || chr(10) || text || chr(10) || '```  '
    ELSE text END AS chosen
  FROM documents)
"""
CLEAN = r"regexp_replace(regexp_replace(regexp_replace(chosen, '^\s+|\s+$', '', 'g'), '^```(?:python)?\s*', ''), '\s*```$', '')"
LINES = r"""
doc_lines AS (
  SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM documents),
edited AS (
  SELECT doc_id, line_no, CASE WHEN line_no % 5 = 2 THEN upper(line) ELSE line END AS line
  FROM doc_lines WHERE line_no % 7 <> 3),
rules AS (
  SELECT * FROM (VALUES ('R001', 'HIGH', 'token = "[0-9a-f]{40}"'), ('R002', 'LOW', 'License'),
                        ('R003', 'MEDIUM', '[a-z0-9.]+@[a-z]+')) AS t(test_id, severity, pattern)),
fb AS (SELECT l.doc_id, l.line_no, r.test_id, r.severity FROM doc_lines l JOIN rules r ON regexp_matches(l.line, r.pattern)),
fa AS (SELECT l.doc_id, l.line_no, r.test_id, r.severity FROM edited l JOIN rules r ON regexp_matches(l.line, r.pattern)),
spans AS (
  SELECT doc_id, line_no AS start_line, line_no + 9 AS end_line FROM doc_lines WHERE line_no % 10 = 1
  UNION ALL SELECT doc_id, line_no, line_no + 2 FROM doc_lines WHERE line_no % 10 = 4),
kparts AS (
  SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no,
         unnest(string_split(text, chr(10))) AS part, len(string_split(text, chr(10))) AS n FROM documents),
klines AS (
  SELECT doc_id, line_no, CASE WHEN line_no < n THEN part || chr(10) ELSE part END AS line
  FROM kparts WHERE NOT (line_no = n AND part = ''))
"""
REPORTS = r"""
reports AS (
  SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'not json' WHEN doc_id % 50 = 1 THEN '{"errors":[]}'
   ELSE concat('{"results":[{"test_id":"B', CAST(100 + doc_id % 20 AS VARCHAR), '","issue_severity":"HIGH","line_range":[',
     CAST(1 + doc_id % 9 AS VARCHAR), ',', CAST(3 + doc_id % 9 AS VARCHAR),
     '],"more_info":"https://b.example/en/1.9.2/x.html"},{"test_id":"B', CAST(100 + doc_id % 7 AS VARCHAR),
     '","issue_severity":"LOW","line_range":[2]}]}') END AS report FROM documents),
arrs AS (SELECT doc_id, CAST(json_extract(CASE WHEN json_valid(report) THEN report END, '$.results') AS JSON[]) AS arr
         FROM reports),
ex AS (SELECT doc_id, CAST(generate_subscripts(arr, 1) AS INTEGER) AS finding_idx, unnest(arr) AS r FROM arrs)
"""
DOC_REWRITE = r"regexp_replace({u}, '/en/[0-9]+(\.[0-9]+)*', '/en/latest', 'g')"
H1 = r"array_to_string(regexp_extract_all(html, '<h1[^>]*>([^<]*)</h1>', 1), chr(10))"
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
REPLY_UNFENCE = "replace(replace({x}, '```python', ''), '```', '')"


def _template_sql(code: str, strategy: str) -> str:
    from .operators.cascade import DEFAULT_PATCH_TEMPLATE
    import string
    parts = []
    for literal, name, _s, _c in string.Formatter().parse(DEFAULT_PATCH_TEMPLATE):
        if literal:
            parts.append("'" + literal.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        if name is not None:
            parts.append(f"coalesce({code if name == 'code_snippet' else strategy}, '')")
    return " || ".join(parts)


SPANS = LINES.strip() + r""",
        src AS (SELECT doc_id, line_no, (line_no * 7 + doc_id) % 17 AS k, length(line) AS n FROM doc_lines),
        code AS (SELECT doc_id, line_no, CASE k WHEN 0 THEN '@mark' || line_no WHEN 1 THEN 'def f' || line_no || '(a):'
              WHEN 5 THEN '    def g' || line_no || '(b):' WHEN 11 THEN 'x' || line_no || ' = 1' WHEN 12 THEN '    async def h' || line_no || '(c):'
              WHEN 14 THEN 'class C' || line_no || ':' ELSE repeat(' ', (4 * (1 + k % 3))::INT) || 'v' || line_no || ' = ' || n END AS line
            FROM src WHERE k NOT IN (8, 9)),
        c AS (SELECT *, length(line) - length(ltrim(line, ' ')) AS i, line LIKE '@%' AS deco,
                lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev,
                max(CASE WHEN line NOT LIKE '@%' THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS plain,
                max(line_no) OVER (PARTITION BY doc_id) AS last_line FROM code),
        d AS (SELECT *, regexp_extract(line, '^ *(async )?def (\w+)\(', 2) AS name FROM c WHERE regexp_matches(line, '^ *(async )?def ')),
        nx AS (SELECT d.doc_id, d.line_no, min(c.line_no) AS nxt FROM d JOIN c ON c.doc_id = d.doc_id AND c.line_no > d.line_no AND c.i <= d.i
               GROUP BY ALL),
        sp AS (SELECT d.doc_id, CASE WHEN d.line LIKE '%async %' THEN 'async function' ELSE 'function' END AS kind, d.name,
            coalesce((SELECT min(x.line_no) FROM c x WHERE x.doc_id = d.doc_id AND x.deco AND x.line_no < d.line_no AND x.line_no > coalesce(d.plain, 0)),
                     d.line_no)::INTEGER AS start_line,
            coalesce((SELECT x.prev FROM c x WHERE x.doc_id = d.doc_id AND x.line_no = nx.nxt), d.last_line)::INTEGER AS end_line,
            d.line_no AS def_line FROM d LEFT JOIN nx ON nx.doc_id = d.doc_id AND nx.line_no = d.line_no)"""


def _plan_sql() -> str:
    """The plan prompt of ``code``, ``test_id`` and ``scraped`` columns."""
    import string
    from .operators.cascade import DEFAULT_PLAN_TEMPLATE
    fields = {"code_snippet": "coalesce(code, '')", "issue": "test_id", "documentation": "scraped"}
    parts = []
    for literal, name, _spec, _conv in string.Formatter().parse(DEFAULT_PLAN_TEMPLATE):
        parts.append("'" + literal.replace("'", "''") + "'")
        if name:
            parts.append(fields[name])
    return " || ".join(parts)


def _cascade_sql() -> str:
    """Two levels over one-line contexts: reply per finding, last reply of a line wins, verify per document and rule."""
    mask = "regexp_replace(s.line, '[a-z0-9.]+@[a-z]+', '[email]', 'g')"
    answer = {1: f"CASE WHEN s.test_id = 'R003' THEN {mask} ELSE s.line END", 2: f"replace({mask}, 'License', 'licence')"}

    def level(n: int, before: str, todo: str) -> str:
        clean = STRIP.format(x=REPLY_UNFENCE.format(x="reply"))
        return f"""
        q{n} AS (SELECT f.*, k.line FROM {todo} f JOIN {before} k ON k.doc_id = f.doc_id AND k.line_no = f.line_num),
        r{n} AS (SELECT s.*, CASE WHEN s.test_id = 'R001' THEN NULL
                   ELSE '```python' || chr(10) || {answer[n]} || chr(10) || '```' END AS reply FROM q{n} s),
        p{n} AS (SELECT doc_id, line_num, arg_max({clean}, finding_id) AS block FROM r{n} WHERE reply IS NOT NULL GROUP BY ALL),
        l{n} AS (SELECT k.doc_id, k.line_no, CASE WHEN p.block IS NULL THEN k.line WHEN ends_with(p.block, chr(10)) THEN p.block
                   ELSE p.block || chr(10) END AS line
                 FROM {before} k LEFT JOIN p{n} p ON p.doc_id = k.doc_id AND p.line_num = k.line_no),
        s{n} AS (SELECT DISTINCT l.doc_id, r.test_id FROM l{n} l JOIN rules r ON regexp_matches(l.line, r.pattern)),
        a{n} AS (SELECT r.doc_id, r.finding_id, r.test_id, r.line_num, r.severity, {n} AS level_attempted,
                   CASE WHEN r.reply IS NULL THEN 'error' WHEN s.test_id IS NULL THEN 'success' ELSE 'failed_level_{n}' END AS status,
                   CASE WHEN r.reply IS NULL THEN 0 ELSE length(r.line) END AS p_tokens,
                   CASE WHEN r.reply IS NULL THEN 0 ELSE length(r.reply) END AS c_tokens
                 FROM r{n} r LEFT JOIN s{n} s ON s.doc_id = r.doc_id AND s.test_id = r.test_id),
        t{n} AS (SELECT doc_id, finding_id, test_id, line_num, severity FROM a{n} WHERE status = 'failed_level_{n}')"""

    first = """,
        t0 AS (SELECT doc_id, line_no::BIGINT * 1000 + CAST(substr(test_id, 2, 3) AS INTEGER) AS finding_id, test_id,
                      line_no AS line_num, severity FROM fb),"""
    return with_(LINES + first + level(1, "klines", "t0") + "," + level(2, "l1", "t1"), """
        SELECT doc_id AS file_uid, test_id AS vulnerability_id,
          row_number() OVER (PARTITION BY doc_id ORDER BY level_attempted, finding_id) AS attempt_seq, level_attempted,
          CASE level_attempted WHEN 1 THEN 'alibaba-qwen3-32b' ELSE 'deepseek-r1-distill-llama-70b' END AS model, status,
          CASE WHEN status = 'error' THEN 'no reply' ELSE 'stop' END AS finish_reason,
          CAST(p_tokens AS BIGINT) AS prompt_tokens, CAST(c_tokens AS BIGINT) AS completion_tokens,
          CAST(p_tokens + c_tokens AS BIGINT) AS total_tokens,
          CAST(CASE WHEN status = 'error' THEN 0 ELSE 0.5 END AS DOUBLE) AS llm_time_taken, severity, 'HIGH' AS confidence,
          finding_id, line_num, false AS wiped, true AS rescan_ok
        FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2)""")


DOC_SQL = {
    "corpus_language_filter": with_(RAW_SAMPLES, "SELECT doc_id, lang, chosen FROM raw WHERE lang = 'en'"),
    "corpus_prepare": with_(RAW_SAMPLES + f""",
        idx AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS sample_id FROM raw WHERE lang = 'en'),
        cl AS (SELECT sample_id, doc_id, {CLEAN} AS code FROM idx)""",
        f"""SELECT CAST(sample_id AS BIGINT) AS sample_id, doc_id, 'sample_' || CAST(sample_id AS VARCHAR) || '.py' AS filename,
            code FROM cl WHERE length({STRIP.format(x='code')}) > 0"""),
    "fence_strip": with_(RAW_SAMPLES, f"SELECT doc_id, {CLEAN} AS code FROM raw"),
    "reply_fence_clean": with_(r"""
        rep AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '```python' || chr(10) || text || chr(10) || '```'
            WHEN turn % 3 = 1 THEN '  ```' || text || '```  ' ELSE text END AS reply
          FROM conversations WHERE role = 'assistant')""",
        f"SELECT conv_id, turn, {STRIP.format(x=REPLY_UNFENCE.format(x='reply'))} AS code FROM rep"),
    "split_lines": with_(LINES, "SELECT doc_id, line_no, line FROM klines"),
    "word_count": r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INTEGER)
        AS n_words FROM documents""",
    "systematic_sample": "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT range FROM range(0, 420, 5))",
    "url_version_rewrite": f"SELECT page_id, url, {DOC_REWRITE.format(u='url')} AS doc_url FROM pages",
    "props_json_field": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "scan_report_explode": with_(REPORTS, r"""SELECT doc_id, finding_idx,
        json_extract_string(r, '$.issue_confidence') AS issue_confidence,
        json_extract_string(r, '$.issue_severity') AS issue_severity, json_extract_string(r, '$.issue_text') AS issue_text,
        array_to_string(CAST(json_extract(r, '$.line_range') AS INTEGER[]), ',') AS line_range,
        json_extract_string(r, '$.test_id') AS test_id, json_extract_string(r, '$.test_name') AS test_name,
        json_extract_string(r, '$.more_info') AS more_info_url, json_extract_string(r, '$.code') AS code_snippet FROM ex"""),
    "finding_first_line": with_(REPORTS, r"""SELECT doc_id, finding_idx, json_extract_string(r, '$.test_id') AS test_id,
        CAST(json_extract(r, '$.line_range[0]') AS INTEGER) AS line_num,
        json_extract_string(r, '$.issue_severity') AS severity, json_extract_string(r, '$.issue_confidence') AS confidence
        FROM ex"""),
    "rule_scan_findings": with_(LINES, "SELECT * FROM fb"),
    "rule_catalogue_scan": """
        WITH r AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM benchmark) WHERE length(w) >= 3),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
              FROM documents),
        p AS (SELECT doc_id, line_no, line, w FROM l JOIN r ON contains(line, w))
        SELECT doc_id, 'W-' || w AS test_id, count(*)::BIGINT AS n_lines, min(line_no)::INTEGER AS first_line
        FROM p WHERE regexp_matches(line, w || '[a-z]* [a-z]+') GROUP BY doc_id, w""",
    "findings_per_doc": with_(LINES, """SELECT d.doc_id, CAST(count(fa.test_id) AS BIGINT) AS n_findings
        FROM documents d LEFT JOIN fa ON fa.doc_id = d.doc_id GROUP BY d.doc_id"""),
    "verify_patch": with_(LINES, """SELECT fb.*, NOT EXISTS (SELECT 1 FROM fa WHERE fa.doc_id = fb.doc_id
        AND fa.test_id = fb.test_id) AS is_patched FROM fb"""),
    "finding_doc_join": with_(f"""
        pk AS (SELECT url, html, {DOC_REWRITE.format(u='url')} AS k FROM pages),
        docs AS (SELECT k, arg_min({H1}, {{'moved': url <> k, 'url': url}}) AS t FROM pk GROUP BY k),
        f AS (SELECT page_id AS finding_id, CASE WHEN page_id % 10 = 0 THEN NULL ELSE url END AS u FROM pages)""",
        f"""SELECT finding_id, CASE WHEN u IS NULL OR u = '' THEN 'No documentation URL provided.'
            WHEN docs.t IS NULL THEN 'docs not found' ELSE docs.t END AS scraped, {DOC_REWRITE.format(u='u')} AS doc_url
            FROM f LEFT JOIN docs ON docs.k = {DOC_REWRITE.format(u='u')}"""),
    "innermost_span": with_(LINES, """SELECT fb.doc_id, fb.line_no, fb.test_id, fb.severity,
        CAST(max(s.start_line) AS INTEGER) AS span_start, CAST(min(s.end_line) AS INTEGER) AS span_end
        FROM fb LEFT JOIN spans s ON s.doc_id = fb.doc_id AND fb.line_no BETWEEN s.start_line AND s.end_line
        GROUP BY fb.doc_id, fb.line_no, fb.test_id, fb.severity"""),
    "line_window_context": with_(LINES + """,
        nl AS (SELECT doc_id, max(line_no) AS n FROM klines GROUP BY doc_id),
        b AS (SELECT fb.*, CAST(greatest(0, fb.line_no - 6) + 1 AS INTEGER) AS start_line,
                     CAST(least(coalesce(nl.n, 0), fb.line_no + 5) AS INTEGER) AS end_line
              FROM fb LEFT JOIN nl ON nl.doc_id = fb.doc_id)""",
        """SELECT b.*, coalesce((SELECT string_agg(k.line, '' ORDER BY k.line_no) FROM klines k
            WHERE k.doc_id = b.doc_id AND k.line_no BETWEEN b.start_line AND b.end_line), '') AS code FROM b"""),
    "line_window_frame": with_(LINES, """SELECT doc_id, line_no, line,
        array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), '')
        AS context FROM klines"""),
    "function_context": with_(LINES + """,
        nl AS (SELECT doc_id, max(line_no) AS n FROM klines GROUP BY doc_id),
        f AS (SELECT fb.doc_id, fb.line_no, fb.test_id, fb.severity, max(s.start_line) AS ss, min(s.end_line) AS se
              FROM fb LEFT JOIN spans s ON s.doc_id = fb.doc_id AND fb.line_no BETWEEN s.start_line AND s.end_line
              GROUP BY ALL),
        b AS (SELECT f.doc_id, f.line_no, f.test_id, f.severity,
                     CASE WHEN ss IS NULL THEN 'window' ELSE 'function' END AS context_type,
                     CAST(coalesce(ss, greatest(0, f.line_no - 6) + 1) AS INTEGER) AS start_line,
                     CAST(coalesce(se, least(coalesce(nl.n, 0), f.line_no + 5)) AS INTEGER) AS end_line
              FROM f LEFT JOIN nl ON nl.doc_id = f.doc_id)""",
        """SELECT b.*, coalesce((SELECT string_agg(k.line, '' ORDER BY k.line_no) FROM klines k
            WHERE k.doc_id = b.doc_id AND k.line_no BETWEEN b.start_line AND b.end_line), '') AS code FROM b"""),
    "function_spans": "WITH " + SPANS + " SELECT * FROM sp",
    "function_span_context": "WITH " + SPANS + """
        SELECT l.doc_id, l.line_no, max(sp.start_line)::INTEGER AS span_start, arg_max(sp.end_line, sp.start_line)::INTEGER AS span_end
        FROM doc_lines l LEFT JOIN sp ON sp.doc_id = l.doc_id AND l.line_no BETWEEN sp.start_line AND sp.end_line
        WHERE l.line_no % 10 = 3 GROUP BY l.doc_id, l.line_no""",
    "code_stats": with_(LINES + f""",
        bl AS (SELECT doc_id, (line_no - 1) // 10 AS b, count_if(contains(line, 'the')) + 1 AS complexity
               FROM doc_lines GROUP BY ALL),
        m AS (SELECT doc_id, {half_even('sum(complexity)', 'count(*)', 2, percent=False)} AS avg_cyclomatic_complexity,
                     count(*) AS n_blocks FROM bl GROUP BY doc_id)""",
        r"""SELECT l.doc_id, coalesce(any_value(m.avg_cyclomatic_complexity), 0) AS avg_cyclomatic_complexity,
            coalesce(any_value(m.n_blocks), 0) AS n_blocks,
            CAST(count_if(regexp_matches(l.line, '^\s*[^\s#]')) AS BIGINT) AS sloc
            FROM doc_lines l LEFT JOIN m ON m.doc_id = l.doc_id GROUP BY l.doc_id"""),
    "page_text_extract": r"""
        WITH RECURSIVE tokens AS MATERIALIZED (
          SELECT page_id, generate_subscripts(x, 1) AS i, unnest(x) AS x, len(x) AS n FROM (SELECT page_id,
            regexp_extract_all(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>|[^<]+') AS x FROM pages)),
        tag AS MATERIALIZED (
          SELECT page_id, i, lower(regexp_extract(x, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name,
            regexp_matches(x, '\sclass[\s=>]') AS classed,
            CASE WHEN NOT regexp_matches(x, '^</?[a-zA-Z]') OR regexp_matches(x, '^<(script|style|br|meta|img|link|hr|input)') THEN 0
                 WHEN x[2] = '/' THEN 2 ELSE 1 END AS kind FROM tokens),
        st AS (
          SELECT page_id, 0::BIGINT AS i, []::STRUCT(name VARCHAR, pos BIGINT, keep INT, li INT)[] AS stack, 0::BIGINT AS box,
            []::STRUCT(pos BIGINT, till BIGINT, keep INT)[] AS out FROM pages
          UNION ALL
          SELECT page_id, i, CASE kind WHEN 2 THEN stack[:p - 1] WHEN 1 THEN list_append(stack, {'name': name, 'pos': i, 'keep': keep,
              'li': li + (name = 'li')::INT}) ELSE stack END,
            CASE WHEN kind = 2 AND box >= p THEN -1 WHEN kind = 1 AND box = 0 AND name = 'article' THEN len(stack) + 1 ELSE box END,
            CASE WHEN kind = 2 THEN out || [{'pos': e.pos, 'till': i, 'keep': e.keep} for e in stack[p:] if e.keep > 0] ELSE out END
          FROM (SELECT *, CASE WHEN box <= 0 THEN 0 WHEN name = 'p' AND li = 0 AND NOT classed THEN 1
                               WHEN name IN ('h1', 'h2', 'h3') THEN 2 ELSE 0 END AS keep
                FROM (SELECT s.page_id, t.i, s.stack, s.box, s.out, t.kind, t.name, t.classed, coalesce(s.stack[-1].li, 0) AS li,
                        len(s.stack) + 1 - coalesce(list_position(list_reverse([e.name for e in s.stack]), t.name), 0) AS p
                      FROM st s JOIN tag t ON t.page_id = s.page_id AND t.i = s.i + 1))),
        done AS (SELECT st.page_id, st.box, st.out || [{'pos': e.pos, 'till': st.i + 1, 'keep': e.keep} for e in st.stack if e.keep > 0] AS out
                 FROM st WHERE st.i = coalesce((SELECT max(n) FROM tokens WHERE tokens.page_id = st.page_id), 0)),
        el AS (SELECT page_id, unnest(out, recursive := true) FROM done),
        words AS MATERIALIZED (SELECT page_id, i, replace(replace(replace(replace(regexp_replace(x, '^\s+|\s+$', '', 'g'),
                   '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS w FROM tokens WHERE x[1] <> '<'),
        texts AS (SELECT el.page_id, el.pos, el.keep, coalesce(string_agg(w.w, '' ORDER BY w.i), '') AS text
                  FROM el LEFT JOIN words w ON w.page_id = el.page_id AND w.i > el.pos AND w.i < el.till GROUP BY ALL),
        joined AS (SELECT page_id, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE keep = 1), '')
                     || coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE keep = 2), '') AS text FROM texts GROUP BY page_id)
        SELECT page_id, url, CASE WHEN box = 0 THEN 'docs not found' ELSE nullif(coalesce(text, ''), '') END AS text
        FROM pages JOIN done USING (page_id) LEFT JOIN joined USING (page_id)""",
    "apply_patches": with_(LINES + """,
        hit AS (SELECT DISTINCT doc_id, line_no FROM fb),
        up AS (SELECT k.doc_id, k.line_no, CASE WHEN hit.line_no IS NULL THEN k.line ELSE
                 translate(rtrim(k.line, chr(10)), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || chr(10) END AS line,
                 (hit.line_no IS NOT NULL)::INT AS edited
               FROM klines k LEFT JOIN hit ON hit.doc_id = k.doc_id AND hit.line_no = k.line_no)""",
        """SELECT d.doc_id, coalesce(string_agg(up.line, '' ORDER BY up.line_no), '') AS code,
            CAST(coalesce(sum(up.edited), 0) AS INTEGER) AS n_patches, false AS overlapping,
            coalesce(length(string_agg(up.line, '')), 0) = 0 AS wiped, CAST(0 AS INTEGER) AS n_skipped
            FROM documents d LEFT JOIN up ON up.doc_id = d.doc_id GROUP BY d.doc_id"""),
    "remediation_cascade": _cascade_sql(),
    "splice_line_table": "WITH RECURSIVE " + LINES.strip() + r""",
        edits AS (
          SELECT doc_id, line_no AS s, line_no + doc_id % 4 AS e, line_no * 10 + 1 AS o, translate(line, 'aeiou', 'AEIOU') AS b
            FROM doc_lines WHERE line_no % 7 = 3
          UNION ALL SELECT doc_id, line_no, line_no + 1, line_no * 10 + 2, 'spliced' || chr(10) || 'twice' FROM doc_lines WHERE line_no % 11 = 5
          UNION ALL SELECT doc_id, line_no, line_no - 1, line_no * 10 + 3, '' FROM doc_lines WHERE line_no % 13 = 1),
        e1 AS MATERIALIZED (SELECT doc_id, s, e, arg_max(b, o) AS b FROM edits GROUP BY doc_id, s, e),
        pick AS (
          SELECT doc_id, min(s * 10000000 + e) AS c FROM e1 GROUP BY doc_id
          UNION ALL
          SELECT p.doc_id, min(x.s * 10000000 + x.e) FROM pick p JOIN e1 x ON x.doc_id = p.doc_id AND x.s > p.c % 10000000
            AND x.s * 10000000 + x.e > p.c GROUP BY p.doc_id),
        used AS (SELECT x.* FROM e1 x JOIN pick p ON p.doc_id = x.doc_id AND p.c = x.s * 10000000 + x.e),
        parts AS (SELECT doc_id, s, e, string_split(CASE WHEN b LIKE '%' || chr(10) THEN left(b, length(b) - 1) ELSE b END, chr(10)) AS ls FROM used),
        new AS (
          SELECT doc_id, s AS place, 0 AS sub, e, generate_subscripts(ls, 1) AS i, unnest(ls) || chr(10) AS line FROM parts
          UNION ALL SELECT doc_id, line_no, 1, 0, 0, line FROM klines k
            WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.doc_id = k.doc_id AND k.line_no BETWEEN u.s AND u.e))
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, sub, e, i) AS line_no, line FROM new""",
    "multiset_line_churn": with_(LINES + """,
        cb AS (SELECT doc_id, line, count(*) AS cb FROM doc_lines GROUP BY ALL),
        ca AS (SELECT doc_id, line, count(*) AS ca FROM edited GROUP BY ALL),
        j AS (SELECT coalesce(cb.doc_id, ca.doc_id) AS doc_id, coalesce(ca.ca, 0) - coalesce(cb.cb, 0) AS d
              FROM cb FULL OUTER JOIN ca ON ca.doc_id = cb.doc_id AND ca.line = cb.line)""",
        """SELECT doc_id, CAST(sum(greatest(d, 0)) AS BIGINT) AS added, CAST(sum(greatest(-d, 0)) AS BIGINT) AS removed,
            CAST(greatest(sum(greatest(d, 0)), sum(greatest(-d, 0))) AS BIGINT) AS churn FROM j GROUP BY doc_id"""),
    "page_headings": f"SELECT page_id, {H1} AS headings FROM pages",
    "prompt_projection": f"""SELECT u.conv_id, u.turn, {_template_sql('u.text', 'a.text')} AS prompt
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn + 1 = u.turn
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    "plan_prompts": with_(LINES + f""",
        nl AS (SELECT doc_id, max(line_no) AS n FROM klines GROUP BY doc_id),
        c AS (SELECT fb.doc_id, fb.line_no, fb.test_id, fb.severity, string_agg(k.line, '' ORDER BY k.line_no) AS code
              FROM fb LEFT JOIN klines k ON k.doc_id = fb.doc_id AND k.line_no BETWEEN fb.line_no - 5 AND fb.line_no + 5 GROUP BY ALL),
        pk AS (SELECT url, html, {DOC_REWRITE.format(u='url')} AS k FROM pages),
        docs AS (SELECT k, arg_min({H1}, {{'moved': url <> k, 'url': url}}) AS t FROM pk GROUP BY k),
        p AS (SELECT c.*, CASE WHEN g.url IS NULL OR g.url = '' THEN 'No documentation URL provided.' WHEN docs.t IS NULL THEN 'docs not found'
                ELSE docs.t END AS scraped FROM c LEFT JOIN pages g ON g.page_id = c.doc_id LEFT JOIN docs ON docs.k = {DOC_REWRITE.format(u='g.url')})""",
        f"""SELECT doc_id, line_no, test_id, severity, {STRIP.format(x=REPLY_UNFENCE.format(x='(' + _plan_sql() + ')'))} AS strategy FROM p"""),
    "answer_distinct_prompts": """SELECT conv_id, turn, sha256(text) AS digest, 'answer to: ' || substr(text, 1, 40) AS reply,
        CASE WHEN text IS NOT NULL THEN 'stop' END AS finish_reason, length(text)::BIGINT AS prompt_tokens,
        CASE WHEN text IS NOT NULL THEN 1 END::BIGINT AS completion_tokens, CASE WHEN text IS NOT NULL THEN 0.5 END::DOUBLE AS duration_s
        FROM conversations""",
    "attach_responses": f"""SELECT u.conv_id, u.turn, CAST(length(u.text) AS INTEGER) AS prompt_chars, a.text AS reply,
        {STRIP.format(x=REPLY_UNFENCE.format(x='a.text'))} AS reply_clean
        FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
          AND a.role = 'assistant'
        WHERE u.role = 'user'""",
}


def oracle_sql() -> dict[str, str]:
    out = {k: with_(ATTEMPTS, v) for k, v in AUDIT_SQL.items()}
    out.update(DOC_SQL)
    return out
