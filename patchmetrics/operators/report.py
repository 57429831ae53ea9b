"""KPI report over the audit log (C4): flatten, filter, unnest, aggregate.

Input is the nested audit log (``schemas.AUDIT_LOG_DDL``), in memory or read back with ``sources.io.read_audit_log``.
Every section is an aggregate with map-side combine; the only shuffles are the per-key groupings and the
semi-join of log entries on the set of valid file ids.

Ratios are computed from exact integer / decimal sums (``CAST(num AS DOUBLE) / den``); rounded rates use
integer half-even rounding (``functions.money.half_even_ratio``) so two engines agree to the digit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import half_even_ratio

LEVELS = (1, 2)


# ---------------------------------------------------------------- P8: flatten
def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs to dotted top-level columns (``a.b.c``); arrays and maps are left intact."""

    def walk(dtype: T.DataType, path: list[str]):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                yield from walk(f.dataType, path + [f.name])
        else:
            yield path

    cols = []
    for f in df.schema.fields:
        for path in walk(f.dataType, [f.name]):
            cols.append(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)))
    return df.select(*cols)


def column_or_null(df: DataFrame, name: str, dtype: str = "double") -> Column:
    """A (possibly dotted) column if the schema has it, else a typed null."""
    parts = name.split(".")
    dt: T.DataType = df.schema
    for p in parts:
        if not isinstance(dt, T.StructType) or p not in dt.fieldNames():
            return F.lit(None).cast(dtype)
        dt = dt[p].dataType
    return F.col(name)


# ---------------------------------------------------------------- P9, J2, A11-A14
def valid_files(log: DataFrame) -> DataFrame:
    """Files with at least one vulnerability (null counts are dropped, as in pandas)."""
    return log.filter(F.col("input_stats.vuln_count") > 0)


def valid_entries(log: DataFrame) -> DataFrame:
    """J2 + A12: log entries whose file id is among the valid files' ids.

    On the id, so a zero-vulnerability duplicate entry of a valid id still contributes its traces.
    """
    ids = valid_files(log).select(F.col("meta.file_uid").alias("_uid")).distinct()
    return log.join(ids, F.col("meta.file_uid") == F.col("_uid"), "left_semi")


def of_valid_files(files: DataFrame, rows: DataFrame) -> DataFrame:
    """J2 + A12 over long-form rows: those whose ``file_uid`` is among the ids of files with vulnerabilities."""
    ids = files.filter(F.col("vuln_count") > 0).select("file_uid").distinct()
    return rows.join(ids, "file_uid", "left_semi")


def as_records(files: DataFrame) -> DataFrame:
    """Long-form file rows with the column paths of log records (and no nested list), for the file-level sections."""
    return files.select(
        F.struct("file_uid").alias("meta"),
        F.struct("vuln_count", F.col("cc_before").alias("avg_cyclomatic_complexity")).alias("input_stats"),
        F.struct("fixed_count", "normalized_loc_churn", "ast_churn",
                 F.struct(F.col("cc_after").alias("avg_cyclomatic_complexity")).alias("final_code_stats"))
        .alias("security_summary"), "total_cost_usd")


def dataset_counts(log: DataFrame) -> DataFrame:
    """Loaded / analysed / excluded file records."""
    return log.agg(F.count(F.lit(1)).alias("loaded"),
                   F.count_if(F.col("input_stats.vuln_count") > 0).alias("analyzed")) \
        .withColumn("excluded", F.col("loaded") - F.col("analyzed"))


def explode_vulnerabilities(entries: DataFrame) -> DataFrame:
    """One row per trace (a file with no traces yields no row)."""
    return entries.select(F.col("meta.file_uid").alias("file_uid"), F.explode("vulnerabilities").alias("v")) \
        .select("file_uid", F.col("v.test_id").alias("test_id"), F.col("v.severity").alias("severity"),
                F.col("v.status").alias("status"))


def explode_attempts(entries: DataFrame) -> DataFrame:
    """One row per attempt of every trace."""
    v = entries.select(F.col("meta.file_uid").alias("file_uid"), F.explode("vulnerabilities").alias("v"))
    return v.select("file_uid", F.col("v.test_id").alias("test_id"), F.explode("v.attempts").alias("a")) \
        .select("file_uid", "test_id", F.col("a.level").alias("level"), F.col("a.status").alias("status"),
                F.col("a.tokens.total_tokens").alias("total_tokens"))


def _pct(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double")) * F.lit(100.0)


# ---------------------------------------------------------------- file-level sections
def vuln_fix_rate(files: DataFrame) -> DataFrame:
    """A15 over valid files: sum(fixed) / sum(detected)."""
    return files.agg(F.sum("security_summary.fixed_count").alias("fixed"),
                     F.sum("input_stats.vuln_count").alias("detected")) \
        .withColumn("fix_rate_pct", _pct(F.col("fixed"), F.col("detected")))


def file_remediation_rate(files: DataFrame) -> DataFrame:
    """P10 + A16: files whose fixed count equals their vulnerability count."""
    return files.agg(F.count_if(F.col("input_stats.vuln_count") == F.col("security_summary.fixed_count"))
                     .alias("remediated_files"), F.count(F.lit(1)).alias("files")) \
        .withColumn("remediation_rate_pct", _pct(F.col("remediated_files"), F.col("files")))


def cost_per_fix(files: DataFrame) -> DataFrame:
    """sum(file cost) / sum(fixed), 0 when nothing is fixed (failed attempts' cost included)."""
    out = files.agg(F.sum("total_cost_usd").cast("decimal(18,6)").alias("total_cost_usd"),
                    F.sum("security_summary.fixed_count").alias("fixed"))
    return out.withColumn("cost_per_fix", F.coalesce(
        F.try_divide(F.col("total_cost_usd").cast("double"), F.col("fixed").cast("double")), F.lit(0.0)))


def avg_churn(files: DataFrame) -> DataFrame:
    """Mean normalised line churn and mean AST churn (nulls skipped); N/A (null) if the column is absent."""
    lc = column_or_null(files, "security_summary.normalized_loc_churn", "bigint")
    ac = column_or_null(files, "security_summary.ast_churn", "bigint")
    return files.agg(F.sum(lc).alias("loc_churn_sum"), F.count(lc).alias("loc_churn_n"),
                     F.sum(ac).alias("ast_churn_sum"), F.count(ac).alias("ast_churn_n")) \
        .withColumn("avg_loc_churn", F.try_divide(F.col("loc_churn_sum").cast("double"), F.col("loc_churn_n").cast("double"))) \
        .withColumn("avg_ast_churn", F.try_divide(F.col("ast_churn_sum").cast("double"), F.col("ast_churn_n").cast("double")))


def complexity_delta(files: DataFrame) -> DataFrame:
    """Mean of (after - before) complexity; a null on either side skips the file.

    Complexities carry two decimals (rounded at the source), so the sum is taken in ``DECIMAL(18,2)`` and is exact.
    """
    return complexity_delta_of(files, F.col("input_stats.avg_cyclomatic_complexity"),
                               F.col("security_summary.final_code_stats.avg_cyclomatic_complexity"))


def complexity_delta_of(files: DataFrame, before: Column, after: Column) -> DataFrame:
    """A21 over any two complexity columns of ``files``."""
    d = after.cast("decimal(18,2)") - before.cast("decimal(18,2)")
    return files.agg(F.sum(d).cast("decimal(18,2)").alias("cc_delta_sum"), F.count(d).alias("cc_delta_n")) \
        .withColumn("avg_cc_delta", F.try_divide(F.col("cc_delta_sum").cast("double"), F.col("cc_delta_n").cast("double")))


# ---------------------------------------------------------------- attempt-level sections
def level_success_rate(attempts: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Per level 1 and 2: attempts, successes, rate (null = N/A when a level has no attempts)."""
    spark = spark or attempts.sparkSession
    levels = spark.createDataFrame([(lv,) for lv in LEVELS], "level int")
    per = attempts.groupBy("level").agg(F.count(F.lit(1)).alias("attempts"),
                                        F.count_if(F.col("status") == "SUCCESS").alias("successes"))
    j = levels.join(F.broadcast(per), "level", "left")   # one row per level on either side
    return j.select("level", F.coalesce("attempts", F.lit(0)).alias("attempts"),
                    F.coalesce("successes", F.lit(0)).alias("successes")) \
        .withColumn("success_rate_pct", _pct(F.col("successes"), F.col("attempts")))


def avg_tokens_per_fix(attempts: DataFrame) -> DataFrame:
    """Mean total tokens over successful attempts (null when none)."""
    ok = F.col("status") == "SUCCESS"
    return attempts.agg(F.sum(F.when(ok, F.col("total_tokens"))).alias("success_tokens"),
                        F.count_if(ok).alias("successes")) \
        .withColumn("avg_tokens_per_fix",
                    F.try_divide(F.col("success_tokens").cast("double"), F.col("successes").cast("double")))


# ---------------------------------------------------------------- vulnerability-level sections
def severity_breakdown(vulns: DataFrame) -> DataFrame:
    """Per severity the status counts (pivoted, missing -> 0) and shares in percent, half-even to 2 places."""
    piv = vulns.groupBy("severity").pivot("status", ["FIXED", "FAILED"]).count().fillna(0, ["FIXED", "FAILED"])
    tot = F.col("FIXED") + F.col("FAILED")
    return piv.select("severity", tot.alias("total"), F.col("FIXED").alias("fixed"), F.col("FAILED").alias("failed"),
                      half_even_ratio(F.col("FIXED"), tot, 2).alias("fixed_pct"),
                      half_even_ratio(F.col("FAILED"), tot, 2).alias("failed_pct"))


def success_by_test_id(vulns: DataFrame) -> DataFrame:
    """A23 + O1: per rule mean(is_fixed) x100 half-even to 1 place, case count; sorted by cases then rate."""
    agg = vulns.groupBy("test_id").agg(F.count(F.lit(1)).alias("total_cases"),
                                       F.count_if(F.col("status") == "FIXED").alias("fixed"))
    return agg.withColumn("success_rate", half_even_ratio(F.col("fixed"), F.col("total_cases"), 1)) \
        .orderBy(F.desc("total_cases"), F.desc("success_rate"), F.asc("test_id"))


# ---------------------------------------------------------------- A25: the whole report
REPORT_DDL = "section string, metric string, key string, numerator decimal(38,6), denominator decimal(38,6), value double"


def _report_row(section: str, metric: str, key: Column, num: Column, den: Column, value: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"), key.cast("string").alias("key"),
                    num.cast("decimal(38,6)").alias("numerator"), den.cast("decimal(38,6)").alias("denominator"),
                    value.cast("double").alias("value"))


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def log_tables(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nested audit log as the three long-form tables the report needs: ``(files, vulns, attempts)``.

    ``vulns`` and ``attempts`` are restricted to entries of valid file ids (J2). ``files`` has ``file_uid,
    vuln_count, fixed_count, total_cost_usd, normalized_loc_churn, ast_churn, cc_before, cc_after``.
    """
    lc = column_or_null(log, "security_summary.normalized_loc_churn", "bigint")
    ac = column_or_null(log, "security_summary.ast_churn", "bigint")
    files = log.select(
        F.col("meta.file_uid").alias("file_uid"), F.col("input_stats.vuln_count").alias("vuln_count"),
        F.col("security_summary.fixed_count").alias("fixed_count"), "total_cost_usd",
        lc.alias("normalized_loc_churn"), ac.alias("ast_churn"),
        F.col("input_stats.avg_cyclomatic_complexity").alias("cc_before"),
        F.col("security_summary.final_code_stats.avg_cyclomatic_complexity").alias("cc_after"))
    entries = valid_entries(log)
    return files, explode_vulnerabilities(entries), explode_attempts(entries)


def kpi_report(log: DataFrame) -> DataFrame:
    """A25 over the nested audit log (the reference's input): ``kpi_report_flat(*log_tables(log))``."""
    return kpi_report_flat(*log_tables(log))


def kpi_report_flat(files: DataFrame, vulns: DataFrame, attempts: DataFrame,
                    restrict_to_valid: bool = False) -> DataFrame:
    """Every KPI section as ``(section, metric, key, numerator, denominator, value)`` rows.

    Inputs are long-form: one row per file record, per trace, per attempt (``log_tables`` or
    ``audit.long_form_log``). Three aggregations in total: all file-level metrics in one pass (one row,
    unpivoted), all attempt-level metrics in another, the vulnerability-level metrics in one
    grouping-sets pass over (severity) and (test_id). Every aggregate combines map-side, so no file, trace or rule
    -- however hot -- is gathered into one task. ``restrict_to_valid`` applies J2 to ``vulns``/``attempts``
    (semi join on the distinct ids of files with vulnerabilities) when they are not already restricted.
    """
    if restrict_to_valid:
        vulns, attempts = of_valid_files(files, vulns), of_valid_files(files, attempts)
    return report_rows(file_state(files), attempt_state(attempts), trace_state(vulns))


def file_state(files: DataFrame) -> DataFrame:
    """All file-level sums of the report as one row; rows of several inputs add up (``add_states``)."""
    c = F.col
    valid = c("vuln_count") > 0
    on_valid = lambda x: F.when(valid, x)
    ccd = c("cc_after").cast("decimal(18,2)") - c("cc_before").cast("decimal(18,2)")
    return files.agg(
        F.count(F.lit(1)).alias("loaded"), F.count_if(valid).alias("analyzed"),
        F.sum(on_valid(c("fixed_count"))).alias("fixed"), F.sum(on_valid(c("vuln_count"))).alias("detected"),
        F.count_if(valid & (c("vuln_count") == c("fixed_count"))).alias("remediated"),
        F.sum(on_valid(c("total_cost_usd"))).cast("decimal(18,6)").alias("cost"),
        F.sum(on_valid(c("normalized_loc_churn"))).alias("lc_sum"), F.count(on_valid(c("normalized_loc_churn"))).alias("lc_n"),
        F.sum(on_valid(c("ast_churn"))).alias("ac_sum"), F.count(on_valid(c("ast_churn"))).alias("ac_n"),
        F.sum(on_valid(ccd)).cast("decimal(18,2)").alias("cc_sum"), F.count(on_valid(ccd)).alias("cc_n"))


def attempt_state(attempts: DataFrame) -> DataFrame:
    """All attempt-level sums of the report as one row."""
    c = F.col
    ok = c("status") == "SUCCESS"
    return attempts.agg(
        F.sum(F.when(ok, c("total_tokens"))).alias("t"), F.count_if(ok).alias("n"),
        *[F.count_if(c("level") == lv).alias(f"a{lv}") for lv in LEVELS],
        *[F.count_if(ok & (c("level") == lv)).alias(f"s{lv}") for lv in LEVELS])


def trace_state(vulns: DataFrame) -> DataFrame:
    """Cases and fixed cases of every severity (``gid`` 1) and of every rule (``gid`` 2)."""
    return vulns.groupingSets([["severity"], ["test_id"]], "severity", "test_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "FIXED").alias("fixed"), F.grouping_id().alias("gid"))


def add_states(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """State rows of several inputs as the state of all of them: every column is a sum, null where no input has a value."""
    sums = [F.sum(f.name).cast(f.dataType).alias(f.name) for f in states.schema if f.name not in keys]
    return states.groupBy(*keys).agg(*sums).select(*states.columns) if keys else states.agg(*sums)


def report_rows(fl: DataFrame, at: DataFrame, by: DataFrame) -> DataFrame:
    """The report from its three states."""
    c, nul = F.col, F.lit(None)
    file_rows = fl.select(F.explode(F.array(
        _report_row("dataset", "loaded", nul, c("loaded"), nul, c("loaded")),
        _report_row("dataset", "analyzed", nul, c("analyzed"), nul, c("analyzed")),
        _report_row("dataset", "excluded", nul, c("loaded") - c("analyzed"), nul, c("loaded") - c("analyzed")),
        _report_row("effectiveness", "vuln_fix_rate", nul, c("fixed"), c("detected"), _pct(c("fixed"), c("detected"))),
        _report_row("effectiveness", "file_remediation_rate", nul, c("remediated"), c("analyzed"),
                    _pct(c("remediated"), c("analyzed"))),
        _report_row("cost", "cost_per_fix", nul, c("cost"), c("fixed"),
                    F.coalesce(_ratio(c("cost"), c("fixed")), F.lit(0.0))),
        _report_row("quality", "avg_loc_churn", nul, c("lc_sum"), c("lc_n"), _ratio(c("lc_sum"), c("lc_n"))),
        _report_row("quality", "avg_ast_churn", nul, c("ac_sum"), c("ac_n"), _ratio(c("ac_sum"), c("ac_n"))),
        _report_row("quality", "avg_complexity_change", nul, c("cc_sum"), c("cc_n"), _ratio(c("cc_sum"), c("cc_n"))),
    )).alias("r")).select("r.*")

    attempt_rows = at.select(F.explode(F.array(
        *[_report_row("tiers", "level_success_rate", F.lit(lv), c(f"s{lv}"), c(f"a{lv}"), _pct(c(f"s{lv}"), c(f"a{lv}")))
          for lv in LEVELS],
        _report_row("cost", "avg_tokens_per_fix", nul, c("t"), c("n"), _ratio(c("t"), c("n"))))).alias("r")).select("r.*")

    vuln_rows = by.select(F.when(c("gid") == 1, _report_row("severity", "fixed_share_pct", c("severity"), c("fixed"),
                                                             c("n"), half_even_ratio(c("fixed"), c("n"), 2)))
                          .otherwise(_report_row("rule", "success_rate_pct", c("test_id"), c("fixed"), c("n"),
                                                 half_even_ratio(c("fixed"), c("n"), 1))).alias("r")).select("r.*")
    return file_rows.unionByName(attempt_rows).unionByName(vuln_rows)


# Labels and number formats of the printed report, in print order.
REPORT_LABELS = {
    "vuln_fix_rate": "Vulnerability Fix Rate:   ",
    "file_remediation_rate": "File Remediation Rate:    ",
    "level_success_rate": "Level {} Success Rate:    ",
    "avg_tokens_per_fix": "Avg Tokens per Fix:       ",
    "cost_per_fix": "Avg Cost per Fix (CPF):   $",
    "avg_loc_churn": "Avg LOC Churn:            ",
    "avg_ast_churn": "Avg AST Churn:            ",
    "avg_complexity_change": "Avg Complexity Change:    ",
}
REPORT_FORMATS = {
    "pct": "%.2f%%", "tokens": "%.0f", "cost": "%.4f", "loc_churn": "%.2f lines (Normalized)",
    "ast_churn": "%.2f nodes (Structural)", "delta": "%+.2f", "rule_rate": "%.1f%%",
}
NOT_AVAILABLE = "N/A"
NO_ATTEMPTS = "N/A (No attempts)"


def render_report(report: DataFrame) -> DataFrame:
    """X11: one formatted ``line`` per report row (an export step; all numbers stay in the other columns)."""
    v, n, d, m = F.col("value"), F.col("numerator"), F.col("denominator"), F.col("metric")
    L, FMT = REPORT_LABELS, REPORT_FORMATS
    pct = F.format_string(FMT["pct"], v)
    ratio = F.format_string("%d/%d", n.cast("bigint"), d.cast("bigint"))
    lbl = lambda k: F.lit(L[k])
    fmt_or = lambda f, alt: F.coalesce(F.format_string(FMT[f], v), F.lit(alt))
    level_lbl = F.concat(F.lit(L["level_success_rate"].split("{}")[0]), F.col("key"),
                         F.lit(L["level_success_rate"].split("{}")[1]))
    line = (
        F.when(F.col("section") == "dataset", F.format_string("%s: %d", m, n.cast("bigint")))
        .when(m == "vuln_fix_rate", F.concat(lbl("vuln_fix_rate"), pct, F.lit(" ("), ratio, F.lit(")")))
        .when(m == "file_remediation_rate",
              F.concat(lbl("file_remediation_rate"), pct, F.lit(" ("), ratio, F.lit(" files clean)")))
        .when(m == "level_success_rate",
              F.when(d == 0, F.concat(level_lbl, F.lit(NO_ATTEMPTS)))
              .otherwise(F.concat(level_lbl, pct, F.lit(" ("), ratio, F.lit(")"))))
        .when(m == "avg_tokens_per_fix", F.concat(lbl("avg_tokens_per_fix"), fmt_or("tokens", "nan")))
        .when(m == "cost_per_fix", F.concat(lbl("cost_per_fix"), F.format_string(FMT["cost"], v)))
        .when(m == "avg_loc_churn", F.concat(lbl("avg_loc_churn"), fmt_or("loc_churn", NOT_AVAILABLE)))
        .when(m == "avg_ast_churn", F.concat(lbl("avg_ast_churn"), fmt_or("ast_churn", NOT_AVAILABLE)))
        .when(m == "avg_complexity_change", F.concat(lbl("avg_complexity_change"), fmt_or("delta", "nan")))
        .when(F.col("section") == "severity", F.concat(F.rpad(F.col("key"), 10, " "), pct))
        .when(F.col("section") == "rule", F.concat(F.rpad(F.col("key"), 20, " "), F.lit(" | "),
                                                    F.format_string(FMT["rule_rate"], v), F.lit("   | "),
                                                    F.rpad(d.cast("bigint").cast("string"), 5, " ")))
    )
    return report.withColumn("line", line)
