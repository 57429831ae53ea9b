"""Audit log: normalise and price attempts, fold them into per-finding traces and per-file records.

Raw attempt columns (any extra columns are ignored)::

    file_uid, vulnerability_id, attempt_seq, level_attempted, model, status, finish_reason,
    prompt_tokens, completion_tokens, total_tokens, llm_time_taken, severity, confidence

``attempt_seq`` is the attempt's position in the file's attempt list (level-1 results precede level-2); every
first/last rule below is ``min_by``/``max_by`` on it, so no list order is ever assumed. A ``token_usage`` map
column may replace the three token columns (``tokens_from_usage_map``).

Metric rules kept from the reference (documented choices, see README):

* traces group by ``(file_uid, vulnerability_id)`` -- two findings of one rule in a file share a trace (D1);
* errored attempts are neither fixed nor leftover, so they never count in ``vuln_count`` (D2);
  ``errored_count`` is reported alongside;
* ``syntax`` anywhere in ``finish_reason`` turns even a success into ``SYNTAX_ERROR`` (D3);
* money is ``DECIMAL(18,6)``, each attempt rounded HALF_UP, sums of rounded values (D7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import COST_TYPE, RATE_TYPE, attempt_cost

# USD per 1M tokens (input, output) per model, as published by the reference.
PRICING_PER_1M = [
    ("alibaba-qwen3-32b", "0.250", "0.550"),
    ("deepseek-r1-distill-llama-70b", "0.990", "0.990"),
    ("gemini-3-pro-preview", "2.00", "12.00"),
    ("gemini-3-flash-preview", "0.50", "3.00"),
    ("gpt-5.1", "1.25", "10.00"),
    ("gpt-5.2", "1.75", "14.00"),
    ("gpt-5-mini", "0.250", "2.00"),
]

# Defaults of the reference's attempt record.
DEFAULT_VID = "UNKNOWN"
DEFAULT_MODEL = "unknown"
STATUS_SUCCESS, STATUS_FAILED, STATUS_SYNTAX = "SUCCESS", "FAILED", "SYNTAX_ERROR"
TRACE_FIXED, TRACE_FAILED = "FIXED", "FAILED"
RAW_ERROR = "error"
LAST_LEVEL = 2            # level whose failures stay unresolved (the default cascade has two levels)


def pricing_table(spark: SparkSession, rows=None) -> DataFrame:
    """``model string, input decimal(9,3), output decimal(9,3)``."""
    rows = PRICING_PER_1M if rows is None else rows
    df = spark.createDataFrame([(m, str(i), str(o)) for m, i, o in rows], "model string, input string, output string")
    return df.select("model", F.col("input").cast(RATE_TYPE).alias("input"),
                     F.col("output").cast(RATE_TYPE).alias("output"))


def tokens_from_usage_map(df: DataFrame, col: str = "token_usage") -> DataFrame:
    """Flatten a ``map<string,bigint>`` token column to the three token columns (missing keys -> null -> 0)."""
    m = F.col(col)
    return (df.withColumn("prompt_tokens", F.try_element_at(m, F.lit("prompt_tokens")))
            .withColumn("completion_tokens", F.try_element_at(m, F.lit("completion_tokens")))
            .withColumn("total_tokens", F.try_element_at(m, F.lit("total_tokens")))
            .drop(col))


def normalized_status(status: Column, finish_reason: Column) -> Column:
    """Upper-case; ``SUCCESS`` else ``FAILED``; any ``syntax`` in finish_reason overrides to ``SYNTAX_ERROR``."""
    syntax = F.lower(F.coalesce(finish_reason, F.lit(""))).contains("syntax")
    ok = F.upper(F.coalesce(status, F.lit("failed"))) == STATUS_SUCCESS
    return (F.when(syntax, F.lit(STATUS_SYNTAX)).when(ok, F.lit(STATUS_SUCCESS))
            .otherwise(F.lit(STATUS_FAILED)))


def normalize_attempts(raw: DataFrame) -> DataFrame:
    """P11 + P12: one row per attempt with defaults applied and the normalised status."""
    c = F.col
    return raw.select(
        "file_uid",
        F.coalesce(c("vulnerability_id"), F.lit(DEFAULT_VID)).alias("vulnerability_id"),
        c("attempt_seq").cast("bigint").alias("attempt_seq"),
        F.coalesce(c("level_attempted"), F.lit(1)).cast("int").alias("level"),
        F.coalesce(c("model"), F.lit(DEFAULT_MODEL)).alias("model"),
        F.coalesce(c("model"), F.lit("")).alias("pricing_model"),
        c("status").alias("raw_status"),
        normalized_status(c("status"), c("finish_reason")).alias("status"),
        c("finish_reason"),
        F.coalesce(c("llm_time_taken"), F.lit(0)).alias("duration_s"),
        F.coalesce(c("prompt_tokens"), F.lit(0)).cast("bigint").alias("prompt_tokens"),
        F.coalesce(c("completion_tokens"), F.lit(0)).cast("bigint").alias("completion_tokens"),
        F.coalesce(c("total_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.coalesce(c("severity"), F.lit(DEFAULT_VID)).alias("severity"),
        F.coalesce(c("confidence"), F.lit(DEFAULT_VID)).alias("confidence"),
    )


def price_attempts(norm: DataFrame, pricing=None) -> DataFrame:
    """J1 + X8: left lookup of the model's rates (unknown model -> 0) and the exact attempt cost.

    ``pricing`` is a rate card: ``None`` (the built-in seven models), a list of ``(model, input, output)`` rows,
    or a DataFrame with ``model, input, output``. Rows are bounded by construction and broadcast; how a DataFrame is
    joined is left to Spark's size rules.
    """
    card = pricing if isinstance(pricing, DataFrame) else F.broadcast(pricing_table(norm.sparkSession, pricing))
    rates = card.select(F.col("model").alias("pricing_model"), F.col("input").alias("_rate_in"),
                        F.col("output").alias("_rate_out"))
    joined = norm.join(rates, "pricing_model", "left")
    return (joined.withColumn("cost_usd", attempt_cost(F.col("prompt_tokens"), F.col("completion_tokens"),
                                                       F.col("_rate_in"), F.col("_rate_out")))
            .drop("_rate_in", "_rate_out"))


def _is_success() -> Column:
    return F.col("status") == STATUS_SUCCESS


def trace_aggregates(last_level: int = LAST_LEVEL) -> list[Column]:
    """A2-A6 as partial-aggregatable expressions (map-side combine; a hot trace never gathers its rows).

    ``n_leftover`` counts finding instances, not rules: every attempt that failed at the last level is one unresolved
    finding, also when another finding of its rule was fixed. In a trace that never reached the last level (a run of
    fewer levels) every failed attempt is.
    """
    failed = F.coalesce(F.col("raw_status").startswith("failed"), F.lit(False))
    at_last = failed & (F.col("level") >= last_level)
    ok = _is_success()
    return [
        F.min_by("severity", "attempt_seq").alias("severity"),
        F.min_by("confidence", "attempt_seq").alias("confidence_score"),
        F.max(ok.cast("int")).alias("_fixed"),
        F.max_by(F.when(ok, F.col("level")), F.when(ok, F.col("attempt_seq"))).alias("fixed_at_level"),
        F.sum("duration_s").alias("_duration"),
        F.sum("cost_usd").cast(COST_TYPE).alias("total_cost_usd"),
        F.min("attempt_seq").alias("first_seq"),
        F.count(F.lit(1)).alias("n_attempts"),
        F.max_by("raw_status", "attempt_seq").alias("last_raw_status"),
        F.when(F.max("level") >= last_level, F.count_if(at_last)).otherwise(F.count_if(failed)).alias("n_leftover"),
    ]


def _finish_trace(df: DataFrame) -> DataFrame:
    return (df.withColumn("status", F.when(F.col("_fixed") == 1, F.lit(TRACE_FIXED)).otherwise(F.lit(TRACE_FAILED)))
            .withColumn("time_to_remediation_s", F.col("_duration").cast("double"))
            .withColumn("is_leftover", (F.col("status") == TRACE_FAILED)
                        & F.coalesce(F.col("last_raw_status").startswith("failed"), F.lit(False)))
            .withColumn("is_errored", (F.col("status") == TRACE_FAILED)
                        & F.coalesce(F.col("last_raw_status") == RAW_ERROR, F.lit(False)))
            .drop("_fixed", "_duration"))


def vuln_traces(priced: DataFrame) -> DataFrame:
    """A2-A6 flat: one row per ``(file_uid, vulnerability_id)``."""
    agg = priced.groupBy("file_uid", "vulnerability_id").agg(*trace_aggregates())
    return _finish_trace(agg)


def vuln_trace_history(priced: DataFrame) -> DataFrame:
    """A1: per trace, its attempts in attempt order (``array<struct>``) -- the nested log's inner list."""
    return priced.groupBy("file_uid", "vulnerability_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("attempt_seq", attempt_struct().alias("a")))),
                    lambda x: x["a"]).alias("attempts"),
        F.min("attempt_seq").alias("first_seq"))


def attempt_struct() -> Column:
    return F.struct(
        F.col("level").alias("level"), F.col("model").alias("model"), F.col("status").alias("status"),
        F.col("finish_reason").alias("finish_reason"), F.col("duration_s").cast("double").alias("duration_s"),
        F.col("cost_usd").alias("cost_usd"),
        F.struct(F.col("prompt_tokens").alias("prompt_tokens"), F.col("completion_tokens").alias("completion_tokens"),
                 F.col("total_tokens").alias("total_tokens")).alias("tokens"))


def file_rollup(traces: DataFrame) -> DataFrame:
    """A7 + leftover instances and errored traces per file (partial aggregation; one row per file)."""
    return traces.groupBy("file_uid").agg(
        F.sum("total_cost_usd").cast(COST_TYPE).alias("total_cost_usd"),
        F.count_if(F.col("status") == TRACE_FIXED).alias("fixed_count"),
        F.sum("n_leftover").alias("leftover_count"),
        F.count_if("is_errored").alias("errored_count"),
        F.count(F.lit(1)).alias("n_traces"))


def with_leftovers(per_file: DataFrame, leftovers: DataFrame | None) -> DataFrame:
    """Replace ``leftover_count`` by the rows per ``file_uid`` of ``leftovers`` (one row per unresolved finding)."""
    if leftovers is None:
        return per_file
    n = leftovers.groupBy("file_uid").agg(F.count(F.lit(1)).alias("_left"))
    return (per_file.join(n, "file_uid", "full_outer")
            .withColumn("leftover_count", F.coalesce(F.col("_left"), F.lit(0))).drop("_left"))


def file_summary(traces: DataFrame, facts: DataFrame, leftovers: DataFrame | None = None) -> DataFrame:
    """A7 + A8 for every file in ``facts`` (files without attempts get zero counts).

    ``vuln_count = fixed + leftovers``; ``new_issues_introduced = vuln_count_after - vuln_count + fixed``. Leftovers
    are finding instances: the rows of ``leftovers(file_uid, ...)`` if given, else the attempts that failed at the
    last level.
    """
    roll = with_leftovers(file_rollup(traces), leftovers)
    j = facts.select("file_uid", "vuln_count_after").join(roll, "file_uid", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return j.select(
        "file_uid",
        (z("fixed_count") + z("leftover_count")).alias("vuln_count"),
        z("fixed_count").alias("fixed_count"), z("leftover_count").alias("leftover_count"),
        z("errored_count").alias("errored_count"),
        (F.col("vuln_count_after").cast("bigint") - z("leftover_count")).alias("new_issues_introduced"),
        F.coalesce(F.col("total_cost_usd"), F.lit(0).cast(COST_TYPE)).alias("total_cost_usd"),
        z("n_traces").alias("n_traces"))


def build_audit_log(priced: DataFrame, facts: DataFrame, dataset: str | None = None,
                    implementation_version: str = "v1.0.0", language: str = "python",
                    timestamp: Column | None = None, pipeline_duration: Column | None = None,
                    leftovers: DataFrame | None = None) -> DataFrame:
    """One nested record per file (schema of ``schemas.AUDIT_LOG_DDL``).

    ``facts`` carries per-file code statistics: ``file_uid, loc_before, loc_after, cc_before, cc_after,
    normalized_loc_churn, ast_churn, vuln_count_after`` and optionally ``dataset`` and ``duration_s``.
    Constant metadata columns come from parameters (P18); the timestamp is stamped once per batch unless given.
    The attempts are shuffled once, as narrow rows by ``file_uid``, and nested there; the nested list of a file is its
    own output record, so its size is that file's number of findings and attempts.
    """
    of_file = priced.repartition("file_uid")
    per_trace = of_file.groupBy("file_uid", "vulnerability_id").agg(
        *trace_aggregates(),
        F.collect_list(F.struct("attempt_seq", attempt_struct().alias("a"))).alias("_atts"))
    per_trace = _finish_trace(per_trace)
    trace = F.struct(
        F.col("vulnerability_id").alias("test_id"), "severity", "confidence_score", "status", "fixed_at_level",
        "time_to_remediation_s", "total_cost_usd",
        F.transform(F.array_sort("_atts"), lambda x: x["a"]).alias("attempts"))
    per_file = per_trace.groupBy("file_uid").agg(
        F.sum("total_cost_usd").cast(COST_TYPE).alias("total_cost_usd"),
        F.count_if(F.col("status") == TRACE_FIXED).alias("fixed_count"),
        F.sum("n_leftover").alias("leftover_count"),
        F.collect_list(F.struct(F.col("first_seq"), trace.alias("t"))).alias("_traces"))
    j = facts.join(with_leftovers(per_file, leftovers), "file_uid", "left")
    return j.select(*record_columns(facts.columns, F.transform(F.array_sort("_traces"), lambda x: x["t"]), dataset,
                                    implementation_version, language, timestamp, pipeline_duration))


def record_columns(fact_columns: list[str], vulnerabilities: Column, dataset: str | None = None,
                   implementation_version: str = "v1.0.0", language: str = "python", timestamp: Column | None = None,
                   pipeline_duration: Column | None = None) -> list[Column]:
    """The columns of an audit record over file facts joined with the roll-up of the file's traces."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    vuln_count = z("fixed_count") + z("leftover_count")
    ts = timestamp if timestamp is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    ds = F.lit(dataset) if dataset is not None else (F.col("dataset") if "dataset" in fact_columns else F.lit(""))
    dur = pipeline_duration if pipeline_duration is not None else (
        F.col("duration_s").cast("double") if "duration_s" in fact_columns else F.lit(0.0))
    return [
        F.struct(F.col("file_uid").cast("string").alias("file_uid"), ds.alias("dataset"),
                 F.lit(implementation_version).alias("implementation_version"), ts.alias("timestamp"),
                 dur.alias("total_pipeline_duration_s")).alias("meta"),
        F.struct(F.col("loc_before").cast("bigint").alias("loc"),
                 F.col("cc_before").cast("double").alias("avg_cyclomatic_complexity"),
                 vuln_count.alias("vuln_count")).alias("input_stats"),
        F.lit(language).alias("language"),
        F.struct(z("fixed_count").alias("fixed_count"),
                 (F.col("vuln_count_after").cast("bigint") - z("leftover_count")).alias("new_issues_introduced"),
                 F.struct(F.col("loc_after").cast("bigint").alias("loc"),
                          F.col("cc_after").cast("double").alias("avg_cyclomatic_complexity"),
                          F.col("vuln_count_after").cast("bigint").alias("vuln_count")).alias("final_code_stats"),
                 F.col("normalized_loc_churn").cast("bigint").alias("normalized_loc_churn"),
                 F.col("ast_churn").cast("bigint").alias("ast_churn")).alias("security_summary"),
        F.coalesce(F.col("total_cost_usd"), F.lit(0).cast(COST_TYPE)).alias("total_cost_usd"),
        F.coalesce(vulnerabilities, F.array().cast(f"array<{_trace_ddl()}>")).alias("vulnerabilities")]


def _trace_ddl() -> str:
    from ..schemas import TRACE_DDL
    return TRACE_DDL


def long_form_log(priced: DataFrame, facts: DataFrame, leftovers: DataFrame | None = None,
                  traces: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The audit log in long form -- ``(files, vulns, attempts)`` -- built only with map-side-combined aggregates.

    Same content as ``build_audit_log`` without nesting, so a file holding a third of all attempts never becomes
    one giant record; feed it to ``report.kpi_report_flat(..., restrict_to_valid=True)``. ``traces`` are those of
    ``vuln_traces(priced)`` if the caller has them already.
    """
    traces = vuln_traces(priced) if traces is None else traces
    summary = file_summary(traces, facts, leftovers)
    files = summary.join(facts.select("file_uid", "normalized_loc_churn", "ast_churn", "cc_before", "cc_after"),
                         "file_uid").select(
        F.col("file_uid").cast("string").alias("file_uid"), "vuln_count", "fixed_count", "n_traces", "total_cost_usd",
        F.col("normalized_loc_churn").cast("bigint").alias("normalized_loc_churn"),
        F.col("ast_churn").cast("bigint").alias("ast_churn"),
        F.col("cc_before").cast("double").alias("cc_before"), F.col("cc_after").cast("double").alias("cc_after"))
    vulns = traces.select(F.col("file_uid").cast("string").alias("file_uid"),
                          F.col("vulnerability_id").alias("test_id"), "severity", "status")
    attempts = priced.select(F.col("file_uid").cast("string").alias("file_uid"),
                             F.col("vulnerability_id").alias("test_id"), "level", "status", "total_tokens")
    return files, vulns, attempts
