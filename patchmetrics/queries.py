"""Registry of keyed queries: each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import audit, report
from .operators.sequence import sequence_within
from .plans import audit_pipeline as ap
from .sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


# ------------------------------------------------------------------ attempts, traces, files
@query("attempt_normalize")
def q_attempt_normalize(spark, sf):
    return audit.normalize_attempts(fixtures.attempts(spark, sf))


@query("attempt_cost")
def q_attempt_cost(spark, sf):
    return ap.priced_attempts(spark, sf).select("file_uid", "vulnerability_id", "attempt_seq", "model",
                                                "pricing_model", "prompt_tokens", "completion_tokens", "cost_usd")


@query("attempt_cost_by_model")
def q_attempt_cost_by_model(spark, sf):
    """S8 + J1 + X8 over the whole rate card: attempts dealt over every listed model and one that is not listed."""
    norm = audit.normalize_attempts(fixtures.attempts(spark, sf))
    models = [m for m, *_ in audit.PRICING_PER_1M] + [fixtures.UNLISTED_MODEL]
    dealt = F.element_at(F.array(*map(F.lit, models)), ((F.col("prompt_tokens") + F.col("attempt_seq")) % len(models) + 1).cast("int"))
    priced = audit.price_attempts(norm.withColumn("model", dealt).withColumn("pricing_model", dealt))
    return priced.groupBy("model").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd"))


@query("attempt_sequence")
def q_attempt_sequence(spark, sf):
    norm = audit.normalize_attempts(fixtures.attempts(spark, sf)).select(
        "file_uid", "vulnerability_id", "level", "attempt_seq")
    return sequence_within(norm, ["file_uid"], ["level", "attempt_seq"], "seq")


@query("attempt_union_levels")
def q_attempt_union_levels(spark, sf):
    """The attempts of two producers (first tries and escalations, priced apart) as one table."""
    norm = audit.normalize_attempts(fixtures.attempts(spark, sf))
    cols = ["file_uid", "vulnerability_id", "attempt_seq", "level", "model", "status", "cost_usd"]
    first = audit.price_attempts(norm.filter(F.col("level") <= 1)).select(*cols)
    return first.unionByName(audit.price_attempts(norm.filter(F.col("level") > 1)).select(*cols))


@query("vuln_trace")
def q_vuln_trace(spark, sf):
    return ap.traces(spark, sf)


@query("vuln_trace_history")
def q_vuln_trace_history(spark, sf):
    """A1 unnested again: one row per attempt with its place in the trace."""
    history = audit.vuln_trace_history(ap.priced_attempts(spark, sf))
    return history.select("file_uid", "vulnerability_id", "first_seq", F.posexplode("attempts").alias("pos", "a")).select(
        "file_uid", "vulnerability_id", "first_seq", "pos", *_attempt_columns("a"))


def _attempt_columns(a: str) -> list:
    return [*[F.col(f"{a}.{c}").alias(c) for c in ("level", "model", "status", "finish_reason", "duration_s", "cost_usd")],
            *[F.col(f"{a}.tokens.{c}").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]]


@query("escalation_routing")
def q_escalation_routing(spark, sf):
    from .operators.cascade import route_leftovers
    norm = audit.normalize_attempts(fixtures.attempts(spark, sf))
    level1 = norm.filter(F.col("level") == 1)
    return route_leftovers(level1, outcome_col="raw_status", next_level=2).select(
        "file_uid", "vulnerability_id", "attempt_seq", "severity", "confidence", "next_level")


@query("file_summary")
def q_file_summary(spark, sf):
    return audit.file_summary(ap.traces(spark, sf), fixtures.file_facts(spark, sf))


@query("audit_log_nested")
def q_audit_log_nested(spark, sf):
    """A10 unnested again: one row per attempt (or per file without any), with its file and trace."""
    log = ap.build_log(spark, sf)
    traces = log.select(F.col("meta.file_uid").alias("file_uid"), F.col("meta.dataset").alias("dataset"),
                        F.col("input_stats.vuln_count").alias("vuln_count"),
                        F.col("security_summary.fixed_count").alias("fixed_count"),
                        F.col("security_summary.new_issues_introduced").alias("new_issues_introduced"),
                        F.col("total_cost_usd").alias("file_cost_usd"), F.posexplode_outer("vulnerabilities").alias("trace_pos", "t"))
    rows = traces.select("*", F.posexplode_outer("t.attempts").alias("pos", "a"))
    return rows.select(*traces.columns[:7], F.col("t.test_id").alias("test_id"), F.col("t.severity").alias("severity"),
                       F.col("t.confidence_score").alias("confidence_score"), F.col("t.status").alias("trace_status"),
                       F.col("t.fixed_at_level").alias("fixed_at_level"),
                       F.col("t.time_to_remediation_s").alias("time_to_remediation_s"),
                       F.col("t.total_cost_usd").alias("trace_cost_usd"), "pos", *_attempt_columns("a"))


@query("audit_log_parts")
def q_audit_log_parts(spark, sf):
    """A1 + A10 in parts of three attempts: the attempts of every part, with the place of the part in its file's chain."""
    from .operators.record_parts import build_audit_log_parts
    parts = build_audit_log_parts(ap.priced_attempts(spark, sf), fixtures.file_facts(spark, sf), part_attempts=3,
                                  timestamp=F.lit("1970-01-01T00:00:00"))
    traces = parts.select(F.col("meta.file_uid").alias("file_uid"), "part", "n_parts", "continues",
                          F.col("input_stats.vuln_count").alias("vuln_count"), F.posexplode_outer("vulnerabilities").alias("trace_pos", "t"))
    return traces.select("file_uid", "part", "n_parts", "continues", "vuln_count", "trace_pos", F.col("t.test_id").alias("test_id"),
                         F.col("t.status").alias("trace_status"), F.size("t.attempts").alias("n_attempts"),
                         F.aggregate("t.attempts", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]["total_tokens"]).alias("total_tokens"))


# ------------------------------------------------------------------ report (C4)
@query("audit_flatten")
def q_audit_flatten(spark, sf):
    return report.flatten(ap.build_log(spark, sf)).drop("vulnerabilities")


@query("audit_dataset_counts")
def q_audit_dataset_counts(spark, sf):
    return report.dataset_counts(report.as_records(ap.long_form(spark, sf)[0]))


@query("valid_file_semi_join")
def q_valid_file_semi_join(spark, sf):
    from .sources.store import materialize
    # Both sides of the join read the files: written once, not built twice.
    files = materialize(ap.long_form(spark, sf)[0].select("file_uid", "vuln_count", "fixed_count", "n_traces"), "files")
    return report.of_valid_files(files, files)


@query("explode_vulnerabilities")
def q_explode_vulnerabilities(spark, sf):
    return report.explode_vulnerabilities(report.valid_entries(ap.build_log(spark, sf)))


@query("explode_attempts")
def q_explode_attempts(spark, sf):
    return report.explode_attempts(report.valid_entries(ap.build_log(spark, sf)))


@query("vuln_fix_rate")
def q_vuln_fix_rate(spark, sf):
    return report.vuln_fix_rate(ap.valid_records(spark, sf))


@query("file_remediation_rate")
def q_file_remediation_rate(spark, sf):
    return report.file_remediation_rate(ap.valid_records(spark, sf))


@query("level_success_rate")
def q_level_success_rate(spark, sf):
    return report.level_success_rate(ap.long_form(spark, sf)[2])


@query("avg_tokens_per_fix")
def q_avg_tokens_per_fix(spark, sf):
    return report.avg_tokens_per_fix(ap.long_form(spark, sf)[2])


@query("cost_per_fix")
def q_cost_per_fix(spark, sf):
    return report.cost_per_fix(ap.valid_records(spark, sf))


@query("avg_churn")
def q_avg_churn(spark, sf):
    return report.avg_churn(ap.valid_records(spark, sf))


@query("before_after_delta")
def q_before_after_delta(spark, sf):
    from .plans.pipelines import before_after
    facts = fixtures.file_facts(spark, sf)
    sides = before_after(facts.select("file_uid", F.col("cc_before").alias("cc")),
                         facts.select("file_uid", F.col("cc_after").alias("cc")))
    valid = audit.file_summary(ap.traces(spark, sf), facts).filter("vuln_count > 0").select("file_uid")
    return report.complexity_delta_of(sides.join(valid, "file_uid", "left_semi"), F.col("cc_before"), F.col("cc_after"))


@query("severity_breakdown")
def q_severity_breakdown(spark, sf):
    return report.severity_breakdown(ap.long_form(spark, sf)[1])


@query("success_by_test_id")
def q_success_by_test_id(spark, sf):
    return report.success_by_test_id(ap.long_form(spark, sf)[1])


@query("kpi_report")
def q_kpi_report(spark, sf):
    return report.kpi_report_flat(*ap.long_form(spark, sf, stored=True))


@query("incremental_report")
def q_incremental_report(spark, sf):
    """S6 + C4: the nested log appended in three batches (each twice), reported from the batches' states."""
    import uuid
    from .session import ensure_checkpoint_dir
    from .sources import log_store
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/audit-log-{uuid.uuid4().hex}"
    # Not stored as a whole beside the batches: the filter of a batch reaches the attempts, so each nests its own files only.
    log = ap.build_log(spark, sf)
    for b in range(3):
        part = log.where(F.pmod(F.col("meta.file_uid").cast("long"), F.lit(3)) == b)
        for _ in range(2):
            log_store.append_batch(part, path, f"batch-{b}")
    return log_store.report_of_batches(spark, path)


@query("kpi_rendered")
def q_kpi_rendered(spark, sf):
    return report.render_report(report.kpi_report_flat(*ap.long_form(spark, sf, stored=True))).select("section", "metric", "key", "line")


# ------------------------------------------------------------------ corpus and text (C1, X-functions)
from .functions import text as T  # noqa: E402
from .operators import churn, context, corpus, findings, pages  # noqa: E402
from .operators.cascade import DEFAULT_PATCH_TEMPLATE, fill_template  # noqa: E402
from .sources.io import ORDER_COLS  # noqa: E402
from .sources.tables import read_table  # noqa: E402


@query("corpus_language_filter")
def q_corpus_language_filter(spark, sf):
    return corpus.filter_language(fixtures.raw_samples(spark, sf), "en").select("doc_id", "lang", "chosen")


@query("corpus_prepare")
def q_corpus_prepare(spark, sf):
    prepared = corpus.prepare_corpus(fixtures.raw_samples(spark, sf, source_order=True), lang="en", code_col="chosen",
                                     order_cols=ORDER_COLS)
    return prepared.select("sample_id", "doc_id", "filename", "code")


@query("fence_strip")
def q_fence_strip(spark, sf):
    return fixtures.raw_samples(spark, sf).select("doc_id", T.strip_fences(F.col("chosen")).alias("code"))


def _fenced_replies(spark, sf):
    c = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    reply = (F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```python\n"), F.col("text"), F.lit("\n```")))
             .when(F.col("turn") % 3 == 1, F.concat(F.lit("  ```"), F.col("text"), F.lit("```  ")))
             .otherwise(F.col("text")))
    return c.filter(F.col("role") == "assistant").select("conv_id", "turn", reply.alias("reply"))


@query("reply_fence_clean")
def q_reply_fence_clean(spark, sf):
    return _fenced_replies(spark, sf).select("conv_id", "turn", T.clean_reply(F.col("reply")).alias("code"))


@query("split_lines")
def q_split_lines(spark, sf):
    return context.explode_lines(read_table(spark, sf, "documents", ["doc_id", "text"]), keepends=True)


@query("word_count")
def q_word_count(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query("systematic_sample")
def q_systematic_sample(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "lang", "source", "n_chars"])
    return corpus.systematic_sample(d, "doc_id", 0, 420, 5)


@query("url_version_rewrite")
def q_url_version_rewrite(spark, sf):
    p = read_table(spark, sf, "pages", ["page_id", "url"])
    return p.select("page_id", "url", T.rewrite_doc_version(F.col("url")).alias("doc_url"))


@query("props_json_field")
def q_props_json_field(spark, sf):
    e = read_table(spark, sf, "events", ["event_id", "props"])
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"))


# ------------------------------------------------------------------ findings
@query("scan_report_explode")
def q_scan_report_explode(spark, sf):
    ex = findings.explode_scan_report(fixtures.scan_reports(spark, sf))
    return ex.withColumn("line_range", F.array_join(F.col("line_range").cast("array<string>"), ","))


@query("finding_first_line")
def q_finding_first_line(spark, sf):
    return findings.first_line_projection(findings.explode_scan_report(fixtures.scan_reports(spark, sf)))


@query("rule_scan_findings")
def q_rule_scan_findings(spark, sf):
    return fixtures.rule_findings(spark, sf)


@query("rule_catalogue_scan")
def q_rule_catalogue_scan(spark, sf):
    """J11 with hundreds to thousands of rules: findings per rule and document, through the literal index."""
    from .operators.rule_index import scan_lines_indexed
    found = scan_lines_indexed(fixtures.doc_lines(spark, sf), fixtures.rule_catalogue(spark, sf))
    return found.groupBy("doc_id", "test_id").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"))


@query("findings_per_doc")
def q_findings_per_doc(spark, sf):
    after = fixtures.rule_findings(spark, sf, fixtures.edited_lines(spark, sf))
    return findings.findings_per_doc(after, read_table(spark, sf, "documents", ["doc_id"]))


@query("verify_patch")
def q_verify_patch(spark, sf):
    before = fixtures.rule_findings(spark, sf)
    after = fixtures.rule_findings(spark, sf, fixtures.edited_lines(spark, sf))
    return findings.verify_findings(before, after)


@query("finding_doc_join")
def q_finding_doc_join(spark, sf):
    p = read_table(spark, sf, "pages", ["page_id", "url", "html"])
    f = p.select(F.col("page_id").alias("finding_id"),
                 F.when(F.col("page_id") % 10 == 0, F.lit(None)).otherwise(F.col("url")).alias("more_info_url"))
    docs = p.select("url", pages.h1_headings("html").alias("text"))
    return findings.attach_docs(f, docs)


# ------------------------------------------------------------------ context
_FKEYS = ["doc_id", "line_no", "test_id"]


def _keepends_lines(spark, sf):
    return context.explode_lines(read_table(spark, sf, "documents", ["doc_id", "text"]), keepends=True)


@query("innermost_span")
def q_innermost_span(spark, sf):
    return context.innermost_span(fixtures.rule_findings(spark, sf), fixtures.nested_spans(spark, sf))


@query("line_window_context")
def q_line_window_context(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return context.line_window_context(fixtures.rule_findings(spark, sf), _keepends_lines(spark, sf), _FKEYS,
                                       counts=context.document_line_counts(d))


@query("line_window_frame")
def q_line_window_frame(spark, sf):
    return context.line_window_frame(_keepends_lines(spark, sf))


@query("function_context")
def q_function_context(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return context.function_or_window_context(fixtures.rule_findings(spark, sf), fixtures.nested_spans(spark, sf),
                                              _keepends_lines(spark, sf), _FKEYS,
                                              counts=context.document_line_counts(d))


@query("function_spans")
def q_function_spans(spark, sf):
    """functions of documents in the form of source code, from their line tables."""
    from .operators.spans import function_spans
    return function_spans(fixtures.source_lines(spark, sf))


@query("function_span_context")
def q_function_span_context(spark, sf):
    """F1 + J5: the innermost function around every tenth line of those documents."""
    from .operators.intervals import innermost_span
    from .operators.spans import function_spans
    lines = fixtures.source_lines(spark, sf)
    asked = lines.where("line_no % 10 = 3").select("doc_id", "line_no")
    return innermost_span(asked, function_spans(lines))


# ------------------------------------------------------------------ churn and code statistics
@query("multiset_line_churn")
def q_multiset_line_churn(spark, sf):
    return churn.multiset_line_churn(fixtures.doc_lines(spark, sf), fixtures.edited_lines(spark, sf))


@query("ordered_line_churn")
def q_ordered_line_churn(spark, sf):
    """ordered churn of documents against a version with deleted, changed and moved lines."""
    from .operators.line_diff import line_churn
    return line_churn(fixtures.doc_lines(spark, sf), fixtures.moved_lines(spark, sf))


@query("code_stats")
def q_code_stats(spark, sf):
    return churn.code_stats(fixtures.code_blocks(spark, sf), fixtures.doc_lines(spark, sf))


# ------------------------------------------------------------------ pages
@query("page_headings")
def q_page_headings(spark, sf):
    p = read_table(spark, sf, "pages", ["page_id", "html"])
    return p.select("page_id", pages.h1_headings("html").alias("headings"))


@query("page_text_extract")
def q_page_text_extract(spark, sf):
    p = read_table(spark, sf, "pages", ["page_id", "url", "html"])
    return p.select("page_id", "url", pages.article_text("html").alias("text"))


# ------------------------------------------------------------------ prompts and replies
def _turns(spark, sf):
    return read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])


@query("prompt_projection")
def q_prompt_projection(spark, sf):
    c = _turns(spark, sf)
    user = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("code_snippet"))
    plan = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("fix_strategy"))
    j = user.join(plan, ["conv_id", "turn"], "inner")
    return j.select("conv_id", "turn", fill_template(DEFAULT_PATCH_TEMPLATE, code_snippet=F.col("code_snippet"),
                                                     fix_strategy=F.col("fix_strategy")).alias("prompt"))


@query("plan_prompts")
def q_plan_prompts(spark, sf):
    """Findings with their line windows and documentation as plan prompts; the replies are the prompts themselves."""
    from .operators.cascade import plan_findings
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    p = read_table(spark, sf, "pages", ["page_id", "url", "html"])
    found = fixtures.rule_findings(spark, sf)
    contexts = context.line_window_context(found, _keepends_lines(spark, sf), _FKEYS, counts=context.document_line_counts(d))
    linked = found.join(p.select(F.col("page_id").alias("doc_id"), F.col("url").alias("more_info_url")), "doc_id", "left")
    docs = p.select("url", pages.h1_headings("html").alias("text"))
    planned = plan_findings(linked, contexts.select(*_FKEYS, "code"), docs,
                            lambda prompts: prompts.select(*_FKEYS, F.col("prompt").alias("reply")), _FKEYS)
    return planned.select(*_FKEYS, "severity", "strategy")


@query("attach_responses")
def q_attach_responses(spark, sf):
    from .operators.cascade import attach_responses
    c = _turns(spark, sf)
    prompts = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    replies = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return attach_responses(prompts, replies, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.length("prompt").alias("prompt_chars"), "reply", "reply_clean")


@query("answer_distinct_prompts")
def q_answer_distinct_prompts(spark, sf):
    """J8 + F7: the texts of all turns as prompts, each distinct one answered once and joined back; then asked again."""
    import uuid
    from .operators.replies import answer_once
    from .session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/answers-{uuid.uuid4().hex}"
    requests = _turns(spark, sf).select("conv_id", "turn", F.col("text").alias("prompt"))

    def responder(prompts):
        return prompts.select("digest", F.concat(F.lit("answer to: "), F.substring("prompt", 1, 40)).alias("reply"),
                              F.lit("stop").alias("finish_reason"), F.length("prompt").cast("long").alias("prompt_tokens"),
                              F.lit(1).cast("long").alias("completion_tokens"), F.lit(0.5).alias("duration_s"))

    answer_once(requests.where("turn % 2 = 0"), responder, path)
    return answer_once(requests, responder, path).drop("prompt")


# ------------------------------------------------------------------ splicing and the cascade
def _codes(spark, sf):
    return read_table(spark, sf, "documents", ["doc_id", "text"]).withColumnRenamed("text", "code")


@query("apply_patches")
def q_apply_patches(spark, sf):
    from .operators.cascade import apply_patches
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    patches = fixtures.numbered_findings(spark, sf, with_line=True).select(
        "doc_id", F.col("finding_id").alias("patch_seq"), F.col("line_num").alias("start_line"),
        F.col("line_num").alias("end_line"), F.translate("line", lower, upper).alias("block"))
    return apply_patches(_codes(spark, sf), patches, mode="original").withColumn("n_skipped", F.size("skipped")).drop("skipped")


@query("splice_line_table")
def q_splice_line_table(spark, sf):
    """X7 on line tables: overlapping, superseded and inserting edits of whole documents."""
    from .operators.splice import splice_lines
    return splice_lines(_keepends_lines(spark, sf), fixtures.line_edits(spark, sf))[0]


def _cascade(spark, sf, **options):
    from .operators.cascade import remediate
    rule_table = fixtures.rules(spark)

    def rescan(patched):
        return findings.scan_lines(context.explode_lines(patched, "code", keepends=False), rule_table)

    attempts, _docs, _left = remediate(_codes(spark, sf), fixtures.numbered_findings(spark, sf), fixtures.fixture_replies,
                                       rescan, models={1: fixtures.LEVEL1_MODEL, 2: fixtures.LEVEL2_MODEL}, **options)
    return attempts


@query("remediation_cascade")
def q_remediation_cascade(spark, sf):
    """One-line contexts, as the oracle has them; ``remediation_cascade_window`` runs the operator's own window."""
    return _cascade(spark, sf, window=0)


@query("remediation_cascade_window")
def q_remediation_cascade_window(spark, sf):
    return _cascade(spark, sf)
