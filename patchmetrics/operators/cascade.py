"""Remediation cascade as DataFrame steps (C2): prompts, replies, splices, verification, routing.

The reference walks one file at a time through a two-level loop; here each level is one set of joins over all
files at once, keyed by ``doc_id`` and a finding id. Model replies are data (a responses table, or a user batch
function run with ``mapInPandas``); nothing here calls a service.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW_SUCCESS, RAW_ERROR = "success", "error"


def raw_status_for_level(level: int) -> str:
    """Raw status of an attempt that ran but did not verify at ``level``."""
    return f"failed_level_{level}"


def route_leftovers(attempts: DataFrame, outcome_col: str = "raw_status", next_level: int = 2) -> DataFrame:
    """P13 + P14 + U2: findings to escalate after a level -- processed minus fixed minus errored.

    The outcome is a column of each attempt row, so the set difference is one narrow filter (no join, no
    shuffle); an empty input simply yields an empty output (no driver-side branch).
    """
    out = F.col(outcome_col)
    leftover = ~(out == RAW_SUCCESS) & ~(out == RAW_ERROR) & out.isNotNull()
    return attempts.filter(leftover).withColumn("next_level", F.lit(next_level))


def fill_template(template: str, **fields: Column) -> Column:
    """Substitute ``{name}`` placeholders of a caller-supplied template with columns (``concat``, JVM-side)."""
    import string

    pieces: list[Column] = []
    for literal, name, _spec, _conv in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            if name not in fields:
                raise KeyError(f"template placeholder {{{name}}} has no column")
            pieces.append(F.coalesce(fields[name].cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


# Default patch prompt (our own wording; callers pass their own template with the same placeholders).
DEFAULT_PATCH_TEMPLATE = (
    "Fix the security issue in the code below without changing what it does.\n\n"
    "CODE:\n{code_snippet}\n\nISSUE AND STRATEGY:\n{fix_strategy}\n\n"
    "Answer with the corrected code only."
)

# Default plan prompt (our own wording).
DEFAULT_PLAN_TEMPLATE = (
    "Plan how to remove the issue below. Describe the change in a few steps, without code.\n\n"
    "ISSUE: {issue}\n\nDOCUMENTATION:\n{documentation}\n\nCODE:\n{code_snippet}\n"
)


def attach_responses(prompts: DataFrame, responses: DataFrame, keys, reply_col: str = "reply") -> DataFrame:
    """Left join of each request to its reply (null when the reply is missing) and the X2 clean-up."""
    from ..functions.text import clean_reply
    return prompts.join(responses, list(keys), "left").withColumn("reply_clean", clean_reply(F.col(reply_col)))


def respond_with(prompts: DataFrame, responder, schema: str) -> DataFrame:
    """bring-your-own responder, called on Arrow batches of prompts (``mapInPandas``)."""
    return prompts.mapInPandas(responder, schema)


# ---------------------------------------------------------------------------------------------- X7: splicing
def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def apply_patches(docs: DataFrame, patches: DataFrame, key: str = "doc_id", code_col: str = "code",
                  order_col: str = "patch_seq", mode: str = "original") -> DataFrame:
    """X7 over many documents: splice patches ``(key, order_col, start_line, end_line, block)`` into their document.

    ``mode="sequential"`` (reference behaviour, D6): patches in ``order_col`` order, line numbers never re-based,
    each block stays ONE list element (so a multi-line block shifts later indices). ``mode="original"``: line numbers
    are those of the input. Of several edits of one range the last in order wins; an edit that partly overlaps one
    that starts before it is left out and listed in ``skipped``, so no line outside an edited range is ever lost.
    Blocks get a trailing newline if they lack one.

    For texts of which each fits a row; ``operators.splice`` does the same on line tables, for documents of any size.
    Patches are collected per document; the original mode walks once over them and the lines, the sequential mode folds
    them. Documents without a patch pass through. Output: ``key, code, n_patches`` (applied edits)``, overlapping, skipped``
    (``order_col`` of the edits left out) ``, wiped`` (P20, the result is empty).
    """
    from ..functions.text import ensure_trailing_newline, split_lines_keepends, splice_lines

    if mode not in ("original", "sequential"):
        raise ValueError("mode must be 'original' or 'sequential'")
    order_type = patches.schema[order_col].dataType.simpleString()
    if mode == "original":
        last = F.struct(F.col(order_col).alias("o"), F.col("block").alias("b"))
        ranges = patches.groupBy(key, F.col("start_line").alias("s"), F.col("end_line").alias("e")).agg(
            F.max(last).alias("w"))
        p = F.struct("s", "e", F.col("w.o").alias("o"), F.col("w.b").alias("b"))
        per_doc = ranges.groupBy(key).agg(F.array_sort(F.collect_list(p)).alias("_p"))
    else:
        p = F.struct(F.col(order_col).alias("o"), F.col("start_line").alias("s"), F.col("end_line").alias("e"),
                     F.col("block").alias("b"))
        per_doc = patches.groupBy(key).agg(F.array_sort(F.collect_list(p)).alias("_p"))
    kind = per_doc.schema["_p"].dataType.simpleString()
    j = docs.select(key, code_col).join(per_doc, key, "left").withColumn(
        "_p", F.coalesce(F.col("_p"), F.array().cast(kind)))
    lines = split_lines_keepends(F.coalesce(F.col(code_col), F.lit("")))
    if mode == "original":
        # Applied edits in order, each with the end of the one before it, and the order numbers of those left out.
        used = f"struct<s:{_type(patches, 'start_line')},e:{_type(patches, 'end_line')},b:string,after:{_type(patches, 'end_line')}>"
        start = F.struct(F.array().cast(f"array<{used}>").alias("use"), F.array().cast(f"array<{order_type}>").alias("skip"))

        def choose(acc, x):
            end = F.try_element_at(acc["use"], F.lit(-1))["e"]
            fits = end.isNull() | (end < x["s"])
            one = F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["b"].alias("b"), F.coalesce(end, F.lit(0)).alias("after")))
            return F.struct(F.when(fits, F.concat(acc["use"], one)).otherwise(acc["use"]).alias("use"),
                            F.when(fits, acc["skip"]).otherwise(F.concat(acc["skip"], F.array(x["o"]))).alias("skip"))

        j = j.withColumn("_c", F.aggregate("_p", start, choose)).withColumn("_lines", lines)
        kept = lambda a, b: F.slice("_lines", a + 1, F.greatest(F.least(b, F.size("_lines")) - a, F.lit(0)))
        before = F.transform("_c.use", lambda x: F.concat(kept(x["after"], x["s"] - 1), F.array(ensure_trailing_newline(x["b"]))))
        end = F.coalesce(F.try_element_at("_c.use", F.lit(-1))["e"], F.lit(0))
        folded = F.concat(F.flatten(before), kept(end, F.size("_lines")))
    else:
        j = j.withColumn("_c", F.struct(F.col("_p").alias("use"), F.array().cast(f"array<{order_type}>").alias("skip")))
        folded = F.aggregate(F.col("_c.use"), lines, lambda acc, x: splice_lines(acc, x["s"], x["e"], x["b"]))
    out = j.select(key, F.when(F.size("_p") == 0, F.coalesce(F.col(code_col), F.lit("")))
                   .otherwise(F.array_join(folded, "")).alias(code_col),
                   F.size("_c.use").alias("n_patches"), (F.size("_c.skip") > 0).alias("overlapping"),
                   F.col("_c.skip").alias("skipped"))
    return out.withColumn("wiped", F.length(F.col(code_col)) == 0)


# ---------------------------------------------------------------------------------------------- C2: the cascade
def plan_findings(findings: DataFrame, contexts: DataFrame, pages: DataFrame, replies, finding_keys,
                  template: str = DEFAULT_PLAN_TEMPLATE, url_col: str = "more_info_url") -> DataFrame:
    """The plan stage: findings with their context and documentation become plan prompts, plan replies ``strategy``.

    ``contexts``: ``finding_keys, code``; ``pages``: ``url, text`` (J4); ``replies``: a DataFrame ``finding_keys,
    reply`` or a function from the prompt table to one. A finding without a reply keeps a null strategy.
    """
    from ..functions.text import clean_reply
    from .findings import attach_docs

    keys = list(finding_keys)
    known = attach_docs(findings, pages, url_col).join(contexts.select(*keys, "code"), keys, "left")
    prompts = known.withColumn("prompt", fill_template(template, code_snippet=F.col("code"), issue=F.col("test_id"),
                                                       documentation=F.col("scraped")))
    got = replies if isinstance(replies, DataFrame) else replies(prompts)
    out = known.drop("code", "scraped", "doc_url").join(got.select(*keys, F.col("reply").alias("_plan")), keys, "left")
    return out.withColumn("strategy", clean_reply(F.col("_plan"))).drop("_plan")


def remediate(docs: DataFrame, findings: DataFrame, responder, rescan, levels=(1, 2), models=None,
              template: str = DEFAULT_PATCH_TEMPLATE, mode: str = "original", key: str = "doc_id",
              code_col: str = "code", spans=None, window: int = 5):
    """Batch remediation cascade over all documents at once.

    ``findings``: ``key, finding_id, test_id, line_num, severity, confidence`` and any further columns (a plan in
    ``strategy``, see ``plan_findings``); all of them travel through every level and into the leftovers.
    ``responder``: replies ``key, finding_id, level, reply, finish_reason, prompt_tokens, completion_tokens,
    duration_s`` as a DataFrame, or a function from the prompt table (finding columns, ``level``, ``prompt``,
    ``code_snippet``) to one; ``respond_with`` wraps a batch function (F7). ``rescan``: ``DataFrame(key, code) ->
    DataFrame(key, test_id)``, or a pair of it and ``DataFrame(key, rescan_ok)``. ``spans``: function from the code
    table to ``DataFrame(key, start_line, end_line)`` of functions; without one the context is the line window.

    Per level: context (innermost function else +-``window`` lines, J5/J6) -> prompt (X14) -> reply (J8/F7) -> clean
    (X2) -> splice (X7) -> re-scan and verify (J3) -> route leftovers (P13/P14). Errored attempts (no reply) carry no
    tokens and no duration and are neither fixed nor escalated (D2). An edit left out because it overlaps another is
    not patched and escalates. Only documents with pending findings are touched at a level: their keys are a small
    stored table that Spark broadcasts when its size allows. Replies and attempts of a level are stored, so a
    responder runs once.

    Difference from the reference loop, by design: within a level all patches are applied and then verified
    together (the reference re-scans after each splice). Returns ``(attempts, patched_docs, leftovers)``;
    ``attempts`` has the raw-attempt columns of ``operators.audit`` (``file_uid`` = ``key``, ``attempt_seq`` in the
    order of level and finding), ``finding_id``, ``line_num``, ``wiped`` and ``rescan_ok``.
    """
    from ..sources.store import materialize
    from .context import document_line_counts, explode_lines, function_or_window_context, line_window_context
    from .findings import verify_findings
    from .sequence import sequence_within

    models = models or {}
    fkeys = [key, "finding_id"]
    current = docs.select(key, code_col)
    pending = materialize(findings, "cascade_findings")
    carried = [c for c in findings.columns if c not in fkeys]
    all_attempts, done = [], []
    for level in levels:
        keys_df = materialize(pending.select(key).distinct(), "cascade_keys")
        done.append(current.join(keys_df, key, "left_anti"))
        current = materialize(current.join(keys_df, key, "left_semi"), "cascade_docs")
        lines = explode_lines(current, code_col, key)
        counts = document_line_counts(current, code_col, key)
        f = pending.withColumn("line_no", F.col("line_num"))
        if spans is None:
            ctx = line_window_context(f, lines, fkeys, key, window=window, counts=counts)
        else:
            ctx = function_or_window_context(f, spans(current), lines, fkeys, key, window=window, counts=counts)
        strategy = F.col("strategy") if "strategy" in pending.columns else F.col("test_id")
        prompts = ctx.withColumn("prompt", fill_template(template, code_snippet=F.col("code"), fix_strategy=strategy)) \
            .withColumn("level", F.lit(level)).withColumnRenamed("code", "code_snippet")
        replies = responder if isinstance(responder, DataFrame) else responder(
            prompts.select(*fkeys, *carried, "level", "prompt", "code_snippet"))
        replies = replies.filter(F.col("level") == level).select(
            *fkeys, "reply", "finish_reason", "prompt_tokens", "completion_tokens", "duration_s")
        att = materialize(attach_responses(prompts.select(*fkeys, *carried, "start_line", "end_line"), replies, fkeys),
                          "cascade_replies")
        errored = F.col("reply").isNull()
        patches = att.filter(~errored).select(key, F.col("finding_id").alias("patch_seq"), "start_line", "end_line",
                                              F.col("reply_clean").alias("block"))
        patched = materialize(apply_patches(current, patches, key, code_col, "patch_seq", mode), "cascade_patched")
        found, parsed = rescan(patched.select(key, code_col)), None
        if isinstance(found, tuple):
            found, parsed = found
        marks = patched.select(key, "wiped", "skipped")
        verified = verify_findings(att, found, parsed, key=key).join(marks, key)
        ok = F.col("is_patched") & ~F.array_contains("skipped", F.col("finding_id"))
        status = (F.when(errored, F.lit(RAW_ERROR)).when(ok, F.lit(RAW_SUCCESS))
                  .otherwise(F.lit(raw_status_for_level(level))))
        if parsed is None:
            verified = verified.withColumn("rescan_ok", F.lit(True))
        else:
            verified = verified.join(parsed.select(key, "rescan_ok"), key, "left")
        spent = lambda c, kind: F.when(errored, F.lit(0)).otherwise(F.coalesce(F.col(c), F.lit(0))).cast(kind)
        done_level = materialize(verified.select(
            *fkeys, *carried, F.lit(level).alias("level_attempted"),
            F.lit(models.get(level)).cast("string").alias("model"), status.alias("status"),
            F.when(errored, F.lit("no reply")).otherwise(F.col("finish_reason")).alias("finish_reason"),
            spent("prompt_tokens", "bigint").alias("prompt_tokens"),
            spent("completion_tokens", "bigint").alias("completion_tokens"),
            spent("duration_s", "double").alias("llm_time_taken"), "wiped", "rescan_ok"), "cascade_attempts")
        all_attempts.append(done_level)
        pending = route_leftovers(done_level, "status", level + 1).select(*fkeys, *carried)
        current = patched.select(key, code_col)
    out = all_attempts[0]
    for a in all_attempts[1:]:
        out = out.unionByName(a)
    out = sequence_within(out, [key], ["level_attempted", "finding_id"], "attempt_seq").select(
        F.col(key).alias("file_uid"), F.col("test_id").alias("vulnerability_id"), "attempt_seq", "level_attempted",
        "model", "status", "finish_reason", "prompt_tokens", "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), "llm_time_taken", "severity",
        "confidence", "finding_id", "line_num", "wiped", "rescan_ok")
    final = current
    for d in done:
        final = final.unionByName(d)
    return out, final, pending


REPLY_DDL = ("{key} {ktype}, finding_id bigint, level int, reply string, finish_reason string, prompt_tokens bigint, "
             "completion_tokens bigint, duration_s double")
