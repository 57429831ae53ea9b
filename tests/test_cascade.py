"""Splice modes (D6), routing (P13/P14) and the batch cascade on a tiny corpus."""

import random
import re

from pyspark.sql import functions as F

from patchmetrics.operators.cascade import apply_patches, remediate, route_leftovers


def test_splice_modes(spark):
    code = "".join(f"l{i}\n" for i in range(1, 11))
    patches = [(1, 2, 3, "A\nB"), (2, 5, 5, "C"), (3, 9, 10, "D\n")]
    docs = spark.createDataFrame([(1, code), (2, "x\n")], "doc_id long, code string")
    p = spark.createDataFrame([(1, *x) for x in patches], "doc_id long, patch_seq long, start_line int, "
                                                         "end_line int, block string")
    seq = {r.doc_id: r for r in apply_patches(docs, p, mode="sequential").collect()}
    # Lines are never re-based: after the first edit "A\nB" is one element, so line 5 is l6 and lines 9-10 are l10.
    assert seq[1].code == "l1\nA\nB\nl4\nl5\nC\nl7\nl8\nl9\nD\n"
    assert seq[2].code == "x\n" and seq[2].n_patches == 0
    orig = {r.doc_id: r for r in apply_patches(docs, p, mode="original").collect()}
    assert orig[1].code == "l1\nA\nB\nl4\nC\nl6\nl7\nl8\nD\n" and not orig[1].overlapping
    wipe = spark.createDataFrame([(2, 1, 1, 1, "")], p.schema)
    assert apply_patches(docs, wipe).filter("doc_id = 2").first().code == "\n"


def test_overlapping_edits_lose_no_line(spark):
    code = "".join(f"l{i}\n" for i in range(1, 10))
    docs = spark.createDataFrame([(1, code)], "doc_id long, code string")
    schema = "doc_id long, patch_seq long, start_line int, end_line int, block string"
    same = spark.createDataFrame([(1, 7, 1, 5, "first"), (1, 9, 1, 5, "last")], schema)
    r = apply_patches(docs, same).first()
    assert r.code == "last\nl6\nl7\nl8\nl9\n" and r.n_patches == 1 and not r.overlapping
    partly = spark.createDataFrame([(1, 1, 2, 4, "X"), (1, 2, 3, 5, "Y"), (1, 3, 6, 6, "Z")], schema)
    r = apply_patches(docs, partly).first()
    assert r.code == "l1\nX\nl5\nZ\nl7\nl8\nl9\n" and r.overlapping and r.skipped == [2]


def test_findings_travel_through_levels_and_errors_cost_nothing(spark):
    from patchmetrics.operators.cascade import plan_findings
    docs = spark.createDataFrame([(1, "bad one\nbad two\nlost\n")], "doc_id long, code string")
    big = 5_000_000_000   # ids beyond any fixed range
    found = spark.createDataFrame([(1, big, "B", 1, "HIGH", "HIGH", "u/en/1/"), (1, big + 1, "B", 2, "LOW", "LOW", None),
                                   (1, 7, "L", 3, "LOW", "LOW", "")],
                                  "doc_id long, finding_id long, test_id string, line_num int, severity string, "
                                  "confidence string, more_info_url string")
    pages = spark.createDataFrame([("u/en/latest/", "page text")], "url string, text string")
    contexts = found.select("doc_id", "finding_id", F.lit("ctx").alias("code"))
    prompts_seen = []

    def planner(prompts):
        prompts_seen.extend(r.prompt for r in prompts.collect())
        return prompts.select("doc_id", "finding_id", F.concat(F.lit("plan "), F.col("finding_id")).alias("reply"))

    planned = plan_findings(found, contexts, pages, planner, ["doc_id", "finding_id"])
    assert any("page text" in p and "ctx" in p for p in prompts_seen)
    levels = {}

    def responder(prompts):
        rows = prompts.collect()
        levels[rows[0].level] = {r.finding_id: r.prompt for r in rows}
        reply = F.when(F.col("test_id") == "L", F.lit(None)).when(F.col("level") == 1, F.lit("still bad")) \
            .when(F.col("finding_id") == big, F.lit("good")).otherwise(F.col("code_snippet"))
        return prompts.select("doc_id", "finding_id", "level", reply.alias("reply"), F.lit("stop").alias("finish_reason"),
                              F.lit(10).alias("prompt_tokens"), F.lit(5).alias("completion_tokens"),
                              F.lit(2.0).alias("duration_s"))

    def rescan(patched):
        rows = patched.filter(F.col("code").contains("bad")).select("doc_id", F.lit("B").alias("test_id"))
        return rows, patched.select("doc_id", F.lit(True).alias("rescan_ok"))

    attempts, _final, left = remediate(docs, planned, responder, rescan, window=0)
    rows = {(r.finding_id, r.level_attempted): r for r in attempts.collect()}
    assert [r.attempt_seq for r in sorted(rows.values(), key=lambda r: (r.level_attempted, r.finding_id))] == [1, 2, 3, 4, 5]
    error = rows[7, 1]
    assert (error.status, error.total_tokens, error.llm_time_taken) == ("error", 0, 0.0)
    assert all(f"plan {i}" in levels[n][i] for n in (1, 2) for i in (big, big + 1))
    assert sorted((r.finding_id, r.strategy) for r in left.collect()) == [(big, f"plan {big}"), (big + 1, f"plan {big + 1}")]


def test_leftovers_count_finding_instances(spark):
    from patchmetrics.operators import audit
    cols = ("file_uid long, vulnerability_id string, attempt_seq long, level_attempted int, model string, status string, "
            "finish_reason string, prompt_tokens long, completion_tokens long, total_tokens long, llm_time_taken double, "
            "severity string, confidence string")
    tail = ("m", "x", "stop", 1, 1, 2, 1.0, "LOW", "LOW")
    row = lambda f, n, level, status: (f, "B1", n, level, tail[0], status, *tail[2:])
    raw = [row(1, 1, 1, "failed_level_1"), row(1, 2, 1, "failed_level_1"), row(1, 3, 2, "failed_level_2"), row(1, 4, 2, "failed_level_2"),
           row(2, 1, 1, "failed_level_1"), row(2, 2, 1, "failed_level_1"), row(2, 3, 2, "success"), row(2, 4, 2, "failed_level_2")]
    traces = audit.vuln_traces(audit.price_attempts(audit.normalize_attempts(spark.createDataFrame(raw, cols))))
    facts = spark.createDataFrame([(1, 2), (2, 1), (3, 4)], "file_uid long, vuln_count_after int")
    got = {r.file_uid: (r.vuln_count, r.fixed_count, r.new_issues_introduced) for r in audit.file_summary(traces, facts).collect()}
    assert got == {1: (2, 0, 0), 2: (2, 1, 0), 3: (0, 0, 4)}
    given = spark.createDataFrame([(1,), (3,), (3,)], "file_uid long")
    got = {r.file_uid: r.vuln_count for r in audit.file_summary(traces, facts, given).collect()}
    assert got == {1: 1, 2: 1, 3: 2}


def test_routing_and_cascade(spark):
    att = spark.createDataFrame([("a", "success"), ("b", "failed_level_1"), ("c", "error"), ("d", None)],
                                "id string, raw_status string")
    assert [r.id for r in route_leftovers(att).collect()] == ["b"]
    filler = "".join(f"a{i} = {i}\n" for i in range(8))
    tail = "".join(f"a{i} = {i}\n" for i in range(3, 8))
    code = "def f():\n    key = 'secret'\n    return key\n" + filler + "print(f())\nz = 1\n"
    docs = spark.createDataFrame([(1, code)], "doc_id long, code string")
    findings = spark.createDataFrame([(1, 1, "S1", 2, "HIGH", "HIGH"), (1, 2, "S2", 12, "LOW", "LOW")],
                                     "doc_id long, finding_id long, test_id string, line_num int, severity string, "
                                     "confidence string")
    spans = spark.createDataFrame([(1, 1, 3)], "doc_id long, start_line int, end_line int")
    replies = spark.createDataFrame(
        [(1, 1, 1, "```python\ndef f():\n    key = env()\n    return key\n```", "stop", 10, 5, 1.0),
         (1, 2, 1, tail + "print(f())\nz = 1", "stop", 3, 3, 1.0),
         (1, 2, 2, tail + "log(f())\nz = 1\n", "stop", 4, 4, 2.0)],
        "doc_id long, finding_id long, level int, reply string, finish_reason string, prompt_tokens long, "
        "completion_tokens long, duration_s double")

    def rescan(patched):
        rows = patched.select("doc_id", F.explode(F.array(
            F.when(F.col("code").contains("secret"), F.lit("S1")),
            F.when(F.col("code").contains("print"), F.lit("S2")))).alias("test_id"))
        return rows.filter(F.col("test_id").isNotNull())

    attempts, final, left = remediate(docs, findings, replies, rescan, models={1: "m1", 2: "m2"},
                                       spans=lambda d: spans)
    got = sorted((r.vulnerability_id, r.level_attempted, r.status, r.model) for r in attempts.collect())
    assert got == [("S1", 1, "success", "m1"), ("S2", 1, "failed_level_1", "m1"), ("S2", 2, "success", "m2")]
    assert final.first().code == ("def f():\n    key = env()\n    return key\n" + filler.replace(tail, "")
                                  + tail + "log(f())\nz = 1\n")
    assert left.count() == 0


def test_run_sample_end_to_end(spark, tmp_path):
    from patchmetrics.operators.audit import pricing_table
    from patchmetrics.plans.pipelines import run_sample
    from patchmetrics.sources.io import read_audit_log
    corpus = spark.createDataFrame([(0, "def f():\n    x = 'secret'\n    return x\n"), (3, "y = 1\n"),
                                    (5, "print('secret')\n")], "sample_id long, code string")
    findings = spark.createDataFrame([(0, 1, "S1", 2, "HIGH", "HIGH"), (5, 1, "S1", 1, "LOW", "LOW")],
                                     "doc_id long, finding_id long, test_id string, line_num int, severity string, "
                                     "confidence string")
    replies = spark.createDataFrame(
        [(0, 1, 1, "def f():\n    x = env()\n    return x", "stop", 10, 5, 1.0)],
        "doc_id long, finding_id long, level int, reply string, finish_reason string, prompt_tokens long, "
        "completion_tokens long, duration_s double")

    def rescan(patched):
        return patched.filter(F.col("code").contains("secret")).select("doc_id", F.lit("S1").alias("test_id"))

    def statistics(code):
        return code.select("doc_id", F.size(F.split("code", "\n")).alias("loc"), F.lit(1.0).alias("cc"))

    log = run_sample(corpus, findings, replies, rescan, statistics, pricing_table(spark), str(tmp_path / "log"),
                     str(tmp_path / "code"), models={1: "alibaba-qwen3-32b", 2: "deepseek-r1-distill-llama-70b"})
    rec = {r.meta.file_uid: r for r in read_audit_log(spark, str(tmp_path / "log")).collect()}
    assert set(rec) == {"0", "5"}                       # sample 3 is not in range(0, 420, 5)
    assert rec["0"].security_summary.fixed_count == 1 and rec["0"].vulnerabilities[0].status == "FIXED"
    assert rec["5"].vulnerabilities[0].attempts[0].status == "FAILED"      # no reply -> error -> FAILED, not leftover
    assert rec["5"].input_stats.vuln_count == 0
    assert log.count() == 2


def brute_cascade(texts, window=5):
    """Attempts of the fixture's two levels, file by file; and how many edits were left out for an overlap."""
    from patchmetrics.sources.fixtures import RULES
    scan = lambda text: [(n, t) for n, line in enumerate(text.split("\n"), 1) for t, _s, p in RULES if re.search(p, line)]
    severity, out, left_out = {t: s for t, s, _p in RULES}, [], 0
    for doc, code in texts.items():
        pending = sorted((n * 1000 + int(t[1:]), t, n) for n, t in scan(code))
        seq = 0
        for level in (1, 2):
            lines = [x for x in re.split(r"(?<=\n)", code) if x]
            replies, ranges = {}, {}
            for fid, rule, n in pending:
                s, e = max(0, n - 1 - window) + 1, min(len(lines), n + window)
                snippet = "".join(lines[s - 1:e])
                masked = re.sub(RULES[2][2], "[email]", snippet)
                if rule == "R001":
                    continue
                answer = masked.replace("License", "licence") if level == 2 else masked if rule == "R003" else snippet
                replies[fid] = len(snippet), len(answer) + 14
                ranges[s, e] = fid, answer.strip()          # findings in order: the last one stays
            use, skipped = [], set()
            for (s, e), (fid, block) in sorted(ranges.items()):
                if use and use[-1][1] >= s:
                    skipped.add(fid)
                else:
                    use.append((s, e, block))
            for s, e, block in reversed(use):
                lines[s - 1:max(e, s - 1)] = [block + "\n" * (not block.endswith("\n"))]
            if pending:
                code = "".join(lines)
            still, todo = {t for _n, t in scan(code)}, []
            for fid, rule, n in pending:
                seq += 1
                status = ("error" if fid not in replies else "success" if rule not in still and fid not in skipped
                          else f"failed_level_{level}")
                out.append((doc, rule, seq, level, status, *replies.get(fid, (0, 0)), severity[rule], fid, n))
                todo += [(fid, rule, n)] * status.startswith("failed")
            pending, left_out = todo, left_out + len(skipped)
    return sorted(out), left_out


def test_registered_cascade_with_windows_is_the_brute_force_result(spark, tmp_path):
    from patchmetrics.queries import REGISTRY
    rng = random.Random(5)
    odd_lines = ["see the License", "mail joe.b@example now", 'token = "' + "0a" * 20 + '"', "License of a1@host"]
    texts = {d: "\n".join(rng.choice(odd_lines) if rng.random() < share else f"line {i} of {d}" for i in range(size))
             for d, (size, share) in enumerate([(40, 0.15), (60, 0.1), (25, 0.3), (4, 0.5), (80, 0.05), (30, 0.0), (50, 0.2)])}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, left_out = brute_cascade(texts)
    assert left_out > 5 and {w[4] for w in want} == {"error", "success", "failed_level_1", "failed_level_2"}
    rows = REGISTRY["remediation_cascade_window"](spark, str(tmp_path)).collect()
    assert sorted((r.file_uid, r.vulnerability_id, r.attempt_seq, r.level_attempted, r.status, r.prompt_tokens,
                   r.completion_tokens, r.severity, r.finding_id, r.line_num) for r in rows) == want
