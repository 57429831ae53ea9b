"""Scanner-report parsing (S3/P5/P6), rule scan (J11), verification (J3), documentation lookup."""

import pytest
from pyspark.sql import functions as F

from patchmetrics.operators import findings


def test_scan_report_parsing(spark):
    reports = spark.createDataFrame([
        (1, '{"results":[{"test_id":"B1","issue_severity":"HIGH","issue_confidence":"LOW","line_range":[4,5],'
            '"more_info":"https://d/en/1.2/b1.html","code":"x"}]}'),
        (2, "not json"), (3, '{"errors":[]}'), (4, '{"results":[]}'), (5, None)], "doc_id long, report string")
    ex = findings.explode_scan_report(reports).collect()
    assert len(ex) == 1
    r = ex[0]
    assert (r.test_id, r.more_info_url, r.code_snippet, list(r.line_range), r.test_name) == (
        "B1", "https://d/en/1.2/b1.html", "x", [4, 5], None)
    first = findings.first_line_projection(findings.explode_scan_report(reports)).first()
    assert (first.line_num, first.severity, first.confidence) == (4, "HIGH", "LOW")


def test_rule_scan_and_verification(spark):
    lines = spark.createDataFrame([(1, 1, "mail a.b@x here"), (1, 2, "License: MIT"), (2, 1, "nothing")],
                                  "doc_id long, line_no int, line string")
    rules = spark.createDataFrame([("R2", "LOW", "License"), ("R3", "MEDIUM", "[a-z0-9.]+@[a-z]+")],
                                  "test_id string, severity string, pattern string")
    f = findings.scan_lines(lines, rules)
    assert sorted((r.doc_id, r.line_no, r.test_id) for r in f.collect()) == [(1, 1, "R3"), (1, 2, "R2")]
    rescan = spark.createDataFrame([(1, "R2"), (1, "R2")], "doc_id long, test_id string")
    v = {r.test_id: r.is_patched for r in findings.verify_findings(f, rescan).collect()}
    assert v == {"R3": True, "R2": False}
    parsed = spark.createDataFrame([(1, False)], "doc_id long, rescan_ok boolean")
    v2 = {r.test_id: r.is_patched for r in findings.verify_findings(f, rescan, parsed).collect()}
    assert v2 == {"R3": False, "R2": False}                     # unparsable re-scan -> not patched
    assert [r.test_id for r in findings.patched_findings(f, rescan).collect()] == ["R3"]
    counts = findings.findings_per_doc(f, spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert sorted(tuple(r) for r in counts.collect()) == [(1, 2), (2, 0)]


def test_any_number_of_rules(spark):
    lines = spark.createDataFrame([(1, 1, "x7x"), (1, 2, "x1204x")], "doc_id long, line_no int, line string")
    rules = spark.range(0, 1300).select(F.col("id").cast("string").alias("test_id"), F.lit("LOW").alias("severity"),
                                        F.concat(F.lit("x"), F.col("id"), F.lit("x")).alias("pattern"))
    got = sorted((r.line_no, r.test_id) for r in findings.scan_lines(lines, rules).collect())
    assert got == [(1, "7"), (2, "1204")]


def test_prefilter_loses_no_match_of_java_classes(spark):
    """Every pattern must find what Spark's own rlike finds, nested and intersected classes included."""
    patterns = ["[a[bc]]x", "[a-z&&[^q]]k", "[]a]b", "[^[x]]y", r"[\]a]z", r"[\d[e]]x", "a[b]c", "ab+c", "a{2}b", "x?yz", r"a\.b",
                "[a-c]{2}d", "^ab$", "q[^a]"]
    texts = ["ax", "bx", "cx", "ek", "qk", "ab", "]b", "ay", "xy", "]z", "az", "5x", "ex", "abc", "abbc", "aab", "yz", "a.b",
             "axb", "abd", "bcd", "qb", "", "k"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, line_no int, line string")
    rules = spark.createDataFrame([(str(i), "LOW", p) for i, p in enumerate(patterns)], "test_id string, severity string, pattern string")
    got = {(r.line_no, int(r.test_id)) for r in findings.scan_lines(lines, rules).collect()}
    want = {(r.line_no, i) for i, p in enumerate(patterns) for r in lines.where(F.col("line").rlike(p)).collect()}
    assert got == want and len(want) > 15


def test_doc_lookup_sentinels(spark):
    f = spark.createDataFrame([(1, "https://d/en/1.9.2/a.html"), (2, None), (3, "https://d/en/2/zzz.html"),
                               (4, "")], "finding_id long, more_info_url string")
    docs = spark.createDataFrame([("https://d/en/latest/a.html", "A text"), ("https://d/en/3.0/a.html", "other")],
                                 "url string, text string")
    got = {r.finding_id: r.scraped for r in findings.attach_docs(f, docs).collect()}
    assert got == {1: "A text", 2: "No documentation URL provided.", 3: "docs not found",
                   4: "No documentation URL provided."}


def test_required_literal_is_sound():
    import random
    import re
    rnd = random.Random(5)
    atoms = ["a", "b", "c", "@", r"\.", ".", "[ab]", r"\d", "[^a]", "x"]
    quants = ["", "", "", "?", "*", "+", "{0,2}", "{1,2}", "{2}", "+?"]
    checked = 0
    for _ in range(3000):
        p = "".join(rnd.choice(atoms) + rnd.choice(quants) for _ in range(rnd.randint(1, 5)))
        lit = findings.required_literal(p)
        if lit is None:
            continue
        for _ in range(20):
            s = "".join(rnd.choice("abc@.1x ") for _ in range(rnd.randint(0, 12)))
            if re.search(p, s):
                assert lit in s, (p, lit, s)
                checked += 1
    assert checked > 1000
