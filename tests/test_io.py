"""Sources and sinks: corpus JSONL order and ids (S1, C1), audit log read rules (S2), text files."""

import json
import os
import tempfile

import pytest
from pyspark.errors import AnalysisException

from patchmetrics.operators.corpus import prepare_corpus, sample_ids, systematic_sample
from patchmetrics.operators.findings import explode_scan_report, scan_with
from patchmetrics.sources import io


def test_corpus_jsonl_ids_keep_blank_gaps(spark):
    d = tempfile.mkdtemp(prefix="pm-corpus-")
    rows = [{"lang": "python", "chosen": "```python\nx = 1\n```"}, {"lang": "js", "chosen": "a"},
            {"lang": "python", "chosen": "```\n   \n```"}, {"lang": "python", "chosen": 5},
            {"lang": "python", "chosen": "  y = 2  "}]
    with open(os.path.join(d, "c.jsonl"), "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
    df = io.read_corpus_jsonl(spark, d)
    out = prepare_corpus(df, "python", "chosen", io.ORDER_COLS).select("sample_id", "filename", "code").collect()
    # python rows are 0..3; id 1 is blank after cleaning; "5" is read as the string "5"
    assert sorted(tuple(r) for r in out) == [(0, "sample_0.py", "x = 1"), (2, "sample_2.py", "5"),
                                             (3, "sample_3.py", "y = 2")]
    out_dir = os.path.join(d, "out")
    io.write_corpus(prepare_corpus(df, "python", "chosen", io.ORDER_COLS), out_dir)
    assert spark.read.parquet(out_dir).count() == 3


def test_audit_log_read_rules(spark):
    d = tempfile.mkdtemp(prefix="pm-log-")
    with open(os.path.join(d, "bad.jsonl"), "w") as f:
        f.write('{"language": "python"}\n\n   \n{not json\n')
    with pytest.raises(Exception):
        io.read_audit_log(spark, d).collect()
    with pytest.raises(AnalysisException):
        io.read_audit_log(spark, os.path.join(d, "missing")).collect()


def test_text_files_and_sample(spark):
    d = tempfile.mkdtemp(prefix="pm-txt-")
    for i in range(3):
        with open(os.path.join(d, f"sample_{i}.py"), "w") as f:
            f.write(f"x = {i}\n")
    t = io.read_text_files(spark, os.path.join(d, "*.py")).collect()
    assert sorted(r.text for r in t) == ["x = 0\n", "x = 1\n", "x = 2\n"]
    ids = spark.range(0, 1000).withColumnRenamed("id", "doc_id")
    assert [r.doc_id for r in systematic_sample(ids, "doc_id").collect()] == list(range(0, 420, 5))
    assert [r[0] for r in sample_ids(spark, 5, 21, 5).collect()] == [5, 10, 15, 20]


def test_corpus_as_text_files_and_patched_code(spark, tmp_path):
    df = spark.createDataFrame([(0, "sample_0.py", "x = 1"), (2, "sample_2.py", "y\n= 2")],
                               "sample_id long, filename string, code string")
    io.write_corpus(df, str(tmp_path / "files"), as_text_files=True)
    back = {r.path.split("filename=")[1].split("/")[0]: r.text for r in
            io.read_text_files(spark, str(tmp_path / "files/*/part-*")).collect()}
    assert back == {"sample_0.py": "x = 1\n", "sample_2.py": "y\n= 2\n"}
    for batch, rows in (("a", [(1, "old")]), ("b", [(2, "kept")]), ("a", [(1, "new"), (3, "more")])):
        io.write_patched_code(spark.createDataFrame(rows, "doc_id long, code string").selectExpr("*", f"'{batch}' AS batch"),
                              str(tmp_path / "code"))
    assert sorted((r.doc_id, r.code) for r in spark.read.parquet(str(tmp_path / "code")).collect()) == [
        (1, "new"), (2, "kept"), (3, "more")]


def test_scan_report_files_and_own_scanner(spark, tmp_path):
    report = {"results": [{"test_id": "B1", "issue_severity": "LOW", "line_range": [3, 4]}]}
    (tmp_path / "r1.json").write_text(json.dumps(report))
    (tmp_path / "r2.json").write_text("broken")
    got = explode_scan_report(io.read_scan_reports(spark, str(tmp_path / "*.json")), keys=("path",)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.test_id, r.line_range) for r in got] == [("r1.json", "B1", [3, 4])]

    def scanner(batches):
        for pdf in batches:
            hit = pdf[pdf["code"].str.contains("eval")]
            yield hit[["doc_id"]].assign(test_id="E1")

    docs = spark.createDataFrame([(1, "eval(x)"), (2, "fine")], "doc_id long, code string")
    assert [tuple(r) for r in scan_with(docs, scanner, "doc_id long, test_id string").collect()] == [(1, "E1")]
