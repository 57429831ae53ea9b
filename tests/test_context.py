"""Innermost span / window context / per-line frame; expected contexts written by hand or by plain slicing."""

from patchmetrics.operators import context

NESTED = "a\nf1\nf2\ng1\ng2\nf5\nb\n"      # f: lines 2-6, g inside it: lines 4-5


def test_function_or_window(spark):
    plain = "".join(f"v{i}\n" for i in range(1, 31))
    docs = spark.createDataFrame([(1, NESTED), (2, plain)], "doc_id long, code string")
    spans = spark.createDataFrame([(1, 2, 6), (1, 4, 5)], "doc_id long, start_line int, end_line int")
    want = {(1, 1): ("window", 1, 6, "a\nf1\nf2\ng1\ng2\nf5\n"), (1, 2): ("function", 2, 6, "f1\nf2\ng1\ng2\nf5\n"),
            (1, 4): ("function", 4, 5, "g1\ng2\n"), (1, 6): ("function", 2, 6, "f1\nf2\ng1\ng2\nf5\n"),
            (1, 7): ("window", 2, 7, "f1\nf2\ng1\ng2\nf5\nb\n"), (1, 13): ("window", 8, 7, ""),
            (2, 15): ("window", 10, 20, "".join(f"v{i}\n" for i in range(10, 21)))}
    f = spark.createDataFrame([(d, n, "T") for d, n in want], "doc_id long, line_no int, test_id string")
    lines = context.explode_lines(docs, "code")
    for counts in (None, context.document_line_counts(docs, "code")):
        out = context.function_or_window_context(f, spans, lines, ["doc_id", "line_no", "test_id"], counts=counts)
        got = {(r.doc_id, r.line_no): (r.context_type, r.start_line, r.end_line, r.code) for r in out.collect()}
        assert got == want


def test_line_frame_with_small_blocks(spark):
    text = "".join(f"line {i}\n" for i in range(1, 101))
    docs = spark.createDataFrame([(1, text), (2, "a\nb")], "doc_id long, text string")
    lines = context.explode_lines(docs)
    got = {(r.doc_id, r.line_no): r.context for r in context.line_window_frame(lines, block=16).collect()}
    for d, t in [(1, text), (2, "a\nb")]:
        ls = t.splitlines(keepends=True)
        for i in range(len(ls)):
            assert got[(d, i + 1)] == "".join(ls[max(0, i - 5):i + 6])


def test_innermost_span(spark):
    spans = spark.createDataFrame([(1, 1, 100), (1, 10, 60), (1, 20, 30), (1, 200, 210)],
                                  "doc_id long, start_line int, end_line int")
    f = spark.createDataFrame([(1, ln) for ln in (5, 15, 25, 61, 150, 205)], "doc_id long, line_no int")
    got = {r.line_no: (r.span_start, r.span_end)
           for r in context.innermost_span(f, spans).collect()}
    assert got == {5: (1, 100), 15: (10, 60), 25: (20, 30), 61: (1, 100), 150: (None, None), 205: (200, 210)}


def test_window_context_hot_document(spark):
    text = "".join(f"row {i}\n" for i in range(1, 401))
    docs = spark.createDataFrame([(1, text), (2, "only\n")], "doc_id long, text string")
    lines = context.explode_lines(docs)
    finds = [(1, ln, f"T{k}") for ln in range(1, 420, 3) for k in range(2)] + [(2, 1, "T0"), (2, 9, "T0")]
    f = spark.createDataFrame(finds, "doc_id long, line_no int, test_id string")
    out = context.line_window_context(f, lines, ["doc_id", "line_no", "test_id"]).collect()
    assert len(out) == len(finds)
    texts = {1: text.splitlines(keepends=True), 2: ["only\n"]}
    for r in out:
        ls = texts[r.doc_id]
        s0, e = max(0, r.line_no - 6), min(len(ls), r.line_no + 5)
        assert (r.start_line, r.end_line, r.code) == (s0 + 1, e, "".join(ls[s0:e]))
