"""F1 from the line table: equal to the rule in plain Python, to the syntax tree on ordinary code, and usable by J5."""

import ast
import inspect
import random
import re

from patchmetrics.operators import churn, context, report, spans


def indent(line):
    at = 0
    for c in line:
        if c == "\t":
            at = at // 8 * 8 + 8
        elif c == " ":
            at += 1
        else:
            break
    return at


def brute(text):
    lines = [(n, x) for n, x in enumerate(text.splitlines(), 1) if re.match(r"\s*[^\s#]", x)]
    out = []
    for at, (n, x) in enumerate(lines):
        m = re.match(r"[ \t]*(async[ \t]+)?def[ \t]+([^\W\d]\w*)[ \t]*[\(\[]", x)
        if not m:
            continue
        start, up = n, at - 1
        while up >= 0 and lines[up][1].lstrip().startswith("@"):
            start, up = lines[up][0], up - 1
        end = n
        for k, y in lines[at + 1:]:
            if indent(y) <= indent(x) and y.lstrip()[0] not in ")]}":
                break
            end = k
        out.append(("async function" if m[1] else "function", m[2], start, end, n))
    return sorted(out)


def found(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {i: [] for i in range(len(texts))}
    for r in spans.function_spans(context.explode_lines(docs)).collect():
        got[r["doc_id"]].append((r["kind"], r["name"], r["start_line"], r["end_line"], r["def_line"]))
    return {i: sorted(v) for i, v in got.items()}


def test_equal_to_the_rule_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 8)
    rng = random.Random(3)
    pieces = ["def f{}(x):", "async def g{}(x):", "@d{}", "x{} = 1", "# note {}", "", "   ", ")", "] + y", "class C{}:", "\tdef t{}(a):", "deff{}(3)", "def h{}"]
    texts = [None, "", "\n\n", "def only(x): pass", "@a\n@b"]
    for _ in range(60):
        rows = [" " * rng.choice([0, 0, 4, 4, 8, 2]) + rng.choice(pieces).format(i) for i in range(rng.randrange(1, 90))]
        texts.append("\n".join(rows) + rng.choice(["", "\n"]))
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t or ""), t


def test_equal_to_the_syntax_tree_on_ordinary_code(spark):
    texts = [inspect.getsource(m) for m in (churn, report, context, random, inspect)]
    texts = [re.sub(r'(?s)""".*?"""', lambda m: '"doc"' + "\n" * 0, t) for t in texts]      # strings over several lines are out of rule
    got = found(spark, texts)
    for i, t in enumerate(texts):
        tree = [x for x in ast.walk(ast.parse(t)) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
        want = sorted((x.name, min([x.lineno, *[d.lineno for d in x.decorator_list]]), x.end_lineno) for x in tree)
        same = set(want) & {(name, a, b) for _, name, a, b, _ in got[i]}
        assert len(got[i]) == len(want) and len(same) >= 0.98 * len(want)


def test_spans_feed_the_context_join(spark):
    text = "import x\n\n@d\ndef f(a):\n    def g(b):\n        return b\n    return g\n\n\nx = f(1)\n"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    lines = context.explode_lines(docs)
    finds = spark.createDataFrame([(1, n, "T") for n in (1, 3, 6, 7, 10)], "doc_id long, line_no int, test_id string")
    out = context.function_or_window_context(finds, spans.function_spans(lines), lines, ["doc_id", "line_no", "test_id"])
    got = {r["line_no"]: (r["context_type"], r["start_line"], r["end_line"]) for r in out.collect()}
    assert got == {1: ("window", 1, 6), 3: ("function", 3, 7), 6: ("function", 5, 6), 7: ("function", 3, 7), 10: ("window", 5, 10)}


def test_tables_that_grow_with_the_documents_are_not_broadcast(spark, capsys):
    docs = spark.createDataFrame([(1, "def f(a):\n    x = 1\ny = 2")], "doc_id long, text string")
    spans.function_spans(context.explode_lines(docs)).explain()
    assert "Broadcast" not in capsys.readouterr().out
