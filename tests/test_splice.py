"""X7 on line tables: equal to a plain fold over Python lists, in both modes."""

import random

import pytest
from pyspark.sql import functions as F

from patchmetrics.operators import cascade, context, splice

EDIT = "doc_id long, patch_seq int, start_line int, end_line int, block string"


def closed(block):
    block = block or ""
    return block if block.endswith("\n") else block + "\n"


def fold(lines, edits, mode):
    """``(elements, outcomes)`` by the rule as written, one document."""
    if mode == "sequential":
        for o, s, e, block in sorted(edits, key=lambda x: x[0]):
            s, e = max(s, 1), max(e, 0)
            lines = lines[:s - 1] + [closed(block)] + lines[e:]
        return lines, {o: "applied" for o, *_ in edits}
    last, out = {}, {}
    for o, s, e, block in sorted(edits, key=lambda x: x[0]):
        s = max(s, 1)
        last[s, max(e, s - 1)] = (o, block)
    out = {o: "superseded" for o, *_ in edits}
    used, end = [], None
    for (s, e), (o, block) in sorted(last.items(), key=lambda x: x[0]):
        ok = end is None or end < s
        out[o] = "applied" if ok else "overlapping"
        if ok:
            used.append((s, e, block))
            end = e
    new, at = [], 1
    for s, e, block in used:
        new += lines[at - 1:s - 1] + closed(block).splitlines(keepends=True)
        at = e + 1
    return new + lines[at - 1:], out


def cases(seed, mode):
    rng = random.Random(seed)
    for doc in range(60):
        n = rng.choice([0, 1, 5, 30, 300, 1500])
        lines = [f"d{doc} l{i}\n" for i in range(n)]
        if lines and doc % 3 == 0:
            lines[-1] = lines[-1][:-1]
        edits = []
        for o in range(rng.choice([0, 1, 3, 12, 60])):
            s = rng.randrange(-1, n + 4)
            e = s + rng.choice([-1, 0, 0, 1, 3, 40, 700]) if mode == "original" or rng.random() < 0.8 else s - rng.randrange(0, 4)
            edits.append((o, s, e, rng.choice([None, "", "x", "one\n", "a\nb\nc", "a\r\nb", "\n\n"])))
        yield doc, lines, edits


@pytest.mark.parametrize("mode", ["original", "sequential"])
def test_equal_to_the_fold(spark, mode, monkeypatch):
    monkeypatch.setattr(splice, "BLOCK", 16)
    docs = list(cases(8, mode))
    lines = spark.createDataFrame([(d, i + 1, x) for d, ls, _ in docs for i, x in enumerate(ls)], "doc_id long, line_no int, line string")
    edits = spark.createDataFrame([(d, *e) for d, _, es in docs for e in es], EDIT)
    new, outcomes = splice.splice_lines(lines, edits, mode=mode)
    got, seen = {}, {}
    for r in new.collect():
        got.setdefault(r["doc_id"], []).append((r["line_no"], r["line"]))
    for r in outcomes.collect():
        seen.setdefault(r["doc_id"], {})[r["patch_seq"]] = r["outcome"]
    kinds = set()
    for d, ls, es in docs:
        want, marks = fold(ls, es, mode)
        assert sorted(got.get(d, [])) == [(i + 1, x) for i, x in enumerate(want)], d
        assert seen.get(d, {}) == marks
        kinds |= set(marks.values())
    assert kinds == ({"applied", "overlapping", "superseded"} if mode == "original" else {"applied"})


def test_equal_to_apply_patches(spark):
    text = "".join(f"line {i}\n" for i in range(1, 700)) + "end"
    docs = spark.createDataFrame([(1, text), (2, "a\nb\nc\n")], "doc_id long, code string")
    edits = spark.createDataFrame([(1, 1, 3, 5, "X"), (1, 2, 5, 9, "Y"), (1, 3, 300, 600, "Z1\nZ2"), (1, 4, 300, 600, "W"),
                                   (1, 5, 690, 690, ""), (2, 1, 2, 2, "B")], EDIT)
    for mode in ("original", "sequential"):
        new, _ = splice.splice_lines(context.explode_lines(docs, "code"), edits, mode=mode)
        whole = new.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))),
                                                                     lambda x: x["line"]), "").alias("code"))
        want = {r["doc_id"]: r["code"] for r in cascade.apply_patches(docs, edits, mode=mode).collect()}
        assert {r["doc_id"]: r["code"] for r in whole.collect()} == want


def test_nothing_to_do(spark):
    lines = spark.createDataFrame([(1, 1, "a\n")], "doc_id long, line_no int, line string")
    none = spark.createDataFrame([], EDIT)
    new, outcomes = splice.splice_lines(lines, none)
    assert [tuple(r) for r in new.collect()] == [(1, 1, "a\n")] and outcomes.collect() == []
    new, _ = splice.splice_lines(lines.limit(0), spark.createDataFrame([(7, 1, 4, 4, "x\ny")], EDIT))
    assert sorted(tuple(r) for r in new.collect()) == [(7, 1, "x\n"), (7, 2, "y\n")]
