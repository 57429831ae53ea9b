"""the patience difference equals its definition written in plain Python, and an LCS where lines are unique."""

import random
from collections import Counter

from patchmetrics.operators import churn, line_diff

LINE = "doc_id long, line_no int, line string"


def brute(b, a):
    """``(matched, churn)`` by the definition; the selection by an exhaustive quadratic table."""
    if not b or not a:
        return 0, max(len(b), len(a))
    p = 0
    while p < min(len(b), len(a)) and b[p] == a[p]:
        p += 1
    q = 0
    while q < min(len(b), len(a)) - p and b[-1 - q] == a[-1 - q]:
        q += 1
    b, a = b[p:len(b) - q], a[p:len(a) - q]
    cb, ca = Counter(b), Counter(a)
    pairs = [(i, a.index(x)) for i, x in enumerate(b) if cb[x] == 1 and ca[x] == 1]
    chain = selection(pairs)
    if not chain:
        return p + q, max(len(b), len(a))
    matched, total, i0, j0 = p + q + len(chain), 0, 0, 0
    for i, j in [*chain, (len(b), len(a))]:
        m, c = brute(b[i0:i], a[j0:j])
        matched, total, i0, j0 = matched + m, total + c, i + 1, j + 1
    return matched, total


def selection(pairs):
    """A longest chain; ties as the definition of the runs gives them (earliest end, earliest predecessor, whole runs)."""
    runs = []
    rank = {j: r for r, j in enumerate(sorted(j for _, j in pairs))}
    for k, (i, j) in enumerate(pairs):
        if runs and rank[j] == rank[runs[-1][-1][1]] + 1:
            runs[-1].append((i, j))
        else:
            runs.append([(i, j)])
    best = []
    for k, run in enumerate(runs):
        top = max(((best[m][0], -m) for m in range(k) if runs[m][-1][1] < run[0][1]), default=(0, 0))
        best.append((top[0] + len(run), -top[1] if top[0] else None))
    if not runs:
        return []
    k, out = max(range(len(runs)), key=lambda m: (best[m][0], -m)), []
    while k is not None:
        out = runs[k] + out
        k = best[k][1]
    return out


def lcs(b, a):
    row = [0] * (len(a) + 1)
    for x in b:
        new = [0]
        for j, y in enumerate(a):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def edited(rng, lines):
    lines = list(lines)
    for _ in range(rng.randrange(0, 7)):
        i, n = rng.randrange(0, len(lines) + 1), rng.randrange(1, 6)
        kind = rng.randrange(4)
        if kind == 0:
            del lines[i:i + n]
        elif kind == 1:
            lines[i:i] = [f"new {rng.randrange(10**6)}" for _ in range(n)]
        elif kind == 2:
            block = lines[i:i + n]
            del lines[i:i + n]
            at = rng.randrange(0, len(lines) + 1)
            lines[at:at] = block
        else:
            lines[i:i] = lines[:n]
    return lines


def tables(spark, pairs):
    rows = [[(d, 3 * i + 1, x) for d, two in pairs.items() for i, x in enumerate(two[s])] for s in (0, 1)]
    return [spark.createDataFrame(r, LINE) for r in rows]


def test_equal_to_the_definition(spark, monkeypatch):
    monkeypatch.setattr(line_diff, "BLOCK", 8)
    rng, pairs = random.Random(6), {}
    for d in range(70):
        alphabet = rng.choice([2, 4, 30, 10**6])
        b = [f"l{rng.randrange(alphabet)}" for _ in range(rng.choice([0, 1, 3, 20, 80]))]
        pairs[d] = (b, edited(rng, b) if d % 5 else [f"l{rng.randrange(alphabet)}" for _ in range(rng.randrange(0, 40))])
    pairs[100] = (["x"] * 30, ["x"] * 30)
    pairs[101] = (["x"] * 30, ["x"] * 12)
    pairs[102] = ([None, "a", None, "b"], ["a", None, None, "b", ""])
    before, after = tables(spark, pairs)
    got = {r["doc_id"]: r for r in line_diff.line_churn(before, after).collect()}
    bound = {r["doc_id"]: r["churn"] for r in churn.multiset_line_churn(before, after).collect()}
    assert got.keys() == {d for d, (b, a) in pairs.items() if b or a}
    for d, r in got.items():
        b, a = pairs[d]
        matched, total = brute(b, a)
        assert (r["matched"], r["deleted"], r["inserted"], r["churn"]) == (matched, len(b) - matched, len(a) - matched, total), d
        assert r["churn"] >= bound[d]
    assert got[100]["churn"] == 0 and got[101]["churn"] == 18


def test_longest_common_subsequence_where_lines_are_unique(spark):
    rng, pairs = random.Random(2), {}
    for d in range(25):
        b = [f"{d} {i}" for i in range(60)]
        a = b[:]
        for _ in range(rng.randrange(0, 12)):
            a.insert(rng.randrange(len(a)), a.pop(rng.randrange(len(a))))
        pairs[d] = (b, [x for x in a if rng.random() < 0.9] + [f"end {d}"])
    for r in line_diff.line_churn(*tables(spark, pairs)).collect():
        assert r["matched"] == lcs(*pairs[r["doc_id"]])


def test_empty_tables_and_rows_without_a_key(spark):
    none = spark.createDataFrame([], LINE)
    some = spark.createDataFrame([(None, 1, "x"), (1, 1, "x"), (1, 2, "y")], LINE)
    assert line_diff.line_churn(none, none).collect() == []
    assert [tuple(r) for r in line_diff.line_churn(none, some).collect()] == [(1, 0, 0, 2, 2)]
    assert [tuple(r) for r in line_diff.line_churn(some, some).collect()] == [(1, 2, 0, 0, 0)]


def test_heaviest_selection():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(0, 9)
        j, w = rng.sample(range(20), n), [rng.randrange(1, 5) for _ in range(n)]
        got = line_diff.heaviest_increasing(j, w)
        assert all(x < y and j[x] < j[y] for x, y in zip(got, got[1:]))
        best = max((sum(w[k] for k in range(n) if m >> k & 1) for m in range(1 << n)
                    if all(j[x] < j[y] for x in range(n) for y in range(x + 1, n) if m >> x & 1 and m >> y & 1)), default=0)
        assert sum(w[k] for k in got) == best


def test_gaps_choose_their_runs_in_batches(spark, capsys):
    """Gaps outnumber documents, so Python takes batches of them, not one gap at a time; crossing runs stay exact."""
    runs = {1: ([(1, 1, 4), (5, 5, 9)], [0, 1]), 2: ([(1, 8, 2), (3, 1, 7), (8, 6, 8)], [1, 2]), 3: ([(1, 2, 1)], [0])}
    ends = [(k, ".0", lo if e == "first" else hi, rj if e == "first" else rj + hi - lo, e == "first" or lo == hi, e == "last" or lo == hi)
            for k, (rs, _) in runs.items() for lo, rj, hi in rs for e in (("first",) if lo == hi else ("last", "first"))]
    chosen = line_diff.chosen_runs(spark.createDataFrame(ends, "_k long, _g string, ri long, rj long, first boolean, last boolean"))
    want = sorted((k, ".0", rs[c][0], rs[c][2]) for k, (rs, cs) in runs.items() for c in cs)
    assert sorted(tuple(r) for r in chosen.collect()) == want
    chosen.explain()
    plan = capsys.readouterr().out
    assert "ArrowEvalPython" in plan and "FlatMapGroups" not in plan
