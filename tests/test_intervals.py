"""J5 by the dyadic tree: exact decomposition, brute-force containment, nested and enormous spans."""

import random

from patchmetrics.operators import intervals

SPAN = "doc_id long, start_line int, end_line int"


def test_a_span_is_the_disjoint_union_of_few_nodes(spark):
    rng = random.Random(1)
    spans = [(i, a, a + rng.randrange(0, 300)) for i in range(200) for a in [rng.randrange(1, 500)]]
    spans += [(1000, 1, 1), (1001, 2, 2), (1002, 5, 4), (1003, -3, 6), (1004, None, 5), (1005, -9, 0)]
    nodes = {}
    for r in intervals.dyadic_nodes(spark.createDataFrame(spans, SPAN)).collect():
        nodes.setdefault(r["doc_id"], []).append((r["level"], r["node"]))
    for doc, a, b in spans:
        lines = sorted(n * 2**lev + i + 1 for lev, n in nodes.get(doc, []) for i in range(2**lev))
        assert lines == ([] if a is None else list(range(max(a, 1), b + 1)))


def test_ten_million_lines_are_under_fifty_rows(spark):
    for a, b in ((1, 10_000_000), (2, 10_000_001), (4_999_999, 14_999_997)):
        assert intervals.dyadic_nodes(spark.createDataFrame([(1, a, b)], SPAN)).count() < 50


def test_innermost_equals_brute_force(spark):
    """Nested, crossing, equal and repeated spans; findings repeated, without a line, and in documents without spans."""
    rng = random.Random(4)
    spans = [(d, a, a + rng.choice([0, 1, 5, 40, 400, 100_000])) for d in range(4) for _ in range(150) for a in [rng.randrange(1, 900)]]
    spans += spans[:5] + [(0, 1, 10_000_000), (2, 30, 20)]
    finds = [(rng.randrange(0, 6), rng.choice([None, 0, -4, *range(1, 1200)]), f"T{i % 3}") for i in range(600)]
    finds += finds[:20] + [(0, 9_999_999, "far"), (None, 3, "no doc")]
    got = intervals.innermost_span(spark.createDataFrame(finds, "doc_id long, line_no int, test_id string"),
                                   spark.createDataFrame(spans, SPAN))
    assert got.columns == ["doc_id", "line_no", "test_id", "span_start", "span_end"]
    want = []
    for d, n, t in finds:
        around = [(a, -b) for doc, a, b in spans if doc == d and n is not None and a <= n <= b]
        best = max(around, default=None)
        want.append((d, n, t, best and best[0], best and -best[1]))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    empty = spark.createDataFrame([], SPAN)
    assert {r["span_start"] for r in intervals.innermost_span(got.drop("span_start", "span_end"), empty).collect()} == {None}
