import random
import re
import zlib
from collections import Counter

import numpy as np

from patchmetrics.llm import spelling

from .data import SF, empty, odd, odd_rows, small


def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = brute_words(rows)
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    found = {w: [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if near(w, v)] for w in n}
    form = {}
    for w, vs in found.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(found[w]), form[w] and n[form[w]]))
    return sorted(out)


def result(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_query_equals_brute_force(spark):
    docs = small()
    rows = list(zip((int(d) for d in docs["doc_id"]), docs["text"]))
    want = brute(rows)
    assert any(w[1] for w in want)
    assert result(spelling.op11_spelling_variants(spark, SF)) == want


def variants(rng, size):
    """Words with many near words: edits of edits, anagrams, letters beyond ASCII."""
    letters = "abcdeéÿßo÷×À"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(6, 9))) for _ in range(size)}
    for w in list(words):
        for _ in range(3):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            words |= {w[:i] + c + w[i + 1:], w[:i] + c + w[i:], w[:i] + w[i + 1:], w[::-1]}
    return sorted(words)


def test_no_link_is_lost_in_routed_trees(spark):
    """Small leaves and samples, so that searches cross many boxes; chains of forms; equal counts."""
    rng = random.Random(11)
    rows = [(i, " ".join([w] * rng.choice([1, 5, 5, 6, 25, 30, 130, 700]))) for i, w in enumerate(variants(rng, 60))]
    rows += [(None, "chains " * 5 + "chainz " * 25 + "chanz " * 9 + "chainzz " * 125 + "chainzzz " * 625)]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute(rows)
    assert max(w[4] for w in want) > 5 and len({w[2] for w in want if w[1] and w[1] != w[2]}) > 1
    for sample, leaf in ((1 << 15, 2048), (1 << 15, 7), (60, 1)):
        assert result(spelling.spelling_groups(docs, sample_words=sample, leaf_words=leaf)) == want


def test_tree_searches_are_complete():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 3, (300, 6)).astype(np.int32)
    asks = rng.integers(0, 3, (80, 6)).astype(np.int32)
    tree = spelling.Tree(counts, 5)
    for ups, downs in ((1, 1), (1, 0), (0, 0)):
        reached = {(int(q), int(w)) for leaf, rows in tree.reach(asks, ups, downs) for q in rows for w in tree.rows[leaf]}
        for q in range(len(asks)):
            for w in range(len(counts)):
                diff = counts[w] - asks[q]
                if np.maximum(diff, 0).sum() <= ups and np.maximum(-diff, 0).sum() <= downs:
                    assert (q, w) in reached
        assert len(reached) < len(asks) * len(counts)
    assert len(spelling.Tree(np.ones((50, 4), np.int32), 5).rows[0]) == 50    # equal vectors cannot be split


def test_odd_rows_long_words_and_empty_table(spark):
    assert result(spelling.spelling_groups(odd(spark))) == brute([(r[0], r[1]) for r in odd_rows()])
    long = "x" * 30_000
    rows = [(i, f"{long} {long}y {long[1:]}z") for i in range(6)]
    got = result(spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows) and len(got) >= 2
    assert spelling.spelling_groups(empty(spark)).collect() == []
