"""X1-X7, X10, X13 against the Python behaviour they mirror (random property checks)."""

import random
import re

from pyspark.sql import functions as F

from patchmetrics.functions import text as T

ALPHABET = ["a", "b", " ", "\t", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0",
            " ", " ", "　", "```", "```python", "python", "py", "é", "x", "/en/1.2.3/", "/en/7", "."]


def rand_strings(n, seed=7, max_parts=12):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, max_parts))) for _ in range(n)]


def run(spark, values, col_fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(col_fn(F.col("s"))).collect()]


def test_strip_matches_python(spark):
    vals = rand_strings(400)
    assert run(spark, vals, T.py_strip) == [v.strip() for v in vals]


FENCES = {   # written by hand
    None: "", "": "", "x = 1": "x = 1", "```python\n  x = 1\n```": "x = 1", "```py\nx\n```": "py\nx",
    "  ```\n```  ": "", "```": "", "``````": "", "a ``` b": "a ``` b", "\x1f```python\x1cx\x1d```\x85": "x",
    "```pythonx```": "x", "text\n```": "text", "```\n```python\ny\n```": "```python\ny", "\u3000 z \u2028": "z",
    "```Python\nx\n```": "Python\nx",
}


def test_fence_strip(spark):
    assert run(spark, list(FENCES), T.strip_fences) == list(FENCES.values())


def test_reply_clean_matches_python(spark):
    vals = rand_strings(300, seed=3)
    want = [v.replace("```python", "").replace("```", "").strip() for v in vals]
    assert run(spark, vals, T.clean_reply) == want


def test_splitlines_keepends_matches_python(spark):
    vals = rand_strings(400, seed=5) + ["", "a\r\nb\rc\nd", "x y\x0cz\n"]
    got = run(spark, vals, T.split_lines_keepends)
    assert [list(g) for g in got] == [v.splitlines(keepends=True) for v in vals]


def test_word_count_matches_python(spark):
    vals = rand_strings(400, seed=9)
    assert run(spark, vals, T.word_count) == [len(v.split()) for v in vals]


def test_doc_version_rewrite_matches_python(spark):
    vals = rand_strings(200, seed=13) + ["https://x/en/1.9.2/p.html", "https://x/en/latest/p", "/en/1/en/22.3", None]
    want = [None if v is None else re.sub(r"(?<=/en/)[0-9]+(?:\.[0-9]+)*", "latest", v) for v in vals]
    assert run(spark, vals, T.rewrite_doc_version) == want


def test_window_slice_and_splice_match_python(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        n = rnd.randint(0, 12)
        lines = [f"l{k}\n" for k in range(n)]
        line = rnd.randint(1, n + 9)
        s0 = max(0, line - 1 - 5)
        e = min(n, line + 5)
        rows.append((i, lines, line, "".join(lines[s0:e]), s0 + 1, e,
                     rnd.randint(1, n + 2), rnd.randint(0, n + 2), rnd.choice(["B", "B\n", "x\ny"])))
    df = spark.createDataFrame(rows, "i int, lines array<string>, line int, want string, ws int, we int, "
                                     "ps int, pe int, block string")
    s, e = T.window_bounds(F.col("line"), F.size("lines"))
    out = df.select("i", "want", "ws", "we", s.alias("s"), e.alias("e"),
                    T.slice_lines("lines", s, e).alias("code"),
                    T.splice_lines("lines", F.col("ps"), F.col("pe"), F.col("block")).alias("spliced"),
                    "lines", "ps", "pe", "block").orderBy("i").collect()
    for r in out:
        assert (r.s, r.e) == (r.ws, r.we)
        assert r.code == r.want
        block = r.block if r.block.endswith("\n") else r.block + "\n"
        assert list(r.spliced) == list(r.lines)[:r.ps - 1] + [block] + list(r.lines)[r.pe:]
