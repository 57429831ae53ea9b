"""J11 through the q-gram index: the same rows as testing every rule on every line."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from patchmetrics.operators import findings, rule_index
from patchmetrics.operators.literals import WORD, Literals
from patchmetrics.sources import fixtures

from .conftest import SF_SMALL

RULE = "test_id string, severity string, pattern string"


def both(lines, rules, keys=("doc_id", "line_no")):
    rows = rules.where("pattern IS NOT NULL").collect()
    plain = findings.scan_projected(lines, rows, [findings.required_literal(r["pattern"]) for r in rows], "line", keys)
    indexed = rule_index.scan_lines_indexed(lines, rules, keys=keys)
    assert indexed.columns == plain.columns
    want, got = (sorted(map(str, df.collect())) for df in (plain, indexed))
    assert got == want
    return got


def test_five_thousand_rules_in_one_pass_equal_the_plain_scan(spark):
    """Words, pairs of words, character classes and quantifiers of the documents' own words."""
    lines = fixtures.doc_lines(spark, SF_SMALL)
    words = [r["w"] for r in lines.select(F.explode(F.split("line", "[^a-z]+")).alias("w")).where("length(w) >= 3").distinct()
             .orderBy("w").collect()]
    rng = random.Random(3)
    shapes = ["{}", "{}[a-z]*", "{} [a-z]+", "^{}", "{}$", "[A-Z]{}", "{}s?", "{}{{2}}", r"{}\s", "({})"]
    rules = [(f"W{i}", rng.choice(["LOW", "HIGH", None]), rng.choice(shapes[:-1] if i % 500 else shapes).format(w))
             for i, w in enumerate(rng.choices(words, k=4990))]
    rules += [("no literal", "LOW", "[0-9]{4,}"), ("two signs", "LOW", "@[a-z]"), ("either", "HIGH", "(License|the) "),
              ("twice", "LOW", "License"), ("twice", "LOW", "License"), ("none", "LOW", None)]
    found = spark.createDataFrame(rules, RULE)
    some = lines.where("doc_id % 4 = 0")
    assert len(both(some, found)) > 1000
    plan = findings.scan_lines(lines, found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1                       # one scan of the text


def test_odd_lines(spark, monkeypatch):
    """Null, empty and short lines, characters of four bytes, literals across the cuts of a long line."""
    monkeypatch.setattr(rule_index, "PIECE", 50)
    rng = random.Random(9)
    literals = ["abc", "😀bc", "x😀", "needle", "needles in hay", "aaa", "a.b", "日本語"]
    lines = [(1, 1, None), (1, 2, ""), (1, 3, "ab"), (1, 4, "abc"), (1, 5, "😀bc x😀y"), (1, 6, "aaaaaaa" * 30), (2, 1, "日本語の needles in hay")]
    for i in range(60):
        text = "".join(rng.choice("abc 😀語") for _ in range(rng.randrange(0, 400)))
        at = rng.randrange(0, len(text) + 1)
        lines.append((3, i, text[:at] + rng.choice(literals) + text[at:]))
    rules = [(f"L{i}", "LOW", x.replace(".", r"\.")) for i, x in enumerate(literals)] + [("ab", "LOW", "ab"), ("any", "LOW", ".+")]
    got = both(spark.createDataFrame(lines, "doc_id long, line_no int, line string"), spark.createDataFrame(rules, RULE))
    assert len(got) > 100
    assert both(spark.createDataFrame([], "doc_id long, line_no int, line string"), spark.createDataFrame(rules, RULE)) == []


def test_rows_are_the_same_in_a_shuffle_join_and_under_a_bitmap_of_few_bits(spark, monkeypatch):
    lines = fixtures.doc_lines(spark, SF_SMALL).where("doc_id % 5 = 0")
    rules = fixtures.rule_catalogue(spark, SF_SMALL).unionByName(fixtures.rules(spark))
    want = both(lines, rules)
    monkeypatch.setattr(rule_index, "LEAST_BITS", 64)
    monkeypatch.setattr(rule_index, "MOST_BITS", 64)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "-1")
        assert both(lines, rules) == want
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_anchor_is_the_gram_that_fewest_literals_share():
    assert rule_index.rarest_grams(["the cat", "the dog", "the"]) == ["e c", "e d", "the"]
    assert rule_index.bitmap_bits(0) == rule_index.LEAST_BITS and rule_index.bitmap_bits(10**7) == rule_index.MOST_BITS


def test_rules_of_one_tail_need_no_test_of_their_own(spark):
    """The catalogue of the query: what leaves the search is what matches, one row each, through one Arrow function."""
    lines, rules = fixtures.doc_lines(spark, SF_SMALL), fixtures.rule_catalogue(spark, SF_SMALL)
    patterns = [r["pattern"] for r in rules.collect()]
    tails, parts = rule_index.shared_tails(patterns)
    assert tails == ["[a-z]* [a-z]+"] and None not in parts
    held = rule_index.held_entries([(x.encode(), 0) for x, _ in parts], [True] * len(parts), F.col("line"), tails)
    n = lines.where("length(line) <= 4096").select(F.explode(F.coalesce(held, F.array().cast("array<int>")))).count()
    found = rule_index.scan_lines_indexed(lines.where("length(line) <= 4096"), rules)
    assert n == found.count() > 1000
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_tails_at_the_ends_of_lines_and_lines_that_cannot_be_marked(spark, monkeypatch):
    """Tails that match nothing, the end, or look back; lines that hold the mark or are long; other rules between them."""
    monkeypatch.setattr(rule_index, "PIECE", 70)
    monkeypatch.setattr(rule_index, "MARKED", 60)
    monkeypatch.setattr(rule_index, "RULES_PER_TAIL", 2)
    monkeypatch.setattr(rule_index, "MOST_TAILS", 12)
    rng = random.Random(5)
    words = ["abc", "bcab", "cabcabcab", "ab.c", "aaa", "日本語", "😀bc", "abcabcabcabcabcabcabc", "abcabcabcabcabcabcabd"]
    tails = ["", "$", "[a-z]*", r"\b", "[^a]", ".+c", "c?", "b{2}", r"\B.", "^", r"\Gc", r"\R", " +[a-z]*$"]
    rules = [(f"{w}{t}", "LOW", w.replace(".", r"\.") + t) for w in words for t in tails] + [("start", "LOW", "^abc"), ("any", None, "a|b")]
    lines = [(0, 0, None), (0, 1, ""), (0, 2, "abc"), (0, 3, "abc\x1fabc"), (0, 4, "\x1f"), (0, 5, "abc\r"), (0, 6, "abc "), (0, 7, "ab.c\0")]
    for i in range(300):
        text = "".join(rng.choice([*words, " ", "a", "b", "c", ".", "語", "\x1f" if i % 5 == 0 else " "]) for _ in range(rng.randrange(20)))
        lines.append((1, i, text))
    for patterns in (rules, rules[:13] * 2, [r for r in rules if r[2].endswith("[a-z]*")]):
        got = both(spark.createDataFrame(lines, "doc_id long, line_no int, line string"), spark.createDataFrame(patterns, RULE))
        assert len(got) > 100


def test_literals_of_any_length_are_found_in_any_slice():
    """Against ``in``: few letters, so that literals share their anchors; nulls, slices, both string types, tiny tables."""
    rng = random.Random(1)
    some = lambda n: "".join(rng.choice("ab€") for _ in range(n))
    texts = [None, "", *[some(rng.randrange(90)) for _ in range(80)], None]
    words = sorted({some(rng.randrange(1, 30)).encode() for _ in range(60)} | {t.encode()[3:] for t in texts[40:60]} - {b""})
    listed = [(w, a, -1) for w, a in zip(words, rule_index.rarest_grams(words, WORD))]
    for bits, step, kind in ((64, 7, pa.string()), (1 << 12, 100, pa.large_string()), (1 << 12, 1 << 18, pa.string())):
        got = Literals(listed, bits, step).of(pa.array(texts, kind).slice(1, 70)).to_pylist()
        want = [[i for i, w in enumerate(words) if w in (t or "").encode()] for t in texts[1:71]]
        assert got == want
    assert Literals(listed, 64, 7).of(pa.array([], pa.string())).to_pylist() == []


def test_literal_and_tail_of_a_pattern():
    split = findings.literal_and_tail
    assert split("word[a-z]* x") == ("word", "[a-z]* x") and split("License") == ("License", "")
    assert split("words?") == ("word", "s?") and split(r"a\.b\.+") == ("a.b", r"\.+") and split("abc$") == ("abc", "$")
    assert [split(p) for p in ("[a-z]b", "^abc", "(abc)d", r"abc\Gd", "a|b", "a*")] == [None] * 6
