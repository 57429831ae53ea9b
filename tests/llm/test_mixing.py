import random
import re

import pytest

from patchmetrics.llm import mixing
from patchmetrics.llm.common import Scratch

from .data import SF, empty, odd, small


def targets(sizes):
    """Water filling by hand: reshare the excess of full sources until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    got, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return got | {s: left * weight[s] / total for s in open_}
        for s in over:
            got[s] = 2.0 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return got


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, source_of):
    per, want = {}, {}
    for r in rows:
        s = source_of[r["doc_id"]]
        want[s] = want.get(s, 0) + r["size"]
        per.setdefault(s, []).append(r)
    goal = targets(want)
    for s, own in per.items():
        taken, largest = sum(r["taken"] for r in own), max(r["size"] for r in own)
        assert all(r["source_size"] == want[s] and r["target"] == pytest.approx(goal[s]) for r in own)
        assert all(r["taken"] % r["size"] == 0 and r["taken"] <= 2 * r["size"] if r["size"] else r["taken"] == 0 for r in own)
        assert goal[s] - largest - 1e-6 <= taken <= goal[s] + 1e-6
        if goal[s] >= want[s]:
            assert all(r["taken"] >= r["size"] for r in own)   # a complete epoch comes first


def test_query_meets_the_targets_and_reruns_agree(spark):
    docs = small()
    rows = mixing.op4_mix_sources(spark, SF).collect()
    assert {r["doc_id"]: r["size"] for r in rows} == {d: size(t) for d, t in zip(docs["doc_id"], docs["text"])}
    check(rows, dict(zip(docs["doc_id"], docs["source"])))
    assert sorted(map(tuple, mixing.op4_mix_sources(spark, SF).collect())) == sorted(map(tuple, rows))


def test_uneven_sources(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), ["big", "tiny", None, "Z", "é"][0 if i < 300 else i % 5]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mixing.sample_words(df, Scratch(spark, "t")).collect(), {r[0]: r[2] for r in rows})


def test_no_document_that_fits_is_passed_over(spark):
    rng = random.Random(2)
    rows = [(i, "w " * min(20_000, 1 + int(rng.lognormvariate(3, 2.5))), f"s{i % 20:02d}") for i in range(1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    per = {}
    for r in mixing.sample_words(df, Scratch(spark, "t")).collect():
        per.setdefault(rows[r["doc_id"]][2], []).append(r)
    for own in per.values():
        left = own[0]["target"] - sum(r["taken"] for r in own)
        epochs = int(own[0]["target"] / own[0]["source_size"] + 1e-12)
        assert left > -1e-6 and all(r["size"] > left for r in own if r["size"] and r["taken"] == epochs * r["size"])


def test_better_texts_come_first(spark):
    rows = [(i, ("good words here " if i % 2 else "b### a### c### ") * 20, "abc"[i // 800]) for i in range(2400)]
    got = mixing.sample_words(spark.createDataFrame(rows, "doc_id long, text string, source string"), Scratch(spark, "t")).collect()
    part = [r for r in got if 800 <= r["doc_id"] < 1600]    # the source whose target is a fraction of it
    good, bad = (sum(r["taken"] > 0 for r in part if r["doc_id"] % 2 == k) / 400 for k in (1, 0))
    assert good > bad + 0.2


def test_mix_repeats_rows(spark):
    df = spark.createDataFrame([(i, "some words of text", "ab"[i % 2], 18) for i in range(40)],
                               "doc_id long, text string, source string, copies int")
    words = mixing.sample_words(df, Scratch(spark, "t")).toPandas()
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() * 4 == words["taken"].sum()
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert copies == {d: c for d, c in zip(words["doc_id"], words["copies"]) if c}


def test_mix_takes_what_the_sample_takes(spark):
    """Sources of many sizes with runs that fill in small documents, empty texts and a null source."""
    rng = random.Random(8)
    rows = [(i, "w " * min(3000, int(rng.lognormvariate(3, 2))), rng.choice([None, "a", "b", "c", "d"])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r["doc_id"]: r["copies"] for r in mixing.sample_words(df, Scratch(spark, "t")).collect() if r["taken"]}
    got = {r["doc_id"]: r["count"] for r in mixing.mix(df).groupBy("doc_id").count().collect()}
    assert got == want


def test_odd_rows_and_empty_table(spark):
    out = mixing.sample_words(odd(spark), Scratch(spark, "t")).toPandas()
    assert len(out) == odd(spark).count() and out.drop(columns="doc_id").notna().all().all()
    assert (out["taken"] <= 2 * out["size"]).all()
    assert mixing.mix(odd(spark)).columns == odd(spark).columns
    assert mixing.sample_words(empty(spark), Scratch(spark, "t")).count() == 0
    nothing = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.sample_words(nothing, Scratch(spark, "t")).collect()] == [0, 0]
