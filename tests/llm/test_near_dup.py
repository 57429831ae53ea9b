import random

import numpy as np
import pandas as pd

from patchmetrics.llm import near_dup

from .data import SF, empty, odd, small


def shingles(text, size):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def brute(ids, texts, size, percent):
    sets = [shingles(t, size) for t in texts]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(ids[i]), find(ids[j])))
                root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in zip(ids, sets)}


def rows(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query_is_the_brute_force_result(spark):
    docs = small()
    assert rows(near_dup.op8_near_dedup(spark, SF)) == brute(docs["doc_id"].tolist(), docs["text"].tolist(), 3, 85)


def test_groups_chains_and_shared_passages(spark):
    """Copies, near copies of one text, chains whose ends are not linked, and a passage that many texts share."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base, shared = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = [" ".join(base)] * 5
    for _ in range(40):
        t = list(base)
        for at in rng.sample(range(120), 2):
            t[at] = word()
        texts.append(" ".join(t))
    chain = [word() for _ in range(100)]
    for i in range(12):
        texts.append(" ".join(chain))
        chain[i * 5] = word()
    texts += [" ".join(shared + [word() for _ in range(80)]) for _ in range(15)]
    texts += ["one two", "ONE two", "one", "", None, "one\ttwo"]
    rng.shuffle(texts)
    ids = rng.sample(range(10_000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    for size, percent in ((3, 85), (5, 80)):
        got = rows(near_dup.near_duplicates(df, size, percent))
        assert got == brute(ids, texts, size, percent)


def test_components_of_a_random_graph(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["id"]: r["component"] for r in near_dup.connected_components(
        spark.createDataFrame(edges, "u long, v long"), near_dup.Scratch(spark, "test")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        before = dict(root)
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
        if root == before:
            break
    assert got == {x: r for x, r in root.items() if x != r}


def test_signature_agreement_estimates_likeness():
    a, b = near_dup.universal(600)
    x = np.random.default_rng(1).integers(0, 2**63, 3000, np.uint64)
    one, two = near_dup.signature(x[:2000], a, b), near_dup.signature(x[1000:], a, b)
    assert abs((one == two).mean() - 1 / 3) < 0.08
    assert (1 - 0.85**near_dup.ROWS) ** near_dup.bands_for(0.85) <= near_dup.MISS


def test_odd_rows_and_empty_table(spark):
    out = near_dup.near_duplicates(odd(spark), 3, 85).toPandas()
    assert len(out) == odd(spark).count() and out["kept"].notna().all()
    assert out.loc[out["doc_id"].isna(), "kept"].all()
    assert set(out.loc[out["doc_id"] == 11, "component_id"]) == {10}
    assert near_dup.near_duplicates(empty(spark)).count() == 0
    left = near_dup.one_of_each(odd(spark))
    assert left.columns == odd(spark).columns
    ids = pd.Series([r["doc_id"] for r in left.select("doc_id").collect()])
    assert ids.isna().sum() == 2 and not ids.dropna().duplicated().any() and 11 not in set(ids.dropna())


def test_distinct_texts_of_one_id_stay(spark):
    one, two, three = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(5, one), (5, two), (5, one), (5, two + " end"), (3, three), (9, one), (4, three), (7, "alone")]
    left = near_dup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(map(tuple, left.collect()))
    assert [r for r in got if r[0] != 5] == [(3, three), (7, "alone")]
    mine = [t for d, t in got if d == 5]
    assert len(mine) == 2 and one in mine and (two in mine or two + " end" in mine)
