import zlib

import numpy as np
from pyspark.sql import functions as F

from patchmetrics.llm import toxicity as tox
from patchmetrics.llm.common import crc32_mod

from .data import auc, empty, odd, small

LEX = tox.seed_lexicon()


def score(text):
    return sum(tox.clause_scores(text, LEX, {})[0])


def test_clauses_weigh_more_or_less_than_the_word():
    plain = score("what an idiot")
    assert score("you are an idiot") > plain > score("he is not an idiot, not an idiot") > 0
    assert score('she said idiot') < plain and score('the word "idiot" is old') < plain
    assert score("i will kill you") > 0 and score("you, i will kill") > score("time will kill")
    assert score("the cat sat") == 0 and score(None) == 0
    assert score("idiot. you went home") == plain          # a clause does not reach into the next


def test_composed_machine_runs_like_its_parts():
    import itertools

    for symbols in itertools.product(tox.SYMBOLS, repeat=4):
        n, r, t, state = 0, (False, False), 0, 0
        for s in symbols:
            n, x = tox._negation(n, s)
            r, x = tox._report(r, x)
            t, x = tox._target(t, x)
            state, out = tox.MACHINE[state, s]
            assert out == x


def test_stems_and_learned_arcs(spark):
    rows = [(f"ora{i} gruntzal{'abcdefgh'[i % 8]} nim{i * 7} dol{i}", 1) for i in range(40)]
    rows += [(f"ora{i} plainword nim{i * 3} dol{i}", 0) for i in range(200)]
    rows += [("copied text of uncommon words", 1)] * 30
    got = tox.learned_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert got["gruntz*"][0] == "insult" and tox.arc_of("gruntzalz", got)[1] > 0
    assert "uncommon" not in got and "plainword" not in got   # copies of one text teach nothing


def test_query_on_held_out_rows(spark):
    docs, labels = small(), small("labels")
    sf = "/root/testdata/sf0.01"
    import pandas as pd

    out = tox.op7_toxicity(spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet").merge(out, on="doc_id")
    test = labels[labels["held_out"]]
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(out["doc_id"], out["held_out"]))
    assert auc(test["score"], test["toxic"]) > 0.9 and out["score"].between(0, 1).all()
    assert ((out["score"] >= 0.5) == (out["predicted"] == 1)).all() and len(docs) == 200


def test_odd_rows_and_empty_table(spark):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 0, 1), (4, None, None), (9, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for marks in (labels, none):
        out = tox.score_toxicity(odd(spark), tox.train(odd(spark), marks)).toPandas()
        assert len(out) == odd(spark).count() and out.drop(columns="doc_id").notna().all().all()
    assert tox.score_toxicity(empty(spark), tox.train(empty(spark), labels)).count() == 0


def test_training_reads_up_to_20_000_rows(spark):
    """A toxic word only in rows that a sample of 10,000 out of 16,000 would not read gets its arc."""
    ids = spark.range(20_500).where(crc32_mod(F.col("id"), 5) != 0)
    at = F.pmod(F.xxhash64("id", F.lit("toxic sample")), F.lit(1_000_000)) / 1_000_000
    fourth = F.pmod(F.xxhash64("id", F.lit("layer")), F.lit(4)) == 0
    rare = [r["id"] for r in ids.where((at > 0.7) & ~fourth).orderBy("id").limit(8).collect()]
    rows = [(i, f"n{i} zorblax today" if i in set(rare) else "a plain line") for i in range(20_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", F.col("text").contains("zorblax").cast("int").alias("toxic"))
    assert "zorblax" in tox.train(docs, labels)[0]


def test_grammar_beats_the_word_list():
    """Texts with the same insults and threats, toxic when aimed, clean when negated, reported or merely named."""
    rng = np.random.default_rng(3)
    insults, threats = tox.SEEDS["insult"].split()[:12], tox.SEEDS["threat"].split()[:6]
    toxic = ["you {i} .", "go away you utter {i} .", "they are {i} and {i} .", "i will {t} you {t}ed them {t} .", "your {i} brother ."]
    clean = ["the word {i} is old .", "he said {i} in the book .", "no {i} here never {t} .", "the play has {i} and a {i} .", "one may {t} weeds ."]
    rows, y = [], []
    for k in range(600):
        forms = toxic if k % 2 else clean
        text = " ".join(forms[rng.integers(len(forms))].format(i=insults[rng.integers(12)], t=threats[rng.integers(6)])
                        for _ in range(rng.integers(1, 4)))
        rows.append("plain words come first . " + text)
        y.append(k % 2)
    y, arcs = np.array(y, float), {}
    x = np.array([tox.features(t, LEX, arcs) for t in rows])
    words = np.zeros_like(x)     # the list: how many words of it a text holds, and their weight
    for k, t in enumerate(rows):
        hits = [LEX[w][1] for w in t.split() if w in LEX and LEX[w][0] in ("insult", "threat")]
        words[k, :2] = np.log1p(len(hits)), np.log1p(sum(hits))
    half = np.arange(len(y)) % 4 < 2
    right = [((tox._layer(f[~half], tox.fit_layer(f[half], y[half])) > 0.5) == y[~half]).mean() for f in (x, words)]
    assert right[0] > 0.95 and right[1] < right[0] - 0.15
