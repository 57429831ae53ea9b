import math
import zlib
from collections import Counter

import numpy as np

from patchmetrics.llm import language_id as li

from .data import SF, empty, odd, small


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_query_on_held_out_rows(spark):
    docs = small()
    out = li.op5_language_id(spark, SF).toPandas().set_index("doc_id")
    assert len(out) == len(docs) and out["score"].between(0, 1).all()
    assert [bool(x) for x in out.loc[docs["doc_id"], "held_out"]] == [held_out(d) for d in docs["doc_id"]]
    test = docs[docs["doc_id"].map(held_out) & docs["lang"].notna()]
    assert (out.loc[test["doc_id"], "lang_pred"].to_numpy() == test["lang"].to_numpy()).mean() > 0.95


def test_counts_and_posterior_against_plain_counting(spark):
    rows = [("en", "the cat"), ("en", "A the!"), ("de", "der Hund"), ("de", ""), (None, "x"), ("fr", None)]
    langs, log_p, log_prior = li.train(spark.createDataFrame(rows, "lang string, text string"))
    assert langs == ["de", "en", "fr"]
    counts = {x: Counter() for x in langs}
    for lang, text in rows:
        if lang:
            for b in li.ngram_buckets(text or ""):
                counts[lang].update(b.tolist())
    for i, lang in enumerate(langs):
        total = sum(counts[lang].values()) + li.ALPHA * li.BUCKETS
        for b in {b for c in counts.values() for b in c}:
            assert math.isclose(log_p[b, i], math.log((counts[lang][b] + li.ALPHA) / total))
    text = "the hund"
    s = [log_prior[i] + sum(log_p[b, i] for part in li.ngram_buckets(text) for b in part) for i in range(3)]
    want = np.exp(np.array(s) - max(s))
    assert np.allclose(li.posterior(text, log_p, log_prior), want / want.sum())


def test_slices_lose_and_repeat_no_ngram(monkeypatch):
    text = "abcdé fgh" * 41
    whole = Counter(np.concatenate(list(li.ngram_buckets(text))).tolist())
    assert sum(whole.values()) == sum(len(text) - n + 1 for n in li.ORDERS)
    for cut in (1, 2, 7, 50):
        monkeypatch.setattr(li, "SLICE", cut)
        assert Counter(np.concatenate(list(li.ngram_buckets(text))).tolist()) == whole


def test_odd_rows_and_empty_table(spark):
    model = li.train(li.training_rows(odd(spark)))
    out = li.identify(odd(spark), model).toPandas()
    assert len(out) == odd(spark).count() and not out["held_out"].isna().any()
    unknown = out.set_index("doc_id").loc[[0, 1, 2, 5]]
    assert (unknown["lang_pred"] == "und").all() and (unknown["score"] == 0).all()
    assert li.identify(empty(spark), li.train(empty(spark))).count() == 0
    assert {r["lang_pred"] for r in li.identify(odd(spark), li.train(empty(spark))).collect()} == {"und"}
    known = li.known_language(odd(spark))
    assert known.columns == odd(spark).columns and not known.where("doc_id in (0, 1, 2, 5)").count()


def test_numerals_are_no_letters():
    for text in ("½²", "①Ⅷ", "12 ³ ¼ ٣", "_ - ・"):
        assert not li.has_letter(text)
        assert li.posterior(text, np.zeros((li.BUCKETS, 2)), np.zeros(2)) is None
    for text in ("ª", "é", "中", "½a"):
        assert li.has_letter(text)
