"""Rows of the learned queries on a small table against plain Python: language, toxicity and quality."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from patchmetrics.llm import language_id as li
from patchmetrics.llm import quality_fm as fm
from patchmetrics.llm import toxicity as tox
from patchmetrics.llm.common import documents, table

from .data import SF, small
from .test_quality import brute as counts_of


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def grams(text):
    """Hash buckets of all 1- to 3-grams, one by one."""
    points = [ord(c) for c in text.lower()]
    for i in range(len(points)):
        h = 0
        for c in points[i:i + 3]:
            h = (h * 0x100000001B3 + c + 1) % 2**64
            yield ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64 >> 32) % li.BUCKETS


def test_language_rows(spark):
    docs = small()
    own = {d: Counter(grams(t or "")) for d, t in zip(docs["doc_id"], docs["text"])}
    seen, rows = {}, Counter()
    for d, lang in zip(docs["doc_id"], docs["lang"]):
        if isinstance(lang, str) and remainder(d, 3) != 1:
            seen.setdefault(lang, Counter()).update(own[d])
            rows[lang] += 1
    langs = sorted(seen)
    total = {x: sum(seen[x].values()) + li.ALPHA * li.BUCKETS for x in langs}
    prior = sum(rows[x] + 1 for x in langs)
    got = {r["doc_id"]: r for r in li.op5_language_id(spark, SF).collect()}
    assert got.keys() == set(docs["doc_id"])
    for d, text in zip(docs["doc_id"], docs["text"]):
        r = got[d]
        assert r["held_out"] == (remainder(d, 3) == 1)
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        s = [math.log((rows[x] + 1) / prior) + sum(n * math.log((seen[x][b] + li.ALPHA) / total[x]) for b, n in own[d].items()) for x in langs]
        e = [math.exp(v - max(s)) for v in s]
        assert r["lang_pred"] == langs[s.index(max(s))] and abs(r["score"] - max(e) / sum(e)) < 1e-6


def plain_outputs(text, lexicon):
    """Per clause, the class and weight of every word after the three rules, applied one after the other."""
    clauses, clause = [], []
    for token in re.findall(r"\w+|[.!?;\n\"“”«»]", (text or "").lower()):
        if token in ".!?;\n":
            clauses.append(clause)
            clause = []
            continue
        arc = ("quote", 0.0) if token in "\"“”«»" else tox.arc_of(token, lexicon) or ("word", 0.0)
        clause.append(arc)
    clauses.append(clause)
    for clause in [c for c in clauses if c]:
        kinds = [k for k, _ in clause]
        negated = [any(kinds[j] == "negation" for j in range(max(0, i - tox.NEGATION_REACH), i)) for i in range(len(kinds))]
        kinds = ["negated" if k in ("insult", "threat") and no else k for k, no in zip(kinds, negated)]
        told = ["report" in kinds[:i] or kinds[:i].count("quote") % 2 == 1 for i in range(len(kinds))]
        kinds = ["quoted" if k in ("insult", "threat") and q else k for k, q in zip(kinds, told)]
        aimed = [any(kinds[j] == "target" for j in range(max(0, i - tox.TARGET_REACH), i)) for i in range(len(kinds))]
        kinds = [f"aimed {k}" if k in ("insult", "threat") and a else k for k, a in zip(kinds, aimed)]
        yield [(k, w) for k, (_, w) in zip(kinds, clause)]


def test_toxicity_rows(spark):
    docs = small()
    lexicon, layer = tox.train(documents(spark, SF), table(spark, SF, "labels"))
    got = {r["doc_id"]: r for r in tox.op7_toxicity(spark, SF).collect()}
    assert got.keys() == set(docs["doc_id"])
    matched = 0
    for d, text in zip(docs["doc_id"], docs["text"]):
        clauses = list(plain_outputs(text, lexicon))
        scores = [s for s in (sum(tox.FACTOR.get(k, 0.0) * w for k, w in c) for c in clauses) if s > 0]
        matched += bool(scores)
        x = [math.log1p(sum(scores)), max(scores, default=0.0), math.log1p(len(scores)), len(scores) / max(1, len(clauses))]
        x += [math.log1p(sum(w for c in clauses for k, w in c if k == kind)) for kind in tox.FACTOR]
        want = 1 / (1 + math.exp(-max(-30, min(30, layer[0] + sum(a * b for a, b in zip(layer[1:], x))))))
        r = got[d]
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(want >= 0.5) and r["held_out"] == (remainder(d, 5) == 0)
    assert matched > 5


def plain_bins(text, n_chars):
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, repeated = max(1, len(words)), max(1, len(text)), counts_of(text)[4]
    raw = [w.encode() for w in words]
    stats = {"words": len(words), "distinct": len(set(words)) / n, "word_length": chars / n, "upper": sum(w.isupper() for w in raw) / n,
             "symbols": len(re.findall(r"[#*$%&|<>{}=~^_@]", text)) / n, "marks": len(re.findall("[!?]", text)) / n,
             "digits": len(re.findall("[0-9]", text)) / chars, "adjacent": sum(a == b for a, b in zip(words, words[1:])) / n,
             "repeated": repeated / n, "dup_lines": 1 - len(set(lines)) / max(1, len(lines)),
             "line_words": len(words) / max(1, len(lines)), "n_chars": n_chars / chars}
    at, out = fm.WORD_BUCKETS, []
    for name, cuts in fm.CUTS.items():
        out.append(at + sum(stats[name] >= c for c in cuts))
        at += len(cuts) + 2
    return sorted({xxhash.xxh3_64_intdigest(w.lower()) % fm.WORD_BUCKETS for w in raw}), out


def test_quality_rows(spark):
    docs = small()
    w0, w, v = fm.train(documents(spark, SF), table(spark, SF, "labels"))
    got = {r["doc_id"]: r for r in fm.op10_quality_fm(spark, SF).collect()}
    assert got.keys() == set(docs["doc_id"])
    for d, text, n_chars in zip(docs["doc_id"], docs["text"], docs["n_chars"]):
        hashed, bins = plain_bins(text or "", int(n_chars))
        ids = hashed + bins
        x = np.array([1 / math.sqrt(max(1, len(hashed)))] * len(hashed) + [1.0] * len(bins))
        pairs = (v[ids] @ v[ids].T) * np.outer(x, x)       # every pairwise interaction by itself
        z = w0 + w[ids] @ x + np.triu(pairs, 1).sum()
        want = 1 / (1 + math.exp(-max(-30, min(30, z))))
        r = got[d]
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(want >= 0.3) and r["held_out"] == (remainder(d, 5) == 0)
