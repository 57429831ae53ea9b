"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides about further spans.

Base spans follow fixed patterns per kind and always stand. Looser patterns propose further spans (obfuscated
addresses, numbers glued to other numbers, national forms). Every candidate gets a vote (+1, -1 or 0 for no opinion)
from each labeler of its kind: the strict pattern, the shape, a gazetteer and the context. Spark counts the vote
patterns over all documents -- a bounded table, since votes and shape bins are few -- and expectation-maximisation
over these counts estimates each labeler's reliability and the probability of every pattern. A logistic span
classifier is then trained on those probabilities with votes and shape bins as features, and accepts further spans of
at least ``ACCEPT`` that touch no base span.

Texts are read whole, twice (count, apply), without a shuffle of text. All patterns run in linear time.

Defined cases: a null text is empty; an empty text has no span; overlapping candidates of a kind are taken leftmost
first; rows repeating or lacking a ``doc_id`` are handled one by one; an empty
table gives an empty result and a classifier that accepts nothing further; patterns of equal votes are judged alike; further
columns of the input, whatever their names, are not read, and ``redacted`` passes them through.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, documents

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
EM_STEPS = 50
REACH = 24               # characters of context that a labeler sees on either side

# Gazetteers and context words.
TLDS = frozenset("com org net edu gov mil int info biz io co de fr es uk eu us ca ch at it nl be se no dk fi pl pt ru "
                 "cn jp kr in br mx au nz app dev ai example test".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 "
                          "64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
FOR = {
    "email": re.compile(r"mail|contact|write to|kontakt|correo|courriel|schreib", re.I),
    "ip": re.compile(r"\bip\b|addr|host|server|client|login|serveur|servidor", re.I),
    "card": re.compile(r"card|visa|master|amex|karte|tarjeta|carte|payment|credit", re.I),
    "phone": re.compile(r"call|phone|tel|mobile|fax|whatsapp|anruf|llama|appel", re.I),
}
AGAINST = re.compile(r"version|release|build|order|invoice|isbn|issn|ticket|serial|sku|token|hash|\bid\b|№", re.I)

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOOSE = {
    "email": re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?[A-Za-z0-9-]{1,63}"
                        r"(?:\s?(?:[\[({]\s?(?:dot|DOT|\.)\s?[\])}]|\.)\s?[A-Za-z0-9-]{1,63}){1,4}"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}(?![0-9.])"
                     r"|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20.-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:(?:\+|00)[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-]"
                        r"[0-9]{3,4}(?![0-9])"),
}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _valid(kind: str, s: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))
    d = digits_of(s)
    return 13 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind, failing ones dropped; by kind, then start."""
    out: list[Span] = []
    free = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            free = m.end()
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return out


def votes(kind: str, s: str, left: str, right: str, base: bool) -> tuple[int, int, int, int, int]:
    """Opinions of the labelers: strict pattern, shape, gazetteer, context words, neighbours."""
    strict = 1 if base else 0
    d = digits_of(s)
    if kind == "email":
        last = re.split(r"\.|dot|DOT", s)[-1].strip(" ])}").lower()
        shape = 1 if re.match(r"[A-Za-z0-9]", s) and ".." not in s else -1
        known = 1 if last in TLDS else -1
    elif kind == "ip":
        parts = [p for p in re.split(r"[^0-9]+", s) if p] if ":" not in s else []
        shape = 1 if ":" in s or all(len(p) <= 3 and int(p) <= 255 for p in parts) else -1
        known = 0 if ":" in s else -1 if parts and parts[0] in ("0", "1", "2", "3") or set(parts) <= {"0"} else 1
    elif kind == "card":
        shape = 1 if 13 <= len(d) <= 19 and luhn(d) else -1
        known = 1 if d[:1] in ("4", "6") or d[:2] in ("34", "37", "36", "38") or "51" <= d[:2] <= "55" or "22" <= d[:2] <= "27" else -1
    else:
        shape = 1 if 9 <= len(d) <= 15 and ("(" in s or "+" in s or s.startswith("00")) else -1
        code = d[2:] if s.startswith("00") else d
        known = (1 if any(code.startswith(c) for c in COUNTRY_CODES) else -1) if s.startswith(("+", "00")) else 0
    context = 1 if FOR[kind].search(left) else -1 if AGAINST.search(left) else 0
    glued = left[-1:].isalnum() or right[:1].isalnum() or left[-1:] in "=/_#" and left != "" or right[:1] in "/_=" and right != ""
    return strict, shape, known, context, -1 if glued else 1


def shape_bin(kind: str, s: str) -> str:
    """A few bins: length in steps of four up to 32, and whether separators or brackets occur."""
    return f"{min(len(s) // 4, 8)}{'s' if re.search('[ .-]', s) else ''}{'b' if re.search(r'[()\[\]{}]', s) else ''}{'p' if s[:1] == '+' else ''}"


def candidates(text: str) -> tuple[list[Span], list[tuple[Span, str]], list[tuple[Span, str]]]:
    """Base spans; base spans with their keys; further candidates (touching no base span) with their keys.

    A key is ``kind|votes|shape`` and is all that EM and the classifier see.
    """
    base = base_spans(text)
    if not base and not _DIGIT.search(text) and not re.search(r"[\[({]\s?(?:at|AT|@)\s?[\])}]", text):
        return base, [], []
    taken = sorted((s, e) for _, s, e in base)

    def key(span: Span, strict: bool) -> str:
        kind, s, e = span
        got = votes(kind, text[s:e], text[max(0, s - REACH):s], text[e:e + REACH], strict)
        return f"{kind}|{','.join(map(str, got))}|{shape_bin(kind, text[s:e])}"

    more = []
    for kind in KINDS:
        i = 0
        for m in _LOOSE[kind].finditer(text):
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            if not any(s < m.end() for s, _ in taken[i:i + 1]):
                span = (kind, m.start(), m.end())
                more.append((span, key(span, False)))
    return base, [(b, key(b, True)) for b in base], more


# ---------------------------------------------------------------- model

def expectation_maximisation(counts: dict[str, int]) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """Probability of each key to be personal data, and per kind the labelers' ``P(vote | label)`` tables."""
    prob: dict[str, float] = {}
    reliability: dict[str, np.ndarray] = {}
    for kind in KINDS:
        keys = sorted(k for k in counts if k.startswith(kind + "|"))
        if not keys:
            continue
        v = np.array([[int(x) for x in k.split("|")[1].split(",")] for k in keys]) + 1
        n = np.array([counts[k] for k in keys], float)
        q = np.clip(0.5 + 0.2 * (v - 1).sum(1), 0.05, 0.95)       # start: the majority
        for _ in range(EM_STEPS):
            prior = ((n * q).sum() + 1) / (n.sum() + 2)
            p = np.zeros((2, v.shape[1], 3))
            for label, w in ((1, n * q), (0, n * (1 - q))):
                for j in range(v.shape[1]):
                    c = np.bincount(v[:, j], w, 3)
                    # Smoothing holds every labeler to be better than chance: a vote leans to its own label.
                    c += np.array([0.2, 0.5, 1.0]) if label else np.array([1.0, 0.5, 0.2])
                    p[label, j] = c / c.sum()
            j = np.arange(v.shape[1])
            odds = np.log(prior / (1 - prior)) + (np.log(p[1, j, v]) - np.log(p[0, j, v])).sum(1)
            q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        reliability[kind] = p
        prob |= dict(zip(keys, q.tolist()))
    return prob, reliability


def key_features(key: str) -> list[str]:
    kind, vote, shape = key.split("|")
    return [kind] + [f"{kind}:{j}={v}" for j, v in enumerate(vote.split(","))] + [f"{kind}:{shape}"]


def train_classifier(counts: dict[str, int], prob: dict[str, float], ridge: float = 0.1, steps: int = 25) -> dict[str, float]:
    """Logistic weights of the key features, fitted to EM's probabilities (keys weigh by the log of their count)."""
    keys = sorted(prob)
    names = sorted({f for k in keys for f in key_features(k)})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(keys), len(names)))
    for i, k in enumerate(keys):
        x[i, [at[f] for f in key_features(k)]] = 1
    y, n = np.array([prob[k] for k in keys]), np.log1p([counts[k] for k in keys])
    w = np.zeros(len(names))
    for _ in range(steps if len(keys) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
    return dict(zip(names, w.tolist()))


def span_probability(key: str, weights: dict[str, float]) -> float:
    z = sum(weights.get(f, 0.0) for f in key_features(key))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _count_keys(batches):
    total: Counter = Counter()
    for part in blocks(batches):
        for t in part.column("text").to_pylist():
            _, base, more = candidates(t or "")
            total.update(k for _, k in base)
            total.update(k for _, k in more)
    yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["key", "n"])


def train(docs: DataFrame) -> dict[str, float]:
    """Classifier weights from the vote patterns of all documents (the table of patterns is bounded)."""
    rows = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_keys, "key string, n long")
            .groupBy("key").agg(F.sum("n").alias("n")).collect())
    counts = {r["key"]: r["n"] for r in rows}
    return train_classifier(counts, expectation_maximisation(counts)[0])


def find_spans(text: str | None, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, each by kind and start."""
    base, _, more = candidates(text or "")
    added = [s for s, key in more if span_probability(key, weights) >= ACCEPT]
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda s: (order[s[0]], s[1]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _report(weights: dict[str, float]):
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS],
                        ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        for part in blocks(batches):
            rows = []
            for t in part.column("text").to_pylist():
                base, spans = find_spans(t, weights)
                n = Counter(k for k, _, _ in base)
                rows.append((*[n[k] for k in KINDS], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.record_batch([part.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:])]],
                                  schema=schema)

    return run


def personal_data(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``doc_id``, base counts, ``base_sha256`` and all ``spans`` of every row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_report(weights), "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS)
                            + ", base_sha256 string, spans string")


def redact_text(text: str | None, weights: dict[str, float]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first span in brackets."""
    if not text:
        return text
    spans = sorted((s, e, k) for k, s, e in find_spans(text, weights)[1])
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; ``n_chars``, where present, follows the new text."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches):
        for part in blocks(batches):
            clean = pa.array([redact_text(t, held.value) for t in part.column("text").to_pylist()], pa.string())
            yield part.set_column(part.schema.get_field_index("text"), "text", clean)

    plain = docs.withColumn("text", F.col("text").cast("string"))
    out = plain.mapInArrow(run, plain.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return personal_data(docs, train(docs))
