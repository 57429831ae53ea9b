"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text becomes a sparse vector: hashed distinct words (each ``1 / sqrt(words)``), structure statistics cut into bins
(one-hot) and the ``n_chars`` metadata compared with the text. The machine adds a linear part and all pairwise
interactions of rank ``RANK``; by ``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``
a text is scored in time linear in its features.

Training: AdaGrad on the driver over a bounded hash sample of about ``SAMPLE_ROWS`` labelled rows (documented bound);
features are made on the executors, only sparse vectors travel. Scoring is one pass over whole texts, no shuffle.

Defined cases: null and empty texts have only their structure bins; a null ``n_chars`` has a bin of its own; rows with
a null id are neither held out nor trained on; without labels of both classes every score is the base rate (0.5
without any label); very long texts are read whole; rows that repeat an id are trained on and scored each, an id with
several labels counts by the highest; an empty table gives an empty result; further columns of the input, whatever their
names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, crc32_mod, documents, table
from .quality_rules import repeated_words

WORD_BUCKETS = 1 << 14
RANK = 8
SAMPLE_ROWS = 10_000
EPOCHS = 12
BATCH = 128
# Cut points of the structure statistics; each statistic has one bin more than cuts.
CUTS = {
    "words": (5, 10, 20, 50, 100, 300, 1000, 5000),
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "word_length": (2, 3, 4, 5, 6, 7, 8, 10, 15),
    "upper": (0.01, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "symbols": (0.01, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 3.0),
    "marks": (0.01, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0),
    "digits": (0.001, 0.01, 0.05, 0.1, 0.3),
    "adjacent": (0.01, 0.05, 0.1, 0.3, 0.6),
    "repeated": (0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "dup_lines": (0.01, 0.05, 0.1, 0.2, 0.4, 0.6),
    "line_words": (2, 5, 10, 20, 50, 100),
    "n_chars": (0.5, 0.9, 0.999, 1.001, 1.1, 2.0),
}
_FIRST = {}
_AT = WORD_BUCKETS
for _name, _cuts in CUTS.items():
    _FIRST[_name] = _AT
    _AT += len(_cuts) + 2    # one bin for a missing value
SIZE = _AT


def statistics(text: str, words: list[bytes], n_chars: int | None) -> dict[str, float | None]:
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip(WHITE_SPACE)]
    return {
        "words": len(words), "distinct": len(set(words)) / n, "word_length": chars / n,
        "upper": sum(w.isupper() for w in words) / n, "symbols": sum(map(text.count, "#*$%&|<>{}=~^_@")) / n,
        "marks": sum(map(text.count, "!?")) / n, "digits": sum(map(text.count, "0123456789")) / chars,
        "adjacent": sum(a == b for a, b in zip(words, words[1:])) / n, "repeated": repeated_words(words) / n,
        "dup_lines": 1 - len(set(lines)) / max(1, len(lines)), "line_words": len(words) / max(1, len(lines)),
        "n_chars": None if n_chars is None else n_chars / chars,
    }


class Features:
    def __init__(self):
        self.bucket: dict[bytes, int] = {}

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.encode("utf-8", "surrogatepass").split()
        known = self.bucket
        if len(known) > 200_000:
            known.clear()
        ids = set()
        for w in set(words):
            b = known.get(w)
            if b is None:
                b = known[w] = xxhash.xxh3_64_intdigest(w.lower()) % WORD_BUCKETS
            ids.add(b)
        hashed = np.fromiter(sorted(ids), np.int32, len(ids))
        bins = [_FIRST[k] + (len(CUTS[k]) + 1 if v is None else int(np.searchsorted(CUTS[k], v, "right")))
                for k, v in statistics(text, words, n_chars).items()]
        values = np.ones(len(hashed) + len(bins))
        values[:len(hashed)] = 1 / np.sqrt(max(1, len(hashed)))
        return np.concatenate([hashed, np.array(bins, np.int32)]), values


Model = tuple[float, np.ndarray, np.ndarray]


def fm_logit(ids: np.ndarray, x: np.ndarray, model: Model) -> float:
    w0, w, v = model
    vx = v[ids] * x[:, None]
    s = vx.sum(axis=0)
    return float(w0 + w[ids] @ x + 0.5 * (s @ s - (vx * vx).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1,
        ridge: float = 1e-4, seed: int = 7) -> Model:
    """AdaGrad on the logistic loss; deterministic for the same rows."""
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK))
    if len(y) == 0 or y.min() == y.max():
        base = (y.sum() + 0.5) / (len(y) + 1)
        return float(np.log(base / (1 - base))), w, np.zeros((SIZE, RANK))
    g0, gw, gv = 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, RANK), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            take = order[at:at + BATCH]
            ids = np.concatenate([rows[i][0] for i in take])
            x = np.concatenate([rows[i][1] for i in take])
            starts = np.cumsum([0] + [len(rows[i][0]) for i in take])[:-1]
            row = np.repeat(np.arange(len(take)), [len(rows[i][0]) for i in take])
            vx = v[ids] * x[:, None]
            s = np.add.reduceat(vx, starts)
            z = w0 + np.add.reduceat(w[ids] * x, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) / len(take)
            used, at_used = np.unique(ids, return_inverse=True)
            ex = e[row] * x
            dw = np.bincount(at_used, ex, len(used)) + ridge * w[used]
            per = ex[:, None] * (s[row] - vx)
            dv = np.stack([np.bincount(at_used, per[:, f], len(used)) for f in range(RANK)], 1) + ridge * v[used]
            g0 += e.sum()**2
            w0 -= rate * e.sum() / np.sqrt(g0)
            gw[used] += dw**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            gv[used] += dv**2
            v[used] -= rate * dv / np.sqrt(gv[used])
    return w0, w, v


def _sparse_rows(batches):
    make = Features()
    for part in batches:
        got = [make(t, None if pd.isna(n) else int(n)) for t, n in zip(part["text"], part["n_chars"])]
        yield pd.DataFrame({"y": part["y"], "ids": [g[0] for g in got], "x": [g[1] for g in got]})


def _plain(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       n_chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The machine from training rows (``crc32(doc_id as text) mod 5`` not 0)."""
    marked = (labels.where("quality is not null and doc_id is not null").where(crc32_mod(F.col("doc_id"), 5) != 0)
              .groupBy("doc_id").agg(F.max(F.col("quality").cast("double")).alias("y")))
    share = min(1.0, sample_rows / max(1, marked.count()))
    at = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1_000_000)) / 1_000_000
    rows = (_plain(docs).join(marked.where(at < share), "doc_id").select("doc_id", "text", "n_chars", "y")
            .mapInPandas(_sparse_rows, "y double, ids array<int>, x array<double>").toArrow())
    sparse = [(i.values.to_numpy(), x.values.to_numpy()) for i, x in zip(rows["ids"], rows["x"])]
    y = rows["y"].to_numpy()
    order = sorted(range(len(y)), key=lambda i: (y[i], sparse[i][0].tobytes()))   # the same rows, the same machine
    return fit([sparse[i] for i in order], y[order])


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        make = Features()
        for texts, sizes in parts:
            z = [fm_logit(*make(t, None if pd.isna(n) else int(n)), held.value) for t, n in zip(texts, sizes)]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))))

    held_out = F.coalesce(crc32_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return (_plain(docs).select("doc_id", held_out.alias("held_out"), score("text", "n_chars").alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def op10_quality_fm(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
