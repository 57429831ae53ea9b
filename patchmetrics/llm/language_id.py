"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of every labelled training row (all rows, no sample): each task counts its own rows
in numpy and returns the non-zero counts, Spark sums them per (language, bucket). The driver turns the sums -- bounded
by languages x ``BUCKETS`` -- into a log-probability matrix and broadcasts it. Scoring gathers the matrix rows of a
text's n-grams in numpy, whole texts in slices of ``SLICE`` characters.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any training row every text is
``und``; rows with a null id or a null language take no part in training; ties go to the first language by code point;
very long texts are counted and scored whole; rows that repeat an id count and are scored each; an empty table gives an
empty result; further columns of the input, whatever their names, are not read, and ``known_language`` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, crc32_mod, documents

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
ALPHA = 0.5              # additive smoothing
SLICE = 1 << 16
UNKNOWN = "und"


def ngram_buckets(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the character n-grams of a lower-cased text, slice by slice; no n-gram is lost at a cut."""
    reach = max(ORDERS) - 1
    t = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for at in range(0, len(t), SLICE):
        x = t[at:at + SLICE + reach]
        h = np.zeros(len(x), np.uint64)
        out = []
        for n in range(1, max(ORDERS) + 1):
            m = min(SLICE, len(x) - n + 1)  # n-grams that start inside this slice
            if m <= 0:
                break
            h = h[:len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1:] + np.uint64(1)
            if n in ORDERS:
                mixed = (h[:m] ^ (h[:m] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out.append((mixed >> np.uint64(32)).astype(np.int64) % BUCKETS)
        yield np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _count(batches):
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for part in blocks(batches):
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            docs[lang] = docs.get(lang, 0) + 1
            into = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for b in ngram_buckets(text or ""):
                into += np.bincount(b, minlength=BUCKETS)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.record_batch([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()),
                               pa.array(np.append(c[at], docs[lang]), pa.int64())], schema=schema)


def train(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (``BUCKETS`` x languages) and log-priors from ``rows(lang, text)``."""
    sums = (rows.where("lang is not null").select(F.col("lang").cast("string").alias("lang"),
                                                  F.col("text").cast("string").alias("text"))
            .mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
            .toArrow().to_pandas())
    langs = sorted(sums["lang"].unique())
    counts, docs = np.zeros((BUCKETS, len(langs))), np.ones(len(langs))
    for i, lang in enumerate(langs):
        own = sums[sums["lang"] == lang]
        seen = own[own["bucket"] >= 0]
        counts[seen["bucket"], i] = seen["n"]
        docs[i] += own.loc[own["bucket"] < 0, "n"].sum()
    counts += ALPHA
    return langs, np.log(counts / counts.sum(axis=0, keepdims=True)), np.log(docs / docs.sum())


def posterior(text: str | None, log_p: np.ndarray, log_prior: np.ndarray) -> np.ndarray | None:
    """Posterior over the languages; None for a text without a letter."""
    if not text or not len(log_prior) or not has_letter(text):
        return None
    s = log_prior.copy()
    for b in ngram_buckets(text):
        s += log_p[b].sum(axis=0)
    e = np.exp(s - s.max())
    return e / e.sum()


def predictor(spark: SparkSession, model) -> "callable":
    """Column function ``text -> struct(lang_pred, score)`` around a broadcast model."""
    langs, log_p, log_prior = model
    held = spark.sparkContext.broadcast((langs, log_p, log_prior))

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, p, prior = held.value
        for texts in parts:
            pred, score = [], []
            for text in texts:
                q = posterior(text, p, prior)
                pred.append(UNKNOWN if q is None else names[int(q.argmax())])
                score.append(0.0 if q is None else min(1.0, float(q.max())))
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    return lambda col: predict(col.cast("string"))


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows whose ``crc32(doc_id as text) mod 3`` is not 1."""
    return docs.where(crc32_mod(F.col("doc_id"), 3) != 1)


def identify(docs: DataFrame, model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``."""
    predict = predictor(docs.sparkSession, model)
    held_out: Column = F.coalesce(crc32_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return (docs.select("doc_id", held_out.alias("held_out"), predict(F.col("text")).alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))


def known_language(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is recognised (not ``und``, posterior at least ``least_score``), unchanged."""
    held = docs.sparkSession.sparkContext.broadcast(train(training_rows(docs))[1:])

    def run(batches):
        for part in blocks(batches):
            found = (posterior(t, *held.value) for t in part.column("text").cast(pa.string()).to_pylist())
            yield part.filter(pa.array([q is not None and float(q.max()) >= least_score for q in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(training_rows(docs)))
