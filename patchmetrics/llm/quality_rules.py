"""Host-level quality rules: rule failures by domain, empirical-Bayes shrinkage, verdicts joined back.

A document's own rules decide ``base_failed``. The failures of each host (``source``; a null source is a host of its
own) are taken as beta-binomial: the prior's mean ``m`` is the failure rate of all documents, its strength follows from the
variance of the host rates *beyond* what sampling alone gives (analysis of variance; without such an excess the prior is as
strong as can be and all hosts get rates near ``m``). A host is judged bad, and all its documents go, when its posterior
rate less ``SIGMAS`` posterior deviations still exceeds ``min(2 m, (1 + m) / 2)``: twice the usual rate, or half way from it to
1. So a small host is judged by the prior, a large one by its own record, and hosts that differ by chance only are left.

The per-text work is one Arrow pass; repeated 8-word windows are found exactly by naming windows of 1, 2, 4 and 8
words through ``np.unique`` (no hashing of windows). Failures are pre-aggregated before the shuffle, and the verdicts
of rejected hosts -- one row each -- are joined by the source, with skewed sources split.

Defined cases: null or empty texts have no words and fail; very long texts are measured whole; an empty table gives an
empty result; repeated rows count each; a null ``doc_id`` is carried along; a single host is never judged; further columns
of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, Scratch, blocks, documents

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SIGMAS = 2.33            # one-sided 99 per cent
TIMES = 2.0              # a bad host fails so many times as often as all documents
STRONGEST = 1e6          # prior strength, in documents, where hosts differ by chance only

_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words lying in an 8-word window that occurs at least twice (its first occurrence included)."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    name = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    span = 1
    while span < WINDOW:  # names of windows twice as long, from pairs of names; names stay below n
        name = np.unique(name[:-span] * np.int64(n) + name[span:], return_inverse=True)[1]
        span *= 2
    twice = np.flatnonzero(np.bincount(name)[name] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of one text, in the order of ``_FIELDS``."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(WHITE_SPACE):
            dup += line in seen
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, WHITE_SPACE)), sum(map(text.count, "#*$%&|<>")), dup,
            repeated_words(words))


def _measure(batches):
    for part in blocks(batches):
        rows = [measure(t) for t in part.column("text").to_pylist()]
        cols = list(zip(*rows)) if rows else [()] * len(_FIELDS)
        yield pa.record_batch([part.column("doc_id"), part.column("source"), *[pa.array(c, pa.int64()) for c in cols]],
                              names=["doc_id", "source", *_FIELDS])


def host_rates(marks: DataFrame) -> DataFrame:
    """``source, n, failed, rate, bad``: each host's posterior failure rate and verdict."""
    hosts = marks.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    n, f = F.col("n"), F.col("failed")
    all_, bad, count, squares = hosts.agg(F.sum(n), F.sum(f), F.count("*"), F.sum(n.cast("double") * n)).first()
    m = bad / all_ if all_ else 0.0
    within, spread = m * (1 - m), (all_ - squares / all_) if all_ else 0.0
    between = hosts.agg(F.sum(n * F.pow(f / n - F.lit(m), 2))).first()[0] or 0.0
    excess = (between - (count - 1) * within) / spread if spread > 0 else 0.0
    strength = min(STRONGEST, max(1.0, within / excess - 1)) if excess > 0 else STRONGEST
    a, b = f + F.lit(strength * m), n - f + F.lit(strength * (1 - m))
    rate, total = a / (a + b), a + b
    deviation = F.sqrt(a * b / (total * total * (total + 1)))
    limit = min(TIMES * m, (1 + m) / 2)
    return hosts.select("source", "n", "failed", rate.alias("rate"), (rate - SIGMAS * deviation > limit).alias("bad"))


def host_rules(docs: DataFrame) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed``, ``kept`` and the host's shrunken ``host_rate``."""
    scratch = Scratch(docs.sparkSession, "host-rules")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.col("text").cast("string").alias("text"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    marks = scratch.save(plain.mapInArrow(_measure, "doc_id long, source string, " + ", ".join(f"{f} long" for f in _FIELDS))
                         .withColumn("base_failed", failed), "marks")
    hosts = scratch.save(host_rates(marks).select(F.col("source").alias("host"), F.col("rate").alias("host_rate"), "bad"), "hosts",
                         narrow=True)
    out = marks.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    return out.select("doc_id", *_FIELDS, "base_failed", (~F.col("base_failed") & ~F.col("bad")).alias("kept"), "host_rate")


def op9_host_rules(spark, sf_dir: str) -> DataFrame:
    return host_rules(documents(spark, sf_dir)).drop("host_rate")
