"""Token counts by a map-side lookup of two tiers.

The vocabulary's normaliser and splitter treat runs without ASCII white space apart from each other (its special strings
hold no white space either), so a text has as many tokens as its runs have. A run of printable ASCII characters and
letters of U+00C0 to U+00FF, without a special string's opening, is cut further into the splitter's own pieces of its
lower-case form; any other run stays whole. These pieces and whole runs are the *pre-tokens*, each encoded by itself by
the library. That makes lengths worth keeping:

1. *Tier one*: a compact table (``TABLE_WORDS`` entries at most: one UTF-8 blob and 16-bit lengths) of the pre-tokens
   that are frequent in a sample of about ``SAMPLE_DOCS`` whole documents. The tasks return the frequent pre-tokens of
   their share of the sample (``TASK_WORDS`` at most), the driver sums them, encodes the table once and broadcasts it.
   The sample decides which lookups are fast, never a result.
2. *Tier two*: what the table does not hold is encoded by the library, all misses of a block of texts in one call, and
   kept in the worker's own cache (``CACHE_WORDS`` entries, emptied when full; pre-tokens longer than ``CACHED_CHARS``
   are encoded each time).

Counting is one narrow map over the documents: no pre-token is ever shuffled.

Defined cases: null and empty texts (and texts of white space alone) have no token; null texts have 0 bytes; very long
texts are counted whole, also when they are one enormous pre-token; repeated rows and rows without an id are counted
each; an empty table gives an empty result; equally frequent pre-tokens enter the table in code-point order; further
columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents

LIMIT = 2048
SAMPLE_DOCS = 4096
TABLE_WORDS = 1 << 16
TASK_WORDS = 1 << 13
CACHE_WORDS = 1 << 18
CACHED_CHARS = 64
SEED = 13
_RUN = re.compile(r"[^ \t-\r]+")
_ODD = re.compile(r"[^ \t-\r!-~À-ÖØ-öø-ÿ]|<\|")       # what keeps a run whole
# Fixed value: the splitter's rule, over the characters that are cut.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-z0-9ß-öø-ÿ]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a whole text, in order."""
    if not _ODD.search(text):
        return _PIECE.findall(text.lower())
    out: list[str] = []
    for run in _RUN.findall(text):
        if _ODD.search(run):
            out.append(run)
        else:
            out += _PIECE.findall(run.lower())
    return out


class Lengths:
    """Token numbers of pre-tokens: the shared table, then the cache of this worker, then the library."""

    def __init__(self, path: str, blob: bytes = b"", sizes: np.ndarray | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.table = dict(zip(blob.decode().split("\n"), sizes.tolist())) if blob else {}
        self.cache: dict[str, int] = {}

    def encode(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def count(self, texts: Iterable[str | None]) -> list[int]:
        """Token numbers of whole texts."""
        table, cache = self.table, self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        totals, misses, open_words = [], {}, []
        for i, text in enumerate(texts):
            words = pre_tokens(text or "")
            known = list(map(table.get, words))
            n = sum(filter(None, known))
            for w in (w for w, k in zip(words, known) if k is None):
                k = cache.get(w)
                if k is None:
                    open_words.append((i, misses.setdefault(w, len(misses))))
                else:
                    n += k
            totals.append(n)
        if misses:
            sizes = self.encode(list(misses))
            for i, m in open_words:
                totals[i] += sizes[m]
            cache.update((w, k) for w, k in zip(misses, sizes) if len(w) <= CACHED_CHARS)
        return totals


_WORKER: dict[int, Lengths] = {}


def _lengths(held, path: str) -> Lengths:
    """The worker process's one ``Lengths`` of a broadcast table; tasks of other queries replace it."""
    if held.value[0] not in _WORKER:
        _WORKER.clear()
        _WORKER[held.value[0]] = Lengths(path, *held.value[1:])
    return _WORKER[held.value[0]]


def _frequent(batches) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for part in blocks(batches):
        for text in part.column("text").to_pylist():
            counts.update(w for w in pre_tokens(text or "") if len(w) <= CACHED_CHARS)
    if counts:
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:TASK_WORDS]
        yield pa.RecordBatch.from_pydict({"words": pa.array(["\n".join(w for w, _ in top)]),
                                          "n": pa.array([[n for _, n in top]], pa.list_(pa.int64()))})


def frequent_words(texts: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """At most ``TABLE_WORDS`` pre-tokens, the most frequent ones of about ``sample_docs`` rows of ``texts(text)``."""
    share = min(1.0, sample_docs / max(1, texts.count()))
    counts: Counter[str] = Counter()
    for r in texts.sample(False, share, SEED).mapInArrow(_frequent, "words string, n array<long>").toLocalIterator():
        counts.update(dict(zip(r["words"].split("\n"), r["n"])))
    return [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:TABLE_WORDS]]


def token_counter(spark: SparkSession, words: list[str], vocabulary: str) -> "callable":
    """Column function ``text -> number of tokens`` around the broadcast table of ``words``."""
    blob = "\n".join(words).encode()
    sizes = np.array(Lengths(vocabulary).encode(words), np.uint16)
    held = spark.sparkContext.broadcast((os.urandom(8), blob, sizes))

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = _lengths(held, vocabulary)
        for texts in parts:
            out: list[int] = []
            for at in range(0, len(texts), 256):
                out += lengths.count(texts.iloc[at:at + 256])
            yield pd.Series(out, dtype="int64")

    return lambda col: count(col.cast("string"))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``."""
    vocabulary = vocabulary or default_vocabulary()
    text: Column = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text"))
    tokens = token_counter(docs.sparkSession, frequent_words(texts.select("text")), vocabulary)
    return (texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), tokens(F.col("text")).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
