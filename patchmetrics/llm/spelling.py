"""Spelling variant grouping: near words found by k-d trees over letter-count vectors.

Words are counted over all texts by Spark. Two words are near if they differ by exactly one inserted, deleted or replaced
code point. One edit moves the vector of letter counts by at most two in L1 distance, and more exactly: between words of
equal length one count goes up and one goes down by one; from a word to a word one longer, one count goes up.

1. *Trees.* For each word length a k-d tree splits the box of count vectors at counts of one letter (the letter whose
   split is most even). Its upper part, the *router*, is fitted to a sample of about ``SAMPLE_WORDS`` words and has a
   leaf for every ``LEAF_WORDS`` words of the table (``LEAF_SAMPLE`` words of the sample at least). Every word is
   indexed: it goes to the one leaf whose box holds it.
2. *Range searches per length pair.* A word asks the tree of its own length and that of the next length. A split passes
   a search on to every side that one count up (and, for equal lengths, one count down) can reach; all other boxes are
   pruned. The router does so when Spark sends searches to leaves, and a finer tree built inside each leaf goes on in
   numpy, down to buckets of ``BUCKET`` words.
3. *Verification.* Pairs whose counts fit are compared letter by letter.

A task holds one leaf and the searches that reach it; what it returns is one row per word met (number of near words and
the best of them), which Spark sums. Forms are followed to their roots by pointer doubling over the table of forms. The
searches are complete: no link is lost, and no bucket, word or leaf has a cap.

Defined cases: null and empty texts hold no word; a null id counts as the empty text in the hashed ``<doc_id>:<run>``;
very long texts are read whole and very long words searched like others; repeated rows count again; equal ``n`` go to
the word smaller in code-point order; an empty table, or one without a frequent word, gives an empty result; further
columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELETE_EVERY = 199        # fixed value of the word rule
LEAST_CHARS = 6
LEAST_COUNT = 5
FORM_RATIO = 5            # a form is at least so many times as frequent
LETTERS = 26 + 64         # a-z, then U+00C0 to U+00FF
SAMPLE_WORDS = 1 << 15
LEAF_WORDS = 2048
LEAF_SAMPLE = 16
BUCKET = 48
BLOCK = 1 << 22           # numbers in one block of differences


def words_of(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the frequent words of all texts, one code point deleted where the rule says so."""
    text: Column = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"),
                       F.explode(F.regexp_extract_all(text, F.lit(RUN), 0)).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run"))
    cut = (h % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), cut), F.substring(F.col("run"), cut + 2, F.length("run")))
    word = F.when(h % DELETE_EVERY == 0, short).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).where(F.length("word") >= least_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))


# ------------------------------------------------------------------------------------------------ letter counts, trees
def code_points(words: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]


def letter_counts(words: list[str]) -> np.ndarray:
    """``(words, LETTERS)`` counts of each word's letters."""
    points = code_points(words)
    sizes = np.array([len(p) for p in points], np.int64)
    flat = np.concatenate(points).astype(np.int64) if points else np.zeros(0, np.int64)
    letter = np.where(flat < 0xC0, flat - ord("a"), flat - 0xC0 + 26)
    row = np.repeat(np.arange(len(words)), sizes)
    return np.bincount(row * LETTERS + letter, minlength=len(words) * LETTERS).reshape(len(words), LETTERS).astype(np.int32)


class Tree:
    """A k-d tree over count vectors: node ``i`` is a leaf (``dim`` -1) or sends counts up to ``cut`` of letter ``dim`` to
    its low child, higher counts to its high child."""

    def __init__(self, counts: np.ndarray, leaf: int):
        self.dim, self.cut, self.low, self.high, self.rows = [], [], [], [], []
        waiting = [self._node(np.arange(len(counts)))]
        while waiting:
            node = waiting.pop()
            rows = self.rows[node]
            split = self._split(counts[rows]) if len(rows) > leaf else None
            if split:
                self.dim[node], self.cut[node] = split
                low = counts[rows, split[0]] <= split[1]
                self.low[node], self.high[node], self.rows[node] = self._node(rows[low]), self._node(rows[~low]), None
                waiting += [self.low[node], self.high[node]]

    def _node(self, rows: np.ndarray) -> int:
        for field, value in ((self.dim, -1), (self.cut, 0), (self.low, 0), (self.high, 0), (self.rows, rows)):
            field.append(value)
        return len(self.dim) - 1

    @staticmethod
    def _split(own: np.ndarray) -> tuple[int, int] | None:
        """The letter and count whose split is most even (at a letter's lower median or just under it); None if all
        vectors are equal."""
        middle = np.partition(own, (len(own) - 1) // 2, axis=0)[(len(own) - 1) // 2]
        share = np.stack([(own <= c).mean(axis=0) for c in (middle, middle - 1)])
        which, dim = np.unravel_index(np.argmin(np.abs(share - 0.5)), share.shape)
        return (int(dim), int(middle[dim] - which)) if 0 < share[which, dim] < 1 else None

    def place(self, counts: np.ndarray) -> np.ndarray:
        """The leaf whose box holds each row."""
        at = np.zeros(len(counts), np.int32)
        for leaf, rows in self.reach(counts, 0, 0):
            at[rows] = leaf
        return at

    def reach(self, counts: np.ndarray, ups: int, downs: int) -> Iterator[tuple[int, np.ndarray]]:
        """``(leaf, rows)``: the rows whose search meets the leaf's box with at most ``ups`` counts raised by one and
        ``downs`` counts lowered by one. Boxes are pruned by their distance from the row, upward and downward."""
        stack = [(0, np.arange(len(counts)), np.zeros((len(counts), 2), np.int32), {})]
        while stack:
            node, rows, used, box = stack.pop()
            dim, cut = self.dim[node], self.cut[node]
            if dim < 0:
                if len(rows):
                    yield node, rows
                continue
            lo, hi = box.get(dim, (0, 1 << 30))
            for child, inner in ((self.low[node], (lo, cut)), (self.high[node], (cut + 1, hi))):
                own = counts[rows, dim]
                now = used.copy()
                now[:, 0] += np.maximum(inner[0] - own, 0) - np.maximum(lo - own, 0)
                now[:, 1] += np.maximum(own - inner[1], 0) - np.maximum(own - hi, 0)
                on = (now[:, 0] <= ups) & (now[:, 1] <= downs)
                if on.any():
                    stack.append((child, rows[on], now[on], {**box, dim: inner}))


def near_pairs(words: list[str], asking: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(index in asking, index in words)`` of near pairs; ``words`` are of one length, ``asking`` of that length or of
    one less. Every near pair comes once."""
    if not words or not asking:
        return
    longer = len(words[0]) > len(asking[0])
    have, want = letter_counts(words), letter_counts(asking)
    seen = np.flatnonzero(have.any(axis=0) | want.any(axis=0))     # other letters decide nothing here
    have, want = have[:, seen], want[:, seen]
    letters, asked = np.stack(code_points(words)), np.stack(code_points(asking))
    tree = Tree(have, BUCKET)
    # Between the counts of words of these lengths the differences sum to 0 (or 1), so a squared distance of 2 (or 1) is
    # one count up and one down (or one count up): no other vector has it.
    x, y = have.astype(np.float64), want.astype(np.float64)
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    for leaf, rows in tree.reach(want, 1, 0 if longer else 1):
        bucket = tree.rows[leaf]
        step = max(1, BLOCK // len(bucket))
        for i in range(0, len(rows), step):
            some = rows[i:i + step]
            gap = yy[some][:, None] + xx[bucket][None] - 2 * (y[some] @ x[bucket].T)
            q, w = np.nonzero(gap == (1 if longer else 2))
            q, w = some[q], bucket[w]
            for j in range(0, len(q), max(1, BLOCK // letters.shape[1])):
                a, b = q[j:j + max(1, BLOCK // letters.shape[1])], w[j:j + max(1, BLOCK // letters.shape[1])]
                near = one_edit(asked[a], letters[b])
                if near.any():
                    yield a[near], b[near]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``b`` come from rows of ``a`` by one replaced letter (equal widths) or one inserted letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.cumprod(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= a.shape[1]


# ------------------------------------------------------------------------------------------------ on Spark
def _vectors(batches):
    for batch in batches:
        words = batch.column(0).to_pylist()
        counts = letter_counts(words)
        yield pa.RecordBatch.from_pydict({
            "size": pa.array([len(w) for w in words], pa.int32()),
            "counts": pa.array([c.tobytes() for c in counts], pa.binary())})


def fit_routers(words: DataFrame, n_words: int, sample_words: int, leaf_words: int) -> dict[int, Tree]:
    """One router per word length of a sample of about ``sample_words`` of the ``n_words`` words."""
    every = max(1, -(-n_words // sample_words))
    some = words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word")
    sample = some.mapInArrow(_vectors, "size int, counts binary").toArrow().to_pandas()
    routers = {}
    for size, own in sample.groupby("size"):
        counts = np.frombuffer(b"".join(sorted(own["counts"])), np.int32).reshape(-1, LETTERS)
        routers[int(size)] = Tree(counts, max(LEAF_SAMPLE if every > 1 else 1, leaf_words // every))
    for tree in routers.values():
        tree.rows = None
    return routers


def _route(held):
    """Map function: ``size, leaf, asks, word, n``; a word once as itself and once for each leaf that its search reaches."""
    names = ["size", "leaf", "asks", "word", "n"]

    def run(batches):
        routers = held.value
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            sizes = np.array([len(w) for w in words], np.int32)
            counts = letter_counts(words)
            out = []     # (rows, size, leaf, asks)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                tree = routers.get(int(size))
                out.append((own, size, tree.place(counts[own]) if tree else np.zeros(len(own), np.int32), False))
                for to, downs in ((size, 1), (size + 1, 0)):
                    tree = routers.get(int(to))
                    if tree is None:
                        out.append((own, to, np.zeros(len(own), np.int32), True))
                        continue
                    for leaf, rows in tree.reach(counts[own], 1, downs):
                        out.append((own[rows], to, np.full(len(rows), leaf, np.int32), True))
            for rows, size, leaf, asks in out:
                for i in range(0, len(rows), 10_000):
                    at = rows[i:i + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), size), pa.int32()), pa.array(leaf[i:i + 10_000], pa.int32()),
                         pa.array([asks] * len(at)), pa.array([words[j] for j in at], pa.string()), pa.array(n[at], pa.int64())], names=names)

    return run


def _search(leaf: pd.DataFrame) -> pd.DataFrame:
    """One leaf: for each word met, its number of near words here and the best of them."""
    own = leaf[~leaf["asks"]]
    have, have_n = own["word"].tolist(), own["n"].tolist()
    met: dict[str, tuple[int, int, str]] = {}     # word -> number, minus the best's n, best

    def meet(word: str, near: str, near_n: int) -> None:
        number, minus, best = met.get(word, (0, 1, ""))
        met[word] = (number + 1, *min((minus, best), (-near_n, near)))

    for _, group in leaf[leaf["asks"]].groupby(leaf["word"].str.len()):
        asking, asking_n = group["word"].tolist(), group["n"].tolist()
        both = bool(have) and len(asking[0]) != len(have[0])   # pairs of unequal length are met from one side only
        for asked, found in near_pairs(have, asking):
            for q, w in zip(asked.tolist(), found.tolist()):
                meet(asking[q], have[w], have_n[w])
                if both:
                    meet(have[w], asking[q], asking_n[q])
    rows = [(word, number, -minus, best) for word, (number, minus, best) in met.items()]
    columns = list(zip(*rows)) or [()] * 4
    return pd.DataFrame({c: pd.Series(v, dtype=kind) for c, v, kind in zip(
        ("word", "n_near", "near_n", "near"), columns, ("object", "int64", "int64", "object"))})


def near_words(words: DataFrame, sample_words: int = SAMPLE_WORDS, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """``word, n_near, near_n, near`` of the words of ``words(word, n)`` that have a near word; ``near`` is the most
    frequent one (ties: smallest)."""
    spark = words.sparkSession
    held = spark.sparkContext.broadcast(fit_routers(words, words.count(), sample_words, leaf_words))
    routed = words.mapInArrow(_route(held), "size int, leaf int, asks boolean, word string, n long")
    met = routed.groupBy("size", "leaf").applyInPandas(_search, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    return (met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
            .select("word", "n_near", (-F.col("best.minus")).alias("near_n"), F.col("best.near").alias("near")))


def roots_of(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` from ``word, form`` by pointer doubling: each round doubles the length of the chains behind it.

    A form is more frequent than its word, so there is no cycle and the rounds end.
    """
    at = scratch.save(forms.select("word", F.col("form").alias("root")), "roots", narrow=True)
    while True:
        ahead = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        moved = scratch.save(at.join(ahead, F.col("root") == F.col("_w"), "left").select(
            "word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")), "roots", narrow=True)
        at = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return at


def spelling_groups(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT,
                    ratio: int = FORM_RATIO, sample_words: int = SAMPLE_WORDS, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every frequent word of ``docs(doc_id, text)``."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(words_of(docs, least_chars, least_count), "words")
    found = scratch.save(near_words(words, sample_words, leaf_words), "near")
    is_form = F.col("near_n") >= ratio * F.col("n")
    known = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    known = scratch.save(known, "known")
    roots = roots_of(known.where("form IS NOT NULL").select("word", "form"), scratch)
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_groups(documents(spark, sf_dir))
