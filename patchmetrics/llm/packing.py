"""Best-fit packing: length patterns fitted to the length histogram by non-negative least squares.

1. One pass tokenizes every whole text and cuts only documents longer than a sequence; a short first piece, then full
   ones. Only narrow piece rows are written.
2. The histogram of piece lengths (at most ``max_len`` numbers) goes to the driver. Patterns of one to three lengths
   that fill a sequence exactly are enumerated, their repeat counts are fitted to the histogram by non-negative least
   squares. The fit is an active-set one with column generation, so it rests on few patterns with large counts (no
   more than there are lengths) instead of spreading over all of them. Counts are rounded to the nearest, held to the
   pieces still there, and once more by one where pieces are left. What is left then is packed best-fit decreasing, on
   counts per length, never piece by piece. Patterns of the smallest counts are given back to the residuals where that
   saves sequences.
3. Pieces of one length are interchangeable: each is numbered within its length (hash buckets split a hot length) and
   finds its sequence and offset in the plan by its number. The plan's size is bounded by ``max_len`` alone.

Defined cases: null and empty texts are the one end token; very long texts are encoded whole and cut; an empty table
gives an empty result; rows repeating a ``doc_id`` (also null) are packed each, with equal pieces; pieces of equal length
are numbered by id, piece and ids; further columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks, documents, shuffle_partitions

MAX_LEN = 1024
END_ID = 2
ROUNDS, COARSE = 24, 8   # times that the fit takes in new patterns
SHARES = (0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1)   # of the pattern sequences that may be given back
SPECIAL = {"<|endoftext|>": 50256}   # fixed value: the vocabulary's one special token


def default_ranks() -> str:
    """The merge ranks of ``byte_bpe_50k``: the same vocabulary and the same ids as its ``.json`` twin."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """32-bit ids of a text, equal to those of the ``tokenizers`` file of the vocabulary (a test holds both together).

    The rank-file encoder takes a quarter of the time, and no longer for a text that is one enormous word. It refuses
    (``ValueError``) a run of about a million white-space characters; such a text is encoded whole with the
    ``tokenizers`` file, the ``.json`` twin beside the rank file, read at the first such text.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.twin, self.tokenizer = path.removesuffix(".tiktoken") + ".json", None
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens=SPECIAL)

    def __call__(self, text: str) -> bytes:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        except ValueError:
            return self.whole(text)

    def whole(self, text: str) -> bytes:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.twin)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_WORKER: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The one encoder of this worker process."""
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


def _pieces(path: str, max_len: int, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())])
    end, width = np.array([end_id], "<u4").tobytes(), 4 * max_len

    def run(batches):
        encode = _encoder(path)
        for part in blocks(batches):
            out = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = encode(text or "") + end
                cuts = [0, *range(len(ids) % width or width, len(ids) + 1, width)]
                out += [(doc, i, a // 4, (b - a) // 4, zlib.crc32(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def patterns(hist: np.ndarray, max_len: int) -> np.ndarray:
    """All patterns of two or three lengths of ``hist`` (descending, padded with 0) that fill ``max_len`` exactly."""
    have = np.flatnonzero(hist[1:max_len]) + 1
    a, b = np.meshgrid(have, np.append(0, have), indexing="ij")
    c = max_len - a - b
    keep = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[keep], b[keep], c[keep]
    keep = (c == 0) | (hist[c] > 0)
    return np.stack([a[keep], b[keep], c[keep]], 1)


def fit_repeats(pats: np.ndarray, hist: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares: ``(patterns in use, repeats)`` with ``sum_p x_p [lengths of p]`` near ``hist``.

    Lengths count by their size, since a long piece left over costs more room. A round takes in the patterns of the
    steepest descent that share no length and solves for all patterns in use; what would go below zero leaves (at once in
    the first ``COARSE`` rounds, later one step at a time, as active-set methods do).
    """
    size = len(hist)
    weight = np.arange(size) / (size - 1)
    goal = hist * weight
    used, x, matrix = np.zeros(0, np.int64), np.zeros(0), np.zeros((size, 0))
    for turn in range(rounds):
        gradient = (weight * (goal - matrix @ x))[pats].sum(axis=1)
        gradient[used] = 0
        new, taken = [], np.zeros(size, bool)
        for p in np.argsort(-gradient, kind="stable")[:20 * size]:
            if gradient[p] <= 1e-6:
                break
            lengths = pats[p][pats[p] > 0]
            if not taken[lengths].any():
                taken[lengths] = True
                new.append(p)
        if not new:
            break
        used, x = np.append(used, new), np.append(x, np.zeros(len(new)))
        matrix = np.zeros((size, len(used)))
        for j in range(3):
            np.add.at(matrix, (pats[used, j], np.arange(len(used))), weight[pats[used, j]])
        square, right = matrix.T @ matrix, matrix.T @ goal
        square[np.diag_indices(len(used))] += 1e-8
        while len(used):
            best = np.linalg.solve(square, right)
            low = best <= 1e-9
            if not low.any():
                x = best
                break
            if turn < COARSE:
                used, x, matrix, square, right = used[~low], best[~low], matrix[:, ~low], square[~low][:, ~low], right[~low]
                continue
            # Go towards the solution until the first repeats reach zero; their patterns leave.
            x = x + np.min(x[low] / np.maximum(x[low] - best[low], 1e-300)) * (best - x)
            keep = ~low | (x > 1e-9)
            used, x, matrix, square, right = used[keep], x[keep], matrix[:, keep], square[keep][:, keep], right[keep]
    return used, x


def round_repeats(pats: np.ndarray, x: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Whole repeats of each pattern, near ``x`` and never more than ``hist`` holds pieces for."""
    left, times = hist.copy(), np.zeros(len(pats), np.int64)

    def take(p: int, n: int) -> None:
        lengths, each = np.unique(pats[p][pats[p] > 0], return_counts=True)
        n = int(min(n, (left[lengths] // each).min()))
        left[lengths] -= n * each
        times[p] += n

    for p in np.argsort(-x, kind="stable"):
        take(p, int(np.rint(x[p])))
    for p in np.argsort(-(x % 1), kind="stable"):
        take(p, 1)
    return times


def best_fit(hist: np.ndarray, max_len: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on counts: ``(((length, times), ...), sequences)`` groups that hold all of ``hist``."""
    spaces: dict[int, list[list]] = {}   # free room -> [[contents, sequences], ...]
    for length in range(max_len, 0, -1):
        left = int(hist[length])
        while left:
            fit = min((s for s in spaces if s >= length), default=None)
            if fit is None:
                each = min(left, max_len // length)
                group = [((length, each),), left // each]
                left -= each * group[1]
                spaces.setdefault(max_len - each * length, []).append(group)
                continue
            contents, n = spaces[fit].pop()
            if not spaces[fit]:
                del spaces[fit]
            each = min(left, fit // length)
            used = min(n, left // each)
            left -= used * each
            spaces.setdefault(fit - each * length, []).append([(*contents, (length, each)), used])
            if used < n:
                spaces.setdefault(fit, []).append([contents, n - used])
    return [(tuple(c), n) for groups in spaces.values() for c, n in groups]


def pattern_groups(hist: np.ndarray, max_len: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """``(((length, times), ...), sequences)`` groups that hold all of ``hist``: fitted patterns, then packed residuals."""
    left = hist.copy()
    full, left[max_len] = int(left[max_len]), 0
    pats = patterns(left, max_len)
    used, x = fit_repeats(pats, left.astype(float)) if len(pats) else (np.zeros(0, np.int64), np.zeros(0))
    pats = pats[used]
    times = round_repeats(pats, x, left)
    order, best = np.argsort(times, kind="stable"), None
    for share in SHARES:                        # patterns of the smallest counts first
        kept, give = times.copy(), int(share * times.sum())
        for p in order:
            back = min(give, int(kept[p]))
            kept[p], give = kept[p] - back, give - back
        rest = left.copy()
        for j in range(3):
            np.subtract.at(rest, pats[:, j], np.where(pats[:, j] > 0, kept, 0))
        residual = best_fit(rest, max_len)
        total = int(kept.sum()) + sum(n for _, n in residual)
        if best is None or total < best[0]:
            best = total, kept, residual
    _, kept, residual = best
    groups = [(((max_len, 1),), full)] if full else []
    for p, n in zip(pats, kept):
        if n:
            lengths, each = np.unique(p[p > 0], return_counts=True)
            groups.append((tuple(zip(lengths.tolist(), each.tolist())), int(n)))
    return groups + residual


def plan(hist: np.ndarray, max_len: int = MAX_LEN) -> dict[int, np.ndarray]:
    """For each length, rows ``(first number, first sequence, times in a sequence, offset)`` in order of number."""
    groups = pattern_groups(hist.astype(np.int64), max_len)
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    first = 0
    for contents, n in groups:
        offset = 0
        for length, times in contents:
            at = given.get(length, 0)
            rows.setdefault(length, []).append((at, first, times, offset))
            given[length] = at + n * times
            offset += length * times
        first += n
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def place(numbered: DataFrame, spark: SparkSession, where: dict[int, np.ndarray]) -> DataFrame:
    held = spark.sparkContext.broadcast(where)

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        lengths, numbers = length.to_numpy(), number.to_numpy()
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            rows = held.value[int(n)]
            row = rows[np.searchsorted(rows[:, 0], numbers[at], "right") - 1]
            step = numbers[at] - row[:, 0]
            seq[at] = row[:, 1] + step // row[:, 2]
            off[at] = row[:, 3] + step % row[:, 2] * n
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return numbered.withColumn("_at", find("length", "number"))


def pack(docs: DataFrame, ranks: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.save(texts.mapInArrow(_pieces(ranks or default_ranks(), max_len, end_id),
                                           "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    parts = max(64, shuffle_partitions(spark))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    pieces = pieces.withColumn("bucket", bucket)
    counts = scratch.save(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts", narrow=True)
    hist = np.zeros(max_len + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        hist[r["length"]] = r["n"]
    before = (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before")
    shifts = counts.select("length", "bucket", before)   # at most max_len x parts rows
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (pieces.withColumn("own", F.row_number().over(own)).join(F.broadcast(shifts), ["length", "bucket"])
                .withColumn("number", F.col("own") + F.col("before") - 1))
    return place(numbered, spark, plan(hist, max_len)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")


def op3_pattern_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
