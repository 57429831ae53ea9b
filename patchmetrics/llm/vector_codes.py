"""Vector code compression: one codebook per quarter of the vector, nearest entries found by equal-average search.

Components become integers ``floor(1024 * x)``; a vector is four equal consecutive parts. Each part position has a
codebook of at most ``ENTRIES`` entries, first those of the smallest vector ids. A round assigns every part to its
nearest entry (squared Euclidean distance, ties to the lower index) and replaces each used entry by the componentwise
floor of its parts' mean; after ``ROUNDS`` rounds the parts are assigned once more.

*Equal-average search*: by Cauchy and Schwarz the squared gap between the component sums of two parts of ``d``
components is at most ``d`` times their squared distance. Entries are sorted by component sum; from the place of a part's
own sum the search goes outward on both sides, ``STRIDE`` entries at a time, and ends on a side when the squared gap
over ``d`` strictly exceeds the best distance so far (an equal one may still hold a tie of lower index).

On Spark: a round is one map over the vectors and one small aggregate. Codebooks travel with the tasks (four times
``ENTRIES`` parts, whatever the number of vectors); a task adds up its own parts per entry and returns only these sums,
which Spark adds. The driver sees sums and codebooks, never vectors (but for the first ``ENTRIES``). The input is read
once per round; pass a stored table.

All arithmetic is in integers and exact for every finite component: sums travel in limbs of 40 bits, and blocks whose
distances could leave 64 bits are reckoned in Python's integers.

Defined cases: vectors that are null or hold null, NaN or infinite components are dropped, as the contract says; a
vector shorter than the longest kept one, and a length that four does not divide, is followed by zeros; rows that
repeat a ``vec_id`` are coded each and are first entries in the order of their components; a null ``vec_id`` comes
last; equal distances take the lower index; null labels are one label; an error beyond 64 bits is stated as the
largest long; an empty table gives an empty result; further columns, whatever their names, are neither read nor
returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
STRIDE = 16              # entries compared at a time on one side
LIMB = 40
BLOCK = 1 << 22          # numbers in one block of differences
LARGEST = (1 << 63) - 1


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``, as 64-bit integers where they are small enough for exact distances, else Python's."""
    if not len(x) or np.abs(x).max() < 2.0 ** 30:
        return np.floor(x.astype(np.float64) * SCALE).astype(np.int64)
    exact = [int(v) * SCALE if abs(v) >= 2.0 ** 53 else int(np.floor(np.float64(v) * SCALE)) for v in x.tolist()]
    return np.array(exact, dtype=object)


def parts_of(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow list column as ``(rows, PARTS, width / PARTS)`` integers, zeros behind short vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = whole_numbers(column.flatten().to_numpy(zero_copy_only=False))
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), PARTS, width // PARTS)
    out = np.zeros((len(sizes), width), values.dtype)
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out.reshape(len(sizes), PARTS, width // PARTS)


def _fits(*arrays: np.ndarray) -> bool:
    """Whether all squared distances and search bounds between the arrays' rows stay within 64 bits."""
    top = max((int(abs(a).max()) for a in arrays if a.size), default=0)
    d = max(1, arrays[0].shape[-1])
    return 4 * top * top * d * d < 1 << 62


class Codebook:
    """The entries of one part position, sorted by component sum for equal-average search."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        sums = entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sorted, self.sums = entries[self.order], sums[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance, for each row of ``parts``."""
        k, d = self.sorted.shape
        rows = max(16, BLOCK // (STRIDE * max(1, d)))
        if len(parts) > rows:
            found = [self.nearest(parts[i:i + rows]) for i in range(0, len(parts), rows)]
            return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        entries, sums, own = self.sorted, self.sums, parts
        if not _fits(parts, entries):
            entries, sums, own = entries.astype(object), sums.astype(object), parts.astype(object)
        x = own.sum(axis=1)
        place = np.searchsorted(sums, x)
        at = np.full(len(own), k, np.int64)
        best = np.zeros(len(own), x.dtype)
        for step in range(0, k, STRIDE):
            for first, way in ((place + step, 1), (place - 1 - step, -1)):
                on = np.flatnonzero((first >= 0) & (first < k))
                gap = sums[first[on]] - x[on]
                on = on[((at[on] == k) | (gap * gap <= best[on] * d)).astype(bool)]
                if not len(on):
                    continue
                near = np.clip(first[on, None] + way * np.arange(STRIDE), 0, k - 1)
                diff = entries[near] - own[on, None, :]
                dist = (diff * diff).sum(axis=2) if diff.dtype == object else np.einsum("rsd,rsd->rs", diff, diff)
                least = dist.min(axis=1)
                index = np.where(dist == least[:, None], self.order[near], k).min(axis=1)
                better = ((at[on] == k) | (least < best[on]) | ((least == best[on]) & (index < at[on]))).astype(bool)
                best[on[better]], at[on[better]] = least[better], index[better]
        return at, best


def _limbs(values: np.ndarray) -> Iterator[np.ndarray]:
    """``values`` as limbs of ``LIMB`` bits, the last one signed."""
    while values.size and not ((values >= -(1 << LIMB)) & (values < 1 << LIMB)).all():
        yield values & ((1 << LIMB) - 1)
        values = values >> LIMB
    yield values


SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("pos", pa.int32()), ("limb", pa.int32()), ("total", pa.int64())])


def _sums(books: list[Codebook], width: int):
    """Map function: count (``pos`` -1) and component sums of the parts of each entry, once a task."""

    def run(batches):
        d = width // PARTS
        totals = [np.zeros((len(b.entries), d + 1), object) for b in books]
        for batch in batches:
            vectors = parts_of(batch.column(0), width)
            for p, book in enumerate(books):
                at, _ = book.nearest(vectors[:, p])
                order = np.argsort(at, kind="stable")
                used, starts, counts = np.unique(at[order], return_index=True, return_counts=True)
                if len(used):
                    totals[p][used, 1:] += np.add.reduceat(vectors[order, p], starts, axis=0)
                    totals[p][used, 0] += counts
        for p, total in enumerate(totals):
            used = np.flatnonzero(total[:, 0])
            for limb, values in enumerate(_limbs(total[used])):
                entry, pos = np.repeat(used, d + 1), np.tile(np.arange(-1, d), len(used))
                yield pa.record_batch([pa.array(np.full(len(entry), p), pa.int32()), pa.array(entry, pa.int32()),
                                       pa.array(pos, pa.int32()), pa.array(np.full(len(entry), limb), pa.int32()),
                                       pa.array(values.ravel().tolist(), pa.int64())], schema=SUMS)

    return run


def _integer_array(rows: list[list[int]], width: int) -> np.ndarray:
    top = max((abs(v) for r in rows for v in r), default=0)
    return np.array(rows, np.int64 if top < 1 << 62 else object).reshape(len(rows), width)


def _next_books(books: list[Codebook], vectors: DataFrame, width: int) -> list[Codebook]:
    sums = (vectors.select("embedding").mapInArrow(_sums(books, width), "part int, entry int, pos int, limb int, total long")
            .groupBy("part", "entry", "pos", "limb").agg(F.sum("total").alias("total")).toArrow())
    found: dict[tuple[int, int], dict[int, int]] = {}
    for p, e, pos, limb, total in zip(*(sums.column(c).to_pylist() for c in ("part", "entry", "pos", "limb", "total"))):
        own = found.setdefault((p, e), {})
        own[pos] = own.get(pos, 0) + (total << (LIMB * limb))
    out, d = [], width // PARTS
    for p, book in enumerate(books):
        rows = book.entries.tolist()
        for e in range(len(rows)):
            if (p, e) in found:
                own = found[p, e]
                rows[e] = [own[i] // own[-1] for i in range(d)]
        out.append(Codebook(_integer_array(rows, d)))
    return out


def _codes(books: list[Codebook], width: int):
    """Map function: ``vec_id, label, code, error`` from ``vec_id, label, embedding``."""

    def run(batches):
        for batch in batches:
            vectors = parts_of(batch.column("embedding"), width)
            found = [book.nearest(vectors[:, p]) for p, book in enumerate(books)]
            code = np.stack([f[0] for f in found], 1).astype(np.uint8) if len(vectors) else np.zeros((0, PARTS), np.uint8)
            error = sum(f[1].astype(object) for f in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()),
                 pa.array([min(int(e), LARGEST) for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def kept_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, label, embedding`` of the rows whose vector is there and has only finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & finite)


def codebooks_digest(books: list[Codebook]) -> str:
    numbers = (str(v) for book in books for entry in book.entries.tolist() for v in entry)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def learn_codebooks(vectors: DataFrame, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[Codebook]:
    """One codebook per part position from ``vectors(vec_id, embedding)`` of at most ``width`` components."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is two hex digits: 1 to 256 entries")
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    seeds = parts_of(first.column(0), width)
    books = [Codebook(seeds[:, p]) for p in range(PARTS)]
    for _ in range(rounds):
        books = _next_books(books, vectors, width)
    return books


def compress(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept row of ``rows(vec_id, embedding, label)``."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "codes")
    vectors = kept_vectors(rows)
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    books = learn_codebooks(vectors, width, entries, rounds)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    coded = scratch.save(vectors.mapInArrow(_codes(books, width),
                                            f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    by_label = scratch.save(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), "labels", narrow=True)
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))
