"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is cut into letters of up to four non-space characters (words restart the cut, so an edit is forgotten at the
next space). In a longer run without spaces, a character that ``RUN`` others follow is a letter by itself and the last
``RUN`` are cut in fours, counted from the run's end: an edit before them moves no cut, one inside them spoils at most
``RUN / 4`` letters. A window of ``K`` letters is an anchor when the smallest letter hash inside it stands at its first or its
last place -- a choice that looks at nothing outside the window, so equal passages give equal anchors wherever they
stand. The fingerprint is the list of anchor hashes in text order; likeness is the Dice overlap of two anchor sets.

The next document (descending id) comes from one shuffle of the texts: rows go to id ranges from approximate
quantiles, each range is ordered by itself, and the largest document of a range is also copied to the range above, so
no order spans a task. The ranges and the copied ids are as many as partitions.

Defined cases: a null text is empty; an empty text has the empty fingerprint; a text of fewer than ``K`` letters has
the hash of all its letters as only anchor; two empty fingerprints are alike (1.0), an empty and another are not
(0.0); null ids order after all others, rows repeating an id order by the hash of their text; a single document is its
own next one; an empty table gives an empty result; very long texts are fingerprinted whole; of equal smallest hashes in a window
one at either edge makes an anchor; further columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, shuffle_partitions

K = 8
RUN = 96                 # a multiple of four
LETTER = rf"\S(?=\S{{{RUN}}})|\S{{1,4}}"
COARSE = 64
NO_ID = -(1 << 63)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def anchors(text: Column, k: int = K) -> Column:
    """Anchor hashes (the high 32 bits, as int) of a text, in text order."""
    def short(x: Column) -> Column:
        return F.shiftright(F.xxhash64(x), 32).cast("int")

    hashes = F.transform(F.regexp_extract_all(text, F.lit(LETTER), 0), lambda w: F.xxhash64(w))

    def chosen(h: Column) -> Column:
        def is_anchor(i: Column) -> Column:
            return let(F.array_min(F.slice(h, i, k)), lambda low: (low == h[i - 1]) | (low == h[i + (k - 2)]))

        starts = F.filter(F.sequence(F.lit(1), F.size(h) - (k - 1)), is_anchor)
        windows = F.transform(starts, lambda i: short(F.slice(h, i, k)))
        whole = F.array(short(h))
        return (F.when(F.size(h) == 0, F.array().cast("array<int>")).when(F.size(h) < k, whole).otherwise(windows))

    return let(hashes, chosen)


def fingerprint_text(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda x: F.right(F.concat(F.lit("0000000"), F.hex(x)), F.lit(8))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Dice overlap of two anchor lists, 0 to 1."""
    sizes = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(sizes == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) * 2.0 / sizes)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds not above ``key``, in two short steps."""
    coarse = F.array(*[F.lit(b) for b in bounds[::COARSE]]).cast("array<bigint>")
    fine = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")

    def inside(c: Column) -> Column:
        return F.when(c == 0, F.lit(0)).otherwise(
            (c - 1) * COARSE + F.size(F.filter(F.slice(fine, (c - 1) * COARSE + 1, COARSE), lambda b: b <= key)))

    return let(F.size(F.filter(coarse, lambda b: b <= key)), inside)


def with_next(docs: DataFrame, order: str, payload: list[str]) -> DataFrame:
    """Add ``next``, the ``payload`` struct of the following row in descending ``order`` (cyclic), to each row."""
    spark = docs.sparkSession
    n = 2 * shuffle_partitions(spark)
    key = F.coalesce(F.col(order), F.lit(NO_ID))
    keys = docs.select(key.alias("k"))
    bounds = sorted({int(b) for b in keys.approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n)})
    largest = dict(keys.groupBy(_bucket(F.col("k"), bounds).alias("b")).agg(F.max("k")).collect())
    ranges = sorted(largest)
    copies = [(largest[b], above, 0) for b, above in zip(ranges, ranges[1:])]
    copies += [(largest[ranges[-1]], ranges[0], 1)] if ranges else []
    copied = spark.createDataFrame(copies, "_k long, _to int, _wrap int")
    copied = copied.groupBy("_k").agg(F.collect_list(F.struct("_to", "_wrap")).alias("_copies"))
    own = F.struct(_bucket(key, bounds).alias("_to"), F.lit(0).alias("_wrap"), F.lit(False).alias("_copy"))
    more = F.transform(F.coalesce("_copies", F.array().cast("array<struct<_to:int,_wrap:int>>")),
                       lambda c: F.struct(c["_to"].alias("_to"), c["_wrap"].alias("_wrap"),
                                          F.lit(True).alias("_copy")))
    placed = (docs.withColumn("_k", key).join(F.broadcast(copied), "_k", "left")
              .withColumn("_place", F.explode(F.concat(F.array(own), more))).drop("_copies"))
    w = (Window.partitionBy("_place._to")
         .orderBy("_place._wrap", F.desc("_k"), F.xxhash64(*payload), "_place._copy"))
    return (placed.withColumn("next", F.lead(F.struct(*payload)).over(w))
            .where(~F.col("_place._copy")).drop("_place", "_k"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(plain.withColumn("marks", anchors(F.col("text"))), "doc_id", ["text", "marks"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    rows = (rows.withColumn("edited", edited)
            .select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "marks",
                    anchors(F.col("edited")).alias("edited_marks"), F.col("next.marks").alias("next_marks")))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("marks")).alias("fingerprint"),
                       fingerprint_text(F.col("edited_marks")).alias("edited_fingerprint"),
                       likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
                       likeness(F.col("marks"), F.col("next_marks")).alias("near_next"))


def op2_syncmer_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
