"""ordered churn between two versions of a document, as a patience difference over line tables.

Definition (our own): lines are matched in rounds, within gaps. A gap is a stretch of both versions without matched lines
between two matched ones; at first the whole document is one gap. In a round, each gap

1. matches its longest common prefix and then its longest common suffix, line by line;
2. in what is left, takes the lines that occur exactly once on either side as anchors and matches a longest
   selection of them that keeps the order of both sides;
3. falls into the smaller gaps between these matches, or is settled when it has no anchor or no line on one side.

A settled gap of ``d`` lines before and ``i`` lines after counts as ``max(d, i)``: a replacement is as long as its longer
side. ``churn`` is the sum over the gaps. Equal versions have churn 0; where no line repeats, the matched lines are a longest
common subsequence; and churn is never below the order-free bound of ``churn.multiset_line_churn``.

On Spark no document is an array: prefixes and suffixes are minima over offsets, anchors one aggregate over line hashes.
Anchors that follow each other on both sides form a run, and a selection holds all of a run or nothing of it, so only
the ends of runs (about as many as edits) are gathered per gap, for a weighted longest increasing selection with a prefix
maximum tree; anchors find their run, and lines their new gap, by blocks of positions. Line texts are read once; later
rounds hold hashes (md5) of the lines in gaps that are still open.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import materialize
from .sequence import sequence_within

BLOCK = 1024     # positions of a block


def heaviest_increasing(j: list[int], weight: list[int]) -> list[int]:
    """Indices of a selection with increasing ``j`` and the largest total weight; ties go to the earlier predecessor."""
    places = sorted(j)
    best: list[tuple[int, int]] = [(0, 0)] * (len(j) + 1)     # prefix maxima of (weight, -index - 1)
    before, total = [-1] * len(j), [0] * len(j)
    for k, (x, w) in enumerate(zip(j, weight)):
        at, top = bisect.bisect_left(places, x), (0, 0)
        while at > 0:
            top = max(top, best[at])
            at &= at - 1
        before[k], total[k] = (-top[1] - 1 if top[0] else -1), top[0] + w
        at = bisect.bisect_left(places, x) + 1
        while at <= len(j):
            best[at] = max(best[at], (total[k], -k - 1))
            at += at & -at
    k = max(range(len(j)), key=lambda x: (total[x], -x), default=-1)
    out = []
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _choose(rj: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    """Per gap, the places of the chosen runs: ``rj`` of their first anchors, ``lo`` and ``hi`` their first and last ``ri``."""
    def of_gap(js, a, b):
        if (js[1:] > js[:-1]).all():
            return list(range(len(js)))       # no run crosses another: all of them
        return heaviest_increasing(js.tolist(), (b - a + 1).tolist())
    return pd.Series([of_gap(*x) for x in zip(rj, lo, hi)], dtype="object")


def chosen_runs(ends: DataFrame) -> DataFrame:
    """``_k, _g, lo, hi`` of the chosen runs, from the ends ``_k, _g, ri, rj, first, last`` of all runs.

    A gap is one row with the ends of its runs, and Python takes whole batches of such rows: most gaps are a few runs, and
    there are more gaps than documents.
    """
    of = lambda end, *cols: F.array_sort(F.collect_list(F.when(F.col(end), F.struct(*cols))))
    gaps = ends.groupBy("_k", "_g").agg(of("first", "ri", "rj").alias("_starts"), of("last", "ri").alias("_stops"))
    lists = gaps.select("_k", "_g", F.col("_starts.ri").alias("lo"), F.col("_stops.ri").alias("hi"), F.col("_starts.rj").alias("rj"))
    return lists.withColumn("_c", _choose("rj", "lo", "hi")).select("_k", "_g", F.explode(F.transform(
        "_c", lambda i: F.struct(F.get("lo", i).alias("lo"), F.get("hi", i).alias("hi")))).alias("_r")).select("_k", "_g", "_r.lo", "_r.hi")


def _anchors(rest: DataFrame) -> DataFrame:
    """``_k, _g, i, j`` of the matched anchors of ``rest(_k, _g, _side, _pos, _h)``."""
    one = lambda side: F.count_if(F.col("_side") == side)
    at = lambda side: F.min(F.when(F.col("_side") == side, F.col("_pos")))
    unique = (rest.groupBy("_k", "_g", "_h").agg(one("b").alias("nb"), one("a").alias("na"), at("b").alias("i"), at("a").alias("j"))
              .where("nb = 1 AND na = 1").select("_k", "_g", "i", "j"))
    ranked = sequence_within(sequence_within(unique, ["_k", "_g"], ["i"], "ri"), ["_k", "_g"], ["j"], "rj")
    ranked = materialize(ranked, "anchors")

    def lacks(df: DataFrame, step: int, name: str) -> DataFrame:
        other = ranked.select(F.col("_k").alias("_ok"), F.col("_g").alias("_og"), (F.col("ri") + step).alias("_oi"),
                              (F.col("rj") + step).alias("_oj"), F.lit(False).alias(f"_no_{name}"))
        met = df.join(other, (df["_k"] == other["_ok"]) & (df["_g"] == other["_og"]) & (df["ri"] == other["_oi"])
                      & (df["rj"] == other["_oj"]), "left")
        return met.withColumn(name, F.coalesce(f"_no_{name}", F.lit(True))).drop("_ok", "_og", "_oi", "_oj", f"_no_{name}")

    ends = lacks(lacks(ranked, 1, "first"), -1, "last").where("first OR last").select("_k", "_g", "ri", "rj", "first", "last")
    runs = materialize(chosen_runs(ends), "runs")
    block = lambda c: F.floor(F.col(c) / BLOCK)
    spread = runs.select(F.col("_k").alias("_rk"), F.col("_g").alias("_rg"), "lo", "hi",
                         F.explode(F.sequence(block("lo"), block("hi"))).alias("_b"))
    inside = ((F.col("_k") == F.col("_rk")) & (F.col("_g") == F.col("_rg")) & (block("ri") == F.col("_b"))
              & F.col("ri").between(F.col("lo"), F.col("hi")))
    return ranked.join(spread, inside, "left_semi").select("_k", "_g", "i", "j")


def _matched_before(rows: DataFrame) -> DataFrame:
    """``rows(_k, _g, _side, _pos, _matched)`` with ``_c``, the matched rows before each in its gap and side."""
    keys = ["_k", "_g", "_side"]
    rows = rows.withColumn("_b", F.floor(F.col("_pos") / BLOCK))
    totals = rows.groupBy(*keys, "_b").agg(F.sum("_matched").alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_carry"))
    own = F.sum("_matched").over(Window.partitionBy(*keys, "_b").orderBy("_pos"))
    return (rows.withColumn("_own", own - F.col("_matched")).join(carried, [*keys, "_b"])
            .withColumn("_c", F.col("_own") + F.col("_carry")).drop("_b", "_own", "_carry"))


def _common_ends(rows: DataFrame) -> DataFrame:
    """``_k, _g, nb, na, b0, a0, prefix, suffix`` of every gap."""
    on = lambda side: F.col("_side") == side
    sizes = rows.groupBy("_k", "_g").agg(F.count_if(on("b")).alias("nb"), F.count_if(on("a")).alias("na"),
                                         F.min(F.when(on("b"), F.col("_pos"))).alias("b0"), F.min(F.when(on("a"), F.col("_pos"))).alias("a0"))
    sizes = materialize(sizes, "gaps")
    placed = rows.join(sizes.where("nb > 0 AND na > 0"), ["_k", "_g"])
    start, size = F.when(on("b"), F.col("b0")).otherwise(F.col("a0")), F.when(on("b"), F.col("nb")).otherwise(F.col("na"))
    off = F.col("_pos") - start

    def first_difference(offset: Column, name: str) -> DataFrame:
        hashes = placed.groupBy("_k", "_g", offset.alias("_off")).agg(
            F.max(F.when(on("b"), F.col("_h"))).alias("hb"), F.max(F.when(on("a"), F.col("_h"))).alias("ha"))
        differ = F.when(~F.col("hb").eqNullSafe(F.col("ha")), F.col("_off"))
        return hashes.groupBy("_k", "_g").agg(F.min(differ).alias(name))

    both = first_difference(off, "_p").join(first_difference(size - 1 - off, "_q"), ["_k", "_g"])
    known = sizes.join(both, ["_k", "_g"], "left")
    short = F.least("nb", "na")
    prefix = F.when(short == 0, F.lit(0)).otherwise(F.coalesce("_p", short))
    known = known.withColumn("prefix", prefix.cast("long"))
    return known.withColumn("suffix", F.least(F.coalesce("_q", short), short - F.col("prefix")).cast("long")).drop("_p", "_q")


def line_churn(before: DataFrame, after: DataFrame, key: str = "doc_id", line_col: str = "line") -> DataFrame:
    """``key, matched, deleted, inserted, churn`` per document of the line tables ``before`` and ``after``.

    Both have ``key, line_no, line_col``; ``line_no`` gives the order and may have holes. A document that one table lacks
    counts as empty there; a null line equals null lines only. Rows without a key take no part.
    """
    def side(lines: DataFrame, name: str) -> DataFrame:
        narrow = lines.where(F.col(key).isNotNull()).select(
            F.col(key).alias("_k"), F.col("line_no").alias("_n"), F.coalesce(F.md5(F.col(line_col)), F.lit("")).alias("_h"))
        return sequence_within(narrow, ["_k"], ["_n"], "_pos").select("_k", F.lit("").alias("_g"), F.lit(name).alias("_side"), "_pos", "_h")

    rows = materialize(side(before, "b").unionByName(side(after, "a")), "sides")
    counts = rows.groupBy("_k").agg(F.count_if(F.col("_side") == "b").alias("_nb"), F.count_if(F.col("_side") == "a").alias("_na"))
    counts, settled = materialize(counts, "line_counts"), []
    while not rows.isEmpty():
        gaps = materialize(_common_ends(rows), "common_ends")
        on_b = F.col("_side") == "b"
        off = F.col("_pos") - F.when(on_b, F.col("b0")).otherwise(F.col("a0"))
        size = F.when(on_b, F.col("nb")).otherwise(F.col("na"))
        rest = materialize(rows.join(gaps, ["_k", "_g"]).where((off >= F.col("prefix")) & (off < size - F.col("suffix")))
                           .select("_k", "_g", "_side", "_pos", "_h"), "rest")
        chosen = materialize(_anchors(rest), "matched")
        open_gaps = chosen.select("_k", "_g").distinct()
        left = gaps.withColumn("_d", F.col("nb") - F.col("prefix") - F.col("suffix")).withColumn(
            "_i", F.col("na") - F.col("prefix") - F.col("suffix"))
        settled.append(materialize(left.join(open_gaps, ["_k", "_g"], "left_anti").select("_k", "_d", "_i"), "settled"))
        ends = chosen.select("_k", "_g", F.explode(F.array(
            F.struct(F.lit("b").alias("_side"), F.col("i").alias("_pos")),
            F.struct(F.lit("a").alias("_side"), F.col("j").alias("_pos")))).alias("e")).select(
                "_k", "_g", "e._side", "e._pos", F.lit(1).alias("_matched"))
        marked = rest.join(open_gaps, ["_k", "_g"], "left_semi").join(ends, ["_k", "_g", "_side", "_pos"], "left") \
            .withColumn("_matched", F.coalesce("_matched", F.lit(0)))
        rows = materialize(_matched_before(marked).where("_matched = 0").select(
            "_k", F.concat("_g", F.lit("."), "_c").alias("_g"), "_side", "_pos", "_h"), "open_rows")
    total = None
    for part in settled:
        total = part if total is None else total.unionByName(part)
    zero = counts.select("_k", F.lit(0).cast("long").alias("_d"), F.lit(0).cast("long").alias("_i"))
    sums = (zero if total is None else zero.unionByName(total)).groupBy("_k").agg(
        F.sum("_d").alias("deleted"), F.sum("_i").alias("inserted"), F.sum(F.greatest("_d", "_i")).alias("churn"))
    return counts.join(sums, "_k").select(F.col("_k").alias(key), (F.col("_nb") - F.col("deleted")).alias("matched"),
                                          "deleted", "inserted", "churn")
