"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources in order of code point (null last) weigh 3, 1, 2, 3, 1, 2, ...; they share ``SHARE`` of all sizes by
weight, no source above ``CAP`` times its size, the excess reshared. That is ``min(cap, level * weight)`` for the one
level that spends the budget; the level is found by rounds of one aggregate over the sources.

Selection: a target holds whole epochs of its source first; the fraction that remains is sampled without replacement.
Each document gets the exponential key ``-ln(u) / quality`` (``u`` from a hash of its id), so better documents tend to
come first; documents are taken in key order while their running size stays within the budget. Documents too large
for what then remains are passed over, and further runs go on until no document left fits its source's budget. The running sum is two-level: sums per key range
of a source, then rows only in the range where the budget ends, so a hot source never stands in one task.

Defined cases: a null or empty text has size 0 and is taken 0 words; sources may be null; an empty table gives an
empty result; rows repeating a ``doc_id`` with equal texts share one key, and ``mix`` takes them alike; very long texts
count whole; rows of equal key are taken in the order of their place. ``mix`` returns the columns of its input whatever
their names; ``sample_words`` reads three columns and returns its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NON_SPACE, Scratch, documents, fresh, global_rank, shuffle_partitions

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
PASSES = 4               # runs that the SQL twin spells out; the loop here ends by itself
SEED = "mix-1"
NOISE = "#*$%&|<>!"      # characters that lower the quality weight


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NON_SPACE)).cast("long"), F.lit(0).cast("long"))


def quality(text: Column, size: Column) -> Column:
    """Weight in [0.05, 1]: falls with noise characters per word and for texts of very few words."""
    noise = (F.length(text) - F.length(F.translate(text, NOISE, ""))) / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(0.05), (1 - F.least(F.lit(1.0), noise)) * F.least(F.lit(1.0), (size + 5) / 25.0))


def source_targets(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """``source, source_size, weight, target`` from ``sizes(source, size)``."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    src = scratch.save(global_rank(sums, ["source"], scratch)
                       .select("source", "source_size", pick.alias("weight"),
                               (F.col("source_size") * CAP).alias("cap")), "sources", narrow=True)
    budget = SHARE * (src.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("cap")
        n, spent, open_ = src.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))),
                                  F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not open_:
            break
        level, capped = (budget - (spent or 0.0)) / open_, n
    return src.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def _take(rows: DataFrame, budgets: DataFrame, scratch: Scratch, ranges: int) -> DataFrame:
    """Rows of ``rows(row, source, size, key)`` in key order while the running size is within ``budgets(source, budget)``."""
    placed = rows.withColumn("range", F.least(F.lit(ranges - 1), F.floor((1 - F.exp(-F.col("key"))) * ranges).cast("int")))
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("n"))
    upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("range")))
    b = budgets.withColumnRenamed("source", "s")
    ends = (upto.join(b, F.col("source").eqNullSafe(F.col("s"))).where(F.col("upto") > F.col("budget"))
            .groupBy("source").agg(F.min_by(F.struct("range", (F.col("upto") - F.col("n")).alias("before")), "range").alias("e")))
    ends = scratch.save(budgets.withColumnRenamed("source", "s").join(ends, F.col("s").eqNullSafe(F.col("source")), "left")
                        .select("s", "budget", F.coalesce("e.range", F.lit(ranges)).alias("end"),
                                F.coalesce("e.before", F.lit(0)).alias("before")), "ends", narrow=True)
    at = placed.join(ends, F.col("source").eqNullSafe(F.col("s")))
    inside = at.where(F.col("range") < F.col("end")).select("row", "source", "size")
    w = Window.partitionBy("source").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (at.where(F.col("range") == F.col("end")).withColumn("upto", F.sum("size").over(w) + F.col("before"))
            .where(F.col("upto") <= F.col("budget")).select("row", "source", "size"))
    return inside.unionByName(last)


def _keyed(docs: DataFrame, size: str, key: str) -> DataFrame:
    """``docs`` with the size and the exponential key of each row's text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return docs.withColumn(size, word_count(text)).withColumn(key, -F.log(u) / quality(text, F.col(size)))


def _plan(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``rows(doc_id, source, size, key, row)``, ``targets(source, source_size, target, epochs)``, the ``row`` numbers that
    the first run takes, and those that later runs take."""
    ranges = max(64, shuffle_partitions(docs.sparkSession))
    rows = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"),
                  "size", "key").drop("text")
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    targets = scratch.save(source_targets(rows, scratch), "targets", narrow=True)
    share = F.col("target") / F.col("source_size")
    epochs = F.when(F.col("source_size") > 0, F.floor(share + 1e-12)).otherwise(0)
    targets = targets.withColumn("epochs", epochs)
    budgets = targets.select("source", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"))
    left = rows.where("size > 0").select("row", "source", "size", "key")
    first = chosen = scratch.save(_take(left, budgets, scratch, ranges), "chosen", narrow=True)
    while True:
        used = chosen.groupBy("source").agg(F.sum("size").alias("used")).withColumnRenamed("source", "s")
        all_ = targets.select("source", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("all"))
        budgets = scratch.save(all_.join(used, F.col("source").eqNullSafe(F.col("s")), "left")
                               .select("source", (F.col("all") - F.coalesce("used", F.lit(0))).alias("budget")), "budgets", narrow=True)
        rest = rows.where("size > 0").join(chosen.select("row"), "row", "left_anti")
        fits = budgets.withColumnRenamed("source", "s")
        left = scratch.save(rest.join(fits, F.col("source").eqNullSafe(F.col("s"))).where("size <= budget")
                            .select("row", "source", "size", "key"), "left", narrow=True)
        if left.isEmpty():
            break
        chosen = scratch.save(chosen.unionByName(_take(left, budgets, scratch, ranges)), "chosen", narrow=True)
    return rows, targets, first.select("row"), chosen.join(first, "row", "left_anti").select("row")


def sample_words(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` per row of ``docs(doc_id, text, source)``."""
    rows, targets, first, later = _plan(docs, scratch)
    t = targets.withColumnRenamed("source", "s")
    out = (rows.join(first.unionByName(later).withColumn("more", F.lit(1)), "row", "left")
           .join(t, F.col("source").eqNullSafe(F.col("s"))))
    copies = (F.col("epochs") + F.coalesce("more", F.lit(0))).cast("long")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"),
                      (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (rows of size 0 go).

    The first run takes a source's documents up to one key, so a row's copies follow from its own key and its source's
    cut; only what later runs fill in (less than one large document per source) is a table of ids. Both are small and
    meet the texts by Spark's size rules, as a rule without moving them.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows, targets, first, later = _plan(docs, scratch)
    size, key, s, epochs, cut, of, of_key, copy = fresh(docs, "_size", "_key", "_s", "_epochs", "_cut", "_of", "_of_key", "_copy")
    cuts = rows.join(first, "row", "left_semi").groupBy(F.col("source").alias("_cs")).agg(F.max("key").alias("_cut"))
    of_source = scratch.save(targets.join(cuts, F.col("source").eqNullSafe(F.col("_cs")), "left").select(
        F.col("source").alias(s), F.col("epochs").cast("long").alias(epochs), F.coalesce("_cut", F.lit(-1.0)).alias(cut)),
        "cuts", narrow=True)
    filled = scratch.save(rows.join(later, "row", "left_semi").select(F.col("doc_id").alias(of), F.col("key").alias(of_key)).distinct(),
                          "filled", narrow=True)
    at = _keyed(docs, size, key).where(F.col(size) > 0).join(of_source, F.col("source").cast("string").eqNullSafe(F.col(s)))
    at = at.join(filled, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(key) == F.col(of_key)), "left")
    copies = F.col(epochs) + F.when((F.col(key) <= F.col(cut)) | F.col(of_key).isNotNull(), 1).otherwise(0)
    return (at.withColumn(copy, copies).where(F.col(copy) > 0)
            .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy)))).select(*[at[c] for c in docs.columns]))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return sample_words(documents(spark, sf_dir), Scratch(spark, "mixing")).drop("copies")
