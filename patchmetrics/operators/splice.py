"""X7 for documents of any size: edits and lines stay tables, no document is ever one row or one array.

Edits become *pieces*: ranges of original lines that stay, each with the place of its first line in the new document.
Lines meet their pieces on ``(key, block of lines)`` and move by a constant; the edits' own text is split and placed
beside them. What an edit needs to know of the edits before it (the furthest end, the sum of length changes) is a
running value in two levels: within its block of lines, and over the blocks of its document, so a document with any
number of edits is spread over many tasks.

Both modes of the splice (D6):

* ``original``: line numbers are those of the input. Of several edits of one range the last in order wins; in the order
  of (start, end) an edit is applied if it starts behind the end of the last applied one. Edits that overlap no edit
  before them are settled at once by the running end; only chains of overlapping edits are folded, one array a chain.
* ``sequential``: edits apply in order to the element list as it then is, and each block of new text stays one element,
  whatever its lines. This order is a fold by nature: the edits of one document (three numbers each) are folded over its
  list of pieces; lines never enter the fold.

An edit whose end lies before its start inserts before its start (``original``); starts below 1 count as 1; an edit
behind the last line appends. New text gets a trailing newline if it lacks one; null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ensure_trailing_newline, split_lines_keepends
from ..sources.store import materialize

BLOCK = 256     # lines of a block


def _block(line: Column) -> Column:
    return F.floor((line - 1) / BLOCK).cast("long")


def _before(edits: DataFrame, value: Column, how, name: str, least: bool) -> DataFrame:
    """``edits(_k, _s, _e)`` with ``how`` (sum or max) of ``value`` over the document's earlier edits by (start, end).

    Two levels: rows of the same block, and totals of the blocks before it.
    """
    rows = edits.withColumn("_b", _block(F.col("_s"))).withColumn("_v", value)
    totals = rows.groupBy("_k", "_b").agg(how("_v").alias("_t"))
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("_k").alias("_ck"), F.col("_b").alias("_cb"), how("_t").over(earlier).alias("_carry"))
    own = how("_v").over(Window.partitionBy("_k", "_b").orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1))
    both = rows.withColumn("_own", own).join(carried, (F.col("_k") == F.col("_ck")) & (F.col("_b") == F.col("_cb")))
    known = (F.greatest("_own", "_carry") if least else F.coalesce("_own", F.lit(0)) + F.coalesce("_carry", F.lit(0)))
    return both.withColumn(name, known).drop("_b", "_v", "_own", "_ck", "_cb", "_carry")


def choose_edits(edits: DataFrame) -> DataFrame:
    """``_k, _s, _e, _o, outcome`` of ``edits(_k, _s, _e, _o)``: ``applied``, ``overlapping`` or ``superseded``.

    Of the edits that start at one line only an insertion and the shortest replacement can be applied, so at most two
    edits a line go on.
    """
    last = edits.groupBy("_k", "_s", "_e").agg(F.max("_o").alias("_last"))
    inserts = F.col("_e") < F.col("_s")
    shortest = last.groupBy("_k", "_s").agg(F.min(F.when(~inserts, F.col("_e"))).alias("_least"))
    open_ = materialize(last.join(shortest, ["_k", "_s"]).where(inserts | (F.col("_e") == F.col("_least"))).drop("_least"), "open_edits")
    ended = _before(open_, F.col("_e"), F.max, "_end", True)
    free = F.col("_end").isNull() | (F.col("_s") > F.col("_end"))
    flagged = materialize(ended.withColumn("_first", F.when(free, F.col("_s"))), "free_edits")
    chains = _before(flagged.drop("_end"), F.col("_first"), F.max, "_chain", True).withColumn(
        "_chain", F.greatest("_first", "_chain"))
    kind = "array<struct<s:bigint,e:bigint>>"
    grouped = chains.groupBy("_k", "_chain").agg(F.array_sort(F.collect_list(
        F.struct(F.col("_s").alias("s"), F.col("_e").alias("e")))).alias("_c"))

    def take(used: Column, x: Column) -> Column:
        fits = (F.size(used) == 0) | (F.try_element_at(used, F.lit(-1))["e"] < x["s"])
        return F.when(fits, F.concat(used, F.array(x))).otherwise(used)

    chosen = grouped.select("_k", F.explode(F.aggregate("_c", F.array().cast(kind), take)).alias("_x")).select(
        "_k", F.col("_x.s").alias("_s"), F.col("_x.e").alias("_e"), F.lit(True).alias("_used"))
    marked = edits.join(last, ["_k", "_s", "_e"]).join(chosen, ["_k", "_s", "_e"], "left")
    outcome = (F.when(F.col("_o") != F.col("_last"), "superseded").when(F.col("_used"), "applied").otherwise("overlapping"))
    return marked.select("_k", "_s", "_e", "_o", outcome.alias("outcome"))


def _original_pieces(edits: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pieces ``_k, a, len, p``, places ``_k, _o, p`` of the applied edits, and the outcomes."""
    outcomes = materialize(choose_edits(edits.select("_k", "_s", "_e", "_o")), "edit_outcomes")
    used = outcomes.where("outcome = 'applied'").drop("outcome").join(edits.select("_k", "_o", "_n_new"), ["_k", "_o"]).join(sizes, "_k")
    gone = F.greatest(F.lit(0), F.least("_e", "_n") - F.col("_s") + 1)
    used = materialize(used.withColumn("_change", F.col("_n_new") - gone), "applied_edits")
    at = materialize(_before(_before(used, F.col("_e"), F.max, "_end", True), F.col("_change"), F.sum, "_moved", False), "placed_edits")
    a = F.coalesce("_end", F.lit(0)) + 1
    kept = at.select("_k", a.alias("a"), (F.least(F.col("_s") - 1, "_n") - a + 1).alias("len"), (a + F.col("_moved")).alias("p"))
    tail = used.groupBy("_k").agg(F.max("_e").alias("_end"), F.sum("_change").alias("_moved"), F.max("_n").alias("_n")).select(
        "_k", (F.col("_end") + 1).alias("a"), (F.col("_n") - F.col("_end")).alias("len"), (F.col("_end") + 1 + F.col("_moved")).alias("p"))
    places = at.select("_k", "_o", (F.least("_s", F.col("_n") + 1) + F.col("_moved")).alias("p"))
    return kept.unionByName(tail).where("len > 0"), places, outcomes


# One edit over the list of pieces (p: place, len: elements, a: first original line, 0 for new text; o: its edit).
_SEQUENTIAL = """aggregate(_edits, filter(array(named_struct('p', 1L, 'len', _n, 'a', 1L, 'o', CAST(NULL AS {order}))), x -> x.len > 0),
  (pieces, d) -> flatten(transform(array(named_struct('s', greatest(d.s, 1L), 'e', greatest(d.e, 0L),
      'at', least(greatest(d.s, 1L), coalesce(try_element_at(pieces, -1).p + try_element_at(pieces, -1).len, 1L)))), y -> concat(
    transform(filter(pieces, x -> x.p < y.s), x -> named_struct('p', x.p, 'len', least(x.len, y.s - x.p), 'a', x.a, 'o', x.o)),
    array(named_struct('p', y.at, 'len', 1L, 'a', 0L, 'o', d.o)),
    transform(filter(pieces, x -> x.p + x.len - 1 > y.e), x -> named_struct(
      'p', y.at + 1 + greatest(x.p, y.e + 1) - (y.e + 1), 'len', x.p + x.len - greatest(x.p, y.e + 1),
      'a', x.a + greatest(x.p, y.e + 1) - x.p, 'o', x.o))))))"""


def _sequential_pieces(edits: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    order = edits.schema["_o"].dataType.simpleString()
    e = F.struct(F.col("_o").alias("o"), F.col("_s").alias("s"), F.col("_e").alias("e"))
    listed = edits.groupBy("_k").agg(F.array_sort(F.collect_list(e)).alias("_edits")).join(sizes, "_k")
    pieces = materialize(listed.select("_k", F.explode(F.expr(_SEQUENTIAL.format(order=order))).alias("x")).select("_k", "x.*"), "pieces")
    kept = pieces.where("a > 0").select("_k", "a", "len", "p")
    return kept, pieces.where("a = 0").select("_k", "o", "p").withColumnRenamed("o", "_o"), \
        edits.select("_k", "_s", "_e", "_o", F.lit("applied").alias("outcome"))


def splice_lines(lines: DataFrame, edits: DataFrame, key: str = "doc_id", order_col: str = "patch_seq",
                 mode: str = "original") -> tuple[DataFrame, DataFrame]:
    """``(new_lines, outcomes)`` of ``edits(key, order_col, start_line, end_line, block)`` on ``lines(key, line_no, line)``.

    Lines carry their terminators (``explode_lines``); ``order_col`` is unique within a document. ``new_lines``: ``key,
    line_no, line``, numbered from 1; in ``sequential`` mode ``line_no`` counts elements, an edit's text being one.
    ``outcomes``: ``key, order_col, outcome``. Documents without an edit pass through unread by any join but one on
    their key; edits of documents without lines build the document.
    """
    if mode not in ("original", "sequential"):
        raise ValueError("mode must be 'original' or 'sequential'")
    text = ensure_trailing_newline(F.coalesce(F.col("block"), F.lit("")))
    start, end = F.col("start_line").cast("long"), F.col("end_line").cast("long")
    if mode == "original":
        start = F.greatest(start, F.lit(1))
        end = F.greatest(end, start - 1)
    n_new = F.size(split_lines_keepends(text)) if mode == "original" else F.lit(1)
    wanted = materialize(edits.select(F.col(key).alias("_k"), F.col(order_col).alias("_o"), start.alias("_s"), end.alias("_e"),
                                      n_new.cast("long").alias("_n_new"), text.alias("_text")), "edits")
    touched = materialize(wanted.select("_k").distinct(), "edited_keys")
    line = lines.select(F.col(key).alias("_lk"), F.col("line_no").cast("long").alias("_ln"), F.col("line").alias("_line"))
    own = line.join(touched, F.col("_lk") == F.col("_k"), "left_semi")
    counted = own.groupBy("_lk").agg(F.max("_ln").alias("_n"))
    sizes = materialize(touched.join(counted, F.col("_k") == F.col("_lk"), "left").select(
        "_k", F.coalesce("_n", F.lit(0)).alias("_n")), "edited_sizes")
    narrow = wanted.drop("_text")
    kept, places, outcomes = (_original_pieces if mode == "original" else _sequential_pieces)(narrow, sizes)

    by_block = kept.withColumn("_b", F.explode(F.sequence(_block(F.col("a")), _block(F.col("a") + F.col("len") - 1))))
    by_block = materialize(by_block, "pieces_by_block")
    inside = (F.col("_lk") == F.col("_k")) & (_block(F.col("_ln")) == F.col("_b")) \
        & (F.col("a") <= F.col("_ln")) & (F.col("_ln") < F.col("a") + F.col("len"))
    moved = own.join(by_block, inside).select("_lk", (F.col("p") + F.col("_ln") - F.col("a")).alias("_ln"), "_line")
    placed = places.join(wanted.select("_k", "_o", "_text"), ["_k", "_o"])
    if mode == "original":
        fresh = placed.select("_k", "p", F.posexplode(split_lines_keepends(F.col("_text"))).alias("_i", "_line")).select(
            F.col("_k").alias("_lk"), (F.col("p") + F.col("_i")).alias("_ln"), "_line")
    else:
        fresh = placed.select(F.col("_k").alias("_lk"), F.col("p").alias("_ln"), F.col("_text").alias("_line"))
    same = line.join(touched, F.col("_lk") == F.col("_k"), "left_anti")
    new = same.unionByName(moved).unionByName(fresh)
    return (new.select(F.col("_lk").alias(key), F.col("_ln").alias("line_no"), F.col("_line").alias("line")),
            outcomes.select(F.col("_k").alias(key), F.col("_o").alias(order_col), "outcome"))
