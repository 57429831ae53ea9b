"""Code context around findings: innermost enclosing span (J5), +-5-line window (J6/X5/X6), per-line frame.

Lines are a table ``(doc_id, line_no, line)`` (``explode_lines``), so no operator ever copies a whole document
into each finding row, and every shuffle is keyed by ``(doc_id, line_no)`` or ``(doc_id, block)`` -- a huge
document is spread over many tasks instead of landing on one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_lines_keepends, split_newlines, window_bounds
from ..sources.store import materialize
from .intervals import innermost_span

WINDOW = 5            # fixed value: lines of context on each side (reference default)
FRAME_BLOCK = 1024    # lines per block for the per-line frame


def explode_lines(docs: DataFrame, text_col: str = "text", key: str = "doc_id", keepends: bool = True) -> DataFrame:
    """X4 as a table: ``(key, line_no, line)``, 1-based. ``keepends`` = Python ``splitlines(keepends=True)``;
    otherwise a plain ``split('\\n')`` (terminators dropped, trailing empty element kept)."""
    arr = split_lines_keepends(F.col(text_col)) if keepends else split_newlines(F.col(text_col))
    return docs.select(key, F.posexplode(arr).alias("_p", "line")) \
        .select(key, (F.col("_p") + 1).alias("line_no"), "line")


def document_line_counts(docs: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_lines)`` from the document rows themselves: a narrow pass, no exploded line."""
    return docs.select(key, F.size(split_lines_keepends(F.coalesce(F.col(text_col), F.lit("")))).alias("n_lines"))


def line_counts(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    return lines.groupBy(key).agg(F.max("line_no").alias("n_lines"))


def extract_ranges(ranges: DataFrame, lines: DataFrame, key: str = "doc_id", start_col: str = "start_line",
                   end_col: str = "end_line", out_col: str = "code", sep: str = "") -> DataFrame:
    """X6 over a line table: text of lines ``[start, end]`` per range (``''`` when the range is empty).

    Many findings share one context (every finding inside a function), so each *distinct* ``(doc, start, end)``
    is expanded to its line numbers, met with the line table on ``(key, line_no)`` and assembled once; the text then
    joins back to the ranges (one output row per input row).
    """
    # Ranges are read twice below (lookup side, join-back): store them once so their upstream is computed once.
    ranges = materialize(ranges, "ranges")
    spans = ranges.select(F.col(key).alias("_dk"), F.col(start_col).alias("_s"), F.col(end_col).alias("_e")).distinct()
    want = spans.filter(F.col("_s") <= F.col("_e")).select(
        "_dk", "_s", "_e", F.explode(F.sequence(F.col("_s"), F.col("_e"))).alias("_ln"))
    # Stored, so that Spark knows the size of the wanted lines in bytes: small ones are broadcast to the scan of the
    # line table, large ones meet it in a sort-merge join.
    want = materialize(want, "wanted_lines")
    got = want.join(lines.select(F.col(key).alias("_dk"), F.col("line_no").alias("_ln"), F.col("line").alias("_t")),
                    ["_dk", "_ln"], "inner")
    texts = got.groupBy("_dk", "_s", "_e").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ln", "_t"))), lambda x: x["_t"]), sep)
        .alias("_text"))
    cond = ((F.col(key) == F.col("_dk")) & (F.col(start_col) == F.col("_s")) & (F.col(end_col) == F.col("_e")))
    out = ranges.join(texts, cond, "left")
    return out.withColumn(out_col, F.coalesce(F.col("_text"), F.lit(""))).drop("_dk", "_s", "_e", "_text")


def line_window_context(findings: DataFrame, lines: DataFrame, finding_keys: Sequence[str], key: str = "doc_id",
                        line_col: str = "line_no", window: int = WINDOW, counts: DataFrame | None = None) -> DataFrame:
    """J6 + X5 + X6: the +-``window`` slice around each finding's line.

    ``start_line = max(0, l-1-window) + 1``, ``end_line = min(n, l+window)``; text = lines joined as stored
    (keepends lines -> exact source text). ``l > n + window`` gives ``start_line > end_line`` and ``''``.
    ``counts`` (``document_line_counts``) saves a pass over the line table.
    """
    n = line_counts(lines, key) if counts is None else counts
    f = findings.join(n, key, "left").withColumn("n_lines", F.coalesce(F.col("n_lines"), F.lit(0)))
    s, e = window_bounds(F.col(line_col), F.col("n_lines"), window)
    f = f.withColumn("start_line", s).withColumn("end_line", e).drop("n_lines")
    return extract_ranges(f, lines, key)


def function_or_window_context(findings: DataFrame, spans: DataFrame, lines: DataFrame, finding_keys: Sequence[str],
                               key: str = "doc_id", line_col: str = "line_no", window: int = WINDOW,
                               counts: DataFrame | None = None) -> DataFrame:
    """The reference's ``get_function_context``: innermost function span if any, else the +-window slice.

    Output adds ``context_type`` (``function``/``window``), ``start_line``, ``end_line``, ``code``.
    """
    inner = innermost_span(findings, spans, key, line_col)
    n = line_counts(lines, key) if counts is None else counts
    f = inner.join(n, key, "left").withColumn("n_lines", F.coalesce(F.col("n_lines"), F.lit(0)))
    ws, we = window_bounds(F.col(line_col), F.col("n_lines"), window)
    has = F.col("span_start").isNotNull()
    f = (f.withColumn("context_type", F.when(has, F.lit("function")).otherwise(F.lit("window")))
         .withColumn("start_line", F.when(has, F.col("span_start")).otherwise(ws))
         .withColumn("end_line", F.when(has, F.col("span_end")).otherwise(we))
         .drop("n_lines", "span_start", "span_end"))
    return extract_ranges(f, lines, key)


def line_window_frame(lines: DataFrame, key: str = "doc_id", window: int = WINDOW, block: int = FRAME_BLOCK,
                      sep: str = "", out_col: str = "context") -> DataFrame:
    """For every line, the text of the lines within +-``window`` rows.

    ``collect_list OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN w PRECEDING AND w FOLLOWING)`` would put a
    whole document in one task. Instead lines are cut into ``block``-line blocks; the ``window`` lines at each
    block edge are copied into the neighbouring block as halo rows, the frame runs per ``(doc, block)``, and
    only home rows are kept. Extra shuffle volume is ``2*window/block`` of the lines.
    """
    if block <= 2 * window:
        raise ValueError("block must exceed twice the window")
    ln = F.col("line_no")
    blk = F.floor((ln - 1) / block)
    off = F.pmod(ln - 1, F.lit(block))
    targets = F.array(F.struct(blk.alias("b"), F.lit(True).alias("home")),
                      F.when(off < window, F.struct((blk - 1).alias("b"), F.lit(False).alias("home"))),
                      F.when(off >= block - window, F.struct((blk + 1).alias("b"), F.lit(False).alias("home"))))
    rows = lines.select(key, "line_no", "line", F.explode(F.filter(targets, lambda t: t.isNotNull())).alias("_t"))
    w = Window.partitionBy(key, "_t.b").orderBy("line_no").rowsBetween(-window, window)
    framed = rows.withColumn(out_col, F.array_join(F.collect_list("line").over(w), sep))
    return framed.filter(F.col("_t.home")).select(key, "line_no", "line", out_col)
