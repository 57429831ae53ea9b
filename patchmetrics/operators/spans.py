"""the function spans of source documents, from the table of their lines.

The rule reads indentation, not a syntax tree, so it needs no document in one place. A *code line* is one that holds more
than white space and is no comment alone. A function starts at a code line ``def name(`` or ``async def name(``, or at the
first of the decorator lines (``@``) directly above it (blank and comment lines do not count). It ends at the last code
line before the next code line that is indented no deeper than its ``def`` and does not begin with a closing bracket (the
end of a signature over several lines), or at the last code line of the document. Tabs reach to the next multiple of
eight columns. Out of rule: strings and continuation lines that run on at a smaller indent, and decorators over several
lines, of which the lines behind the first count as code.

"The next line indented no deeper" is found in two levels: within a block of lines, and for a function that leaves its
block by the first such line of every later block, one row per block and per indent at which functions of the document
start. The other neighbours (previous code line, start of a run of decorators) are running maxima in the same two levels.
No array holds more than one block, and a document of any length is spread over many tasks. Both sides of every join grow
with the documents, though their files may look small enough to broadcast: the joins ask for a merge, so that no table
goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialize

BLOCK = 256
_DEF = r"^[ \t]*(async[ \t]+)?def[ \t]+([^\W\d]\w*)[ \t]*[\(\[]"


def indent_of(line: Column) -> Column:
    """Columns of white space before the first other character; a tab reaches to the next multiple of eight."""
    lead = F.regexp_extract(line, r"^([ \t]*)", 1)
    walked = F.aggregate(F.split(lead, ""), F.lit(0), lambda at, c: F.when(c == "\t", (F.floor(at / 8) * 8 + 8).cast("int"))
                         .when(c == " ", at + 1).otherwise(at))
    return F.when(lead.contains("\t"), walked).otherwise(F.length(lead))


def _last_before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows(_k, _n, _b)`` with the largest ``value`` of the rows of the document before each (null if there is none)."""
    rows = rows.withColumn("_v", value)
    totals = rows.groupBy("_k", "_b").agg(F.max("_v").alias("_t"))
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("_k").alias("_ck"), F.col("_b").alias("_cb"), F.max("_t").over(earlier).alias("_carry"))
    own = F.max("_v").over(Window.partitionBy("_k", "_b").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1))
    both = rows.withColumn("_own", own).join(carried.hint("merge"), (F.col("_k") == F.col("_ck")) & (F.col("_b") == F.col("_cb")))
    return both.withColumn(name, F.greatest("_own", "_carry")).drop("_v", "_own", "_carry", "_ck", "_cb")


def function_spans(lines: DataFrame, key: str = "doc_id", line_col: str = "line") -> DataFrame:
    """``key, kind, name, start_line, end_line, def_line`` of every function of ``lines(key, line_no, line_col)``.

    ``kind`` is ``function`` or ``async function``. Lines may carry their terminators; null lines count as blank.
    """
    text = F.regexp_replace(F.coalesce(F.col(line_col), F.lit("")), r"[\r\n]+$", "")
    code = lines.select(F.col(key).alias("_k"), F.col("line_no").cast("long").alias("_n"), text.alias("_line")).where(
        F.col("_line").rlike(r"^\s*[^\s#]"))
    code = code.select(
        "_k", "_n", F.floor((F.col("_n") - 1) / BLOCK).alias("_b"), indent_of(F.col("_line")).alias("_i"),
        F.col("_line").rlike(r"^\s*@").alias("_deco"), F.col("_line").rlike(r"^\s*[\)\]\}]").alias("_closing"),
        F.regexp_extract("_line", _DEF, 2).alias("_name"), F.col("_line").rlike(r"^\s*async\b").alias("_async"))
    code = materialize(code, "code_lines")            # narrow: no text from here on
    defs = code.where("_name <> ''")
    before = materialize(_last_before(_last_before(code, F.when(~F.col("_deco"), F.col("_n")), "_plain"), F.col("_n"), "_prev"), "line_neighbours")

    # The first line indented no deeper: in the function's own block, else in the blocks behind it.
    ends = F.when(~F.col("_closing"), F.struct(F.col("_n").alias("n"), F.col("_i").alias("i")))
    blocks = code.groupBy("_k", "_b").agg(F.array_sort(F.collect_list(ends)).alias("_ends"))      # at most BLOCK entries
    first = lambda after, indent: F.array_min(F.transform(
        F.filter("_ends", lambda x: (x["n"] > after) & (x["i"] <= indent)), lambda x: x["n"]))
    indents = defs.select(F.col("_k").alias("_ik"), F.col("_i").alias("_level")).distinct()
    firsts = blocks.join(indents.hint("merge"), F.col("_k") == F.col("_ik")).select("_k", "_b", "_level", first(F.lit(0), F.col("_level")).alias("_first"))
    later = Window.partitionBy("_k", "_level").orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    carry = firsts.select(F.col("_k").alias("_ck"), F.col("_b").alias("_cb"), "_level", F.min("_first").over(later).alias("_carry"))
    own = defs.join(blocks.hint("merge"), ["_k", "_b"]).withColumn("_own", first(F.col("_n"), F.col("_i"))).drop("_ends")
    open_ = own.join(carry.hint("merge"), (F.col("_k") == F.col("_ck")) & (F.col("_b") == F.col("_cb")) & (F.col("_i") == F.col("_level")), "left")
    found = open_.select("_k", "_n", "_name", "_async", F.coalesce("_own", "_carry").alias("_next"))

    at_next = before.select(F.col("_k").alias("_nk"), F.col("_n").alias("_nn"), F.col("_prev").alias("_end"))
    final = code.groupBy("_k").agg(F.max("_n").alias("_last"))
    runs = before.where("_deco").groupBy(F.col("_k").alias("_rk"), F.coalesce("_plain", F.lit(0)).alias("_rp")).agg(F.min("_n").alias("_top"))
    above = before.where("_name <> ''").select(F.col("_k").alias("_ak"), F.col("_n").alias("_an"), F.coalesce("_plain", F.lit(0)).alias("_ap"))
    out = (found.join(at_next.hint("merge"), (F.col("_k") == F.col("_nk")) & (F.col("_next") == F.col("_nn")), "left")
           .join(final.hint("merge"), "_k").join(above.hint("merge"), (F.col("_k") == F.col("_ak")) & (F.col("_n") == F.col("_an")))
           .join(runs.hint("merge"), (F.col("_k") == F.col("_rk")) & (F.col("_ap") == F.col("_rp")) & (F.col("_top") < F.col("_n")), "left"))
    return out.select(F.col("_k").alias(key), F.when(F.col("_async"), "async function").otherwise("function").alias("kind"),
                      F.col("_name").alias("name"), F.coalesce("_top", "_n").cast("int").alias("start_line"),
                      F.coalesce("_end", "_last").cast("int").alias("end_line"), F.col("_n").cast("int").alias("def_line"))
