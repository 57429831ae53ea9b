"""Code statistics and churn over tables of lines and blocks.

Parsers stay with the caller: a block table ``(key, name, complexity)`` and line tables come in as DataFrames (for
instance from a caller's ``mapInPandas`` job), and everything here is relational.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import half_even_ratio


COMMENT = "#"


def code_stats(blocks: DataFrame, lines: DataFrame, key: str = "doc_id", line_col: str = "line",
               comment: str = COMMENT) -> DataFrame:
    """``(key, avg_cyclomatic_complexity, n_blocks, sloc)`` per document.

    Mean block complexity, half-even to two places, 0 without blocks; ``sloc`` = lines that hold more than white
    space and whose first other character does not start a comment (``comment``). Both sides are pre-aggregated to one row per document before they meet.
    """
    b = blocks.groupBy(key).agg(F.sum("complexity").alias("_sum"), F.count(F.lit(1)).alias("n_blocks"))
    code = F.col(line_col).rlike(r"\S") & ~F.regexp_replace(line_col, r"^\s+", "").startswith(comment)
    n = lines.groupBy(key).agg(F.count_if(code).alias("sloc"))
    mean = half_even_ratio(F.col("_sum"), F.col("n_blocks"), 2, percent=False)
    return n.join(b, key, "left").select(
        key, F.coalesce(mean, F.lit(0).cast("decimal(18,2)")).alias("avg_cyclomatic_complexity"),
        F.coalesce("n_blocks", F.lit(0)).cast("bigint").alias("n_blocks"), F.col("sloc").cast("bigint").alias("sloc"))


def multiset_line_churn(before_lines: DataFrame, after_lines: DataFrame, key: str = "doc_id",
                        line_col: str = "line") -> DataFrame:
    """Order-free churn bound per document: ``max(added, removed)`` over line multisets.

    The two sides are one stream of +1 and -1 rows, summed per ``(doc, line)`` (map-side combined, so a line repeated
    a million times is one row per task) and then per document. Any edit script needs at least this many edits.
    """
    both = before_lines.select(key, line_col, F.lit(-1).alias("_d")).unionByName(
        after_lines.select(key, line_col, F.lit(1).alias("_d")))
    net = both.groupBy(key, line_col).agg(F.sum("_d").alias("_d"))
    out = net.groupBy(key).agg(F.sum(F.greatest("_d", F.lit(0))).alias("added"),
                               F.sum(F.greatest(-F.col("_d"), F.lit(0))).alias("removed"))
    return out.select(key, F.col("added").cast("bigint").alias("added"), F.col("removed").cast("bigint").alias("removed"),
                      F.greatest("added", "removed").cast("bigint").alias("churn"))
