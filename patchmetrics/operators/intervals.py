"""J5 as an equi-join: spans in a dyadic interval tree kept as a table.

Level ``l`` of the tree cuts the lines ``0, 1, 2, ...`` into nodes of ``2^l`` lines. A span is the disjoint union of at
most two nodes per level, so of any length it is a few dozen rows (under 50 for ten million lines). A line lies in one
node per level and probes those levels that hold spans at all. Spans that cover one node cover every line of it, so only
the innermost of them matters there: the table has one row per node, and a line meets at most one row per level however
many spans are nested around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialize

LEVELS = 40     # lines are numbered below 2^40

# Nodes of the 0-based half-open range [a, b): at each level the first node if it is a right child, and the last one if
# it is a left child; what lies between is covered by the levels above.
_NODES = """filter(flatten(transform(sequence(0, {levels}), l -> array(
  if(shiftright(a + shiftleft(1L, l) - 1, l) < shiftright(b, l) AND shiftright(a + shiftleft(1L, l) - 1, l) % 2 = 1,
     struct(l AS level, shiftright(a + shiftleft(1L, l) - 1, l) AS node), null),
  if(shiftright(a + shiftleft(1L, l) - 1, l) < shiftright(b, l) AND shiftright(b, l) % 2 = 1,
     struct(l AS level, shiftright(b, l) - 1 AS node), null)))), x -> x IS NOT NULL)"""


def dyadic_nodes(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start_line, end_line, level, node``: the tree nodes whose union each span is (none for an empty span)."""
    known = spans.select(key, "start_line", "end_line").where("start_line <= end_line AND end_line >= 1")
    ranged = known.withColumn("a", F.greatest(F.col("start_line").cast("long") - 1, F.lit(0))) \
        .withColumn("b", F.col("end_line").cast("long"))
    return ranged.select(key, "start_line", "end_line", F.explode(F.expr(_NODES.format(levels=LEVELS))).alias("n")) \
        .select(key, "start_line", "end_line", F.col("n.level").alias("level"), F.col("n.node").alias("node"))


def innermost_of_nodes(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, level, node, best (struct s, minus_e)``: of the spans of a node the one of largest start, then smallest end."""
    best = F.max(F.struct(F.col("start_line").alias("s"), (-F.col("end_line")).alias("minus_e")))
    return dyadic_nodes(spans, key).groupBy(key, "level", "node").agg(best.alias("best"))


def innermost_span(findings: DataFrame, spans: DataFrame, key: str = "doc_id", line_col: str = "line_no") -> DataFrame:
    """``findings`` with ``span_start, span_end`` of the tightest span around the line (null if there is none).

    Tightest = largest start, then smallest end. Findings of one line of one document ask once. The tree is a written
    table; lines and nodes meet on ``(key, level, node)``, which no document, however hot, puts into one task.
    """
    tree = materialize(innermost_of_nodes(spans, key).withColumnRenamed(key, "_key"), "span_tree")
    levels = sorted(r["level"] for r in tree.select("level").distinct().collect())     # at most LEVELS + 1
    points = findings.select(F.col(key).alias("_k"), F.col(line_col).alias("_line")).where("_line >= 1").distinct()
    probes = F.array(*[F.struct(F.lit(n).alias("level"), F.expr(f"shiftright(CAST(_line AS BIGINT) - 1, {n})").alias("node"))
                       for n in levels]) if levels else F.array().cast("array<struct<level:int,node:bigint>>")
    asked = points.select("_k", "_line", F.explode(probes).alias("_p"))
    met = asked.join(tree, (F.col("_k") == F.col("_key")) & (F.col("_p.level") == F.col("level"))
                     & (F.col("_p.node") == F.col("node")))
    best = met.groupBy("_k", "_line").agg(F.max("best").alias("_best"))
    out = findings.join(best, (findings[key] == best["_k"]) & (findings[line_col] == best["_line"]), "left")
    return out.select(*[findings[c] for c in findings.columns], F.col("_best.s").alias("span_start"),
                      (-F.col("_best.minus_e")).alias("span_end"))
