"""J11 for large rule catalogues: rules found by the literals that they require, tails tested once for all rules of one form.

``findings.scan_lines`` tests every rule on every line, which suits a handful of rules. Here the cost of a line does not
follow the number of rules:

1. A rule whose matches must all hold a literal of ``Q`` characters or more (``findings.required_literal``) is an *entry*
   of the index, under that literal. ``literals.Literals`` finds the entries that each line holds, for a batch of lines
   at once (an Arrow function; the lines stay where they are).
2. A rule that is such a literal followed by a *tail* (``word[a-z]* [a-z]+``) matches a line where its literal ends at a
   place at which the tail matches. These places are the same for all rules with this tail: for each of the tails that
   ``RULES_PER_TAIL`` rules or more share (the ``MOST_TAILS`` commonest), one regular expression marks them in the line.
   Such rules, and those that are a literal only, need no test of their own.
3. All other rules with a literal are tested by their pattern on the lines that hold the literal. So are rules with a
   tail on lines that cannot be marked: those that hold the mark, or are longer than ``MARKED`` characters.
4. Rules without such a literal stay in the projection, one regular expression each.

The lines are read once, whatever the number of rules. The index is a written table, so Spark knows its size: a small one
is broadcast, a large one meets the found entries in a shuffle join, where a hot entry is split by AQE. ``PIECE`` bytes are
looked up at once, so beside the line itself and its marks no array grows with the line.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialize
from .findings import literal_and_tail, required_literal
from .literals import MARK, WORD, Literals

Q = 3                 # least characters of a literal in the index
PIECE = 1 << 18       # bytes looked up at once
MARKED = 1 << 12      # characters of the longest line that is marked: a tail may look at the rest of the line from each
RULES_PER_TAIL, MOST_TAILS = 32, 8
BITS_PER_RULE = 64
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 18
HIT = "struct<test_id:string,severity:string>"


def bitmap_bits(n_rules: int) -> int:
    """Size of the bitmap: a power of two, bounded on both sides."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, n_rules) * BITS_PER_RULE - 1).bit_length()))


def rarest_grams(literals: list, q: int = Q) -> list:
    """For each literal its gram of ``q`` that fewest of the literals share (ties: the first), or all of a shorter literal."""
    grams = [[x[i:i + q] for i in range(max(1, len(x) - q + 1))] for x in literals]
    shared = Counter(g for own in grams for g in set(own))
    return [min(own, key=lambda g: shared[g]) for own in grams]


def shared_tails(patterns: list[str]) -> tuple[list[str], list[tuple[str, str] | None]]:
    """The tails that are marked in the lines, and for each pattern its literal and its tail if that is empty or marked."""
    parts = [p if p and len(p[0]) >= Q else None for p in map(literal_and_tail, patterns)]
    common = Counter(p[1] for p in parts if p and p[1])
    tails = sorted((t for t, n in common.items() if n >= RULES_PER_TAIL), key=lambda t: (-common[t], t))[:MOST_TAILS]
    return tails, [p if p and (not p[1] or p[1] in tails) else None for p in parts]


def build_index(rules: list, numbers: list[int], settled: list[bool], n_entries: int, spark) -> DataFrame:
    """The written table ``entry, pattern, test_id, severity``: ``pattern`` is null where a found entry is a match. An entry
    plus ``n_entries`` is the same one on a line where its tail is not known."""
    rows = [(i, None, r["test_id"], r["severity"]) for r, i, done in zip(rules, numbers, settled) if done]
    rows += [(i + n_entries, r["pattern"], r["test_id"], r["severity"]) for r, i in zip(rules, numbers)]
    return materialize(spark.createDataFrame(rows, "entry int, pattern string, test_id string, severity string"), "rule_index")


def held_entries(entries: list[tuple[bytes, int]], settled: list[bool], line: Column, tails: list[str]) -> Column:
    """The entries (literal, number of its tail or -1) that the line holds; those not settled by it are numbered on."""
    anchors = rarest_grams([x for x, _ in entries], WORD)
    listed = [(x, a, t) for (x, t), a in zip(entries, anchors)]
    # Entries that always need their pattern have a tail that no line has marks for.
    listed = [(x, a, t if done else len(tails)) for (x, a, t), done in zip(listed, settled)]
    bits, step, untested = bitmap_bits(len(entries)), PIECE, not all(settled)

    def search(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        literals = Literals(listed, bits, step)
        for texts, *marked in columns:
            none = [pa.nulls(len(texts), pa.string())] if untested else []
            yield literals.of(texts, *marked[1:], *none)

    search.__annotations__ = {"columns": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    can = ~line.contains(MARK) & (F.length(line) <= MARKED)
    marked = [F.when(can, F.regexp_replace(line, F.lit(f"(?={t})"), F.lit(MARK))) for t in tails]
    # A tuple of columns needs two at least.
    return F.arrow_udf(search, "array<int>")(line, F.lit(0), *marked)


def scan_lines_indexed(lines: DataFrame, rules: DataFrame, line_col: str = "line", keys=("doc_id", "line_no")) -> DataFrame:
    """``keys, test_id, severity`` of every line and rule that match, as ``findings.scan_lines`` gives them.

    ``rules`` (``test_id, severity, pattern``) is a catalogue: its rows are read on the driver, since patterns are code.
    A null line matches nothing; a rule listed twice is found twice.
    """
    catalogue = rules.select("test_id", "severity", "pattern").where("pattern IS NOT NULL").collect()
    literals = [required_literal(r["pattern"]) for r in catalogue]
    return scan_catalogue(lines, catalogue, literals, line_col, keys)


def scan_catalogue(lines: DataFrame, catalogue: list, literals: list[str | None], line_col: str, keys) -> DataFrame:
    """``scan_lines_indexed`` for rule rows that were read already, with the literal each requires (or None)."""
    listed = [(r, x) for r, x in zip(catalogue, literals) if x is not None and len(x) >= Q]
    others = [(r, x) for r, x in zip(catalogue, literals) if x is None or len(x) < Q]
    tails, parts = shared_tails([r["pattern"] for r, _ in listed])
    # An entry: a literal, the number of its tail (-1 without one), whether finding it is a match.
    wanted = [(p[0].encode(), tails.index(p[1]) if p[1] else -1, True) if p else (x.encode(), -1, False) for (_, x), p in zip(listed, parts)]
    entries = {w: i for i, w in enumerate(dict.fromkeys(wanted))}
    settled = [done for _, _, done in entries]

    cols = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    text = lines.select(*cols, F.col(line_col).alias("_line")).where("_line IS NOT NULL")
    line = F.col("_line")
    # One pass: hits of the rules without a literal are settled in the projection, the entries of the others go on.
    known = text.withColumn("_held", held_entries([(x, t) for x, t, _ in entries], settled, line, tails)) if entries \
        else text.withColumn("_held", F.array().cast("array<int>"))
    found = F.coalesce("_held", F.array().cast("array<int>"))
    hit = F.lit(None).cast(HIT)
    if others:
        direct = F.filter(F.array(*[F.when((line.contains(x) & line.rlike(r["pattern"])) if x else line.rlike(r["pattern"]),
                                           _hit(F.lit(r["test_id"]), F.lit(r["severity"]))) for r, x in others]), lambda h: h.isNotNull())
        # A settled hit joins nothing; a number below zero in the place of an entry spreads such rows in a shuffle join.
        apart = (-1 - F.pmod(F.hash("_line"), F.lit(1 << 30))).cast("int")
        found = F.concat(F.transform(found, lambda e: _entry(e, hit)), F.transform(direct, lambda h: _entry(apart, h)))
    rows = known.select(*[f"_k{i}" for i in range(len(keys))], "_line", F.explode(found).alias("_e"))
    # Only the lines of entries that must be tested go along.
    number, hit = (F.col("_e.entry"), F.col("_e.hit")) if others else (F.col("_e"), hit)
    rows = rows.select(*[f"_k{i}" for i in range(len(keys))], F.when(number >= len(entries), line).alias("_line"),
                       number.alias("_number"), hit.alias("_hit"))
    index = build_index([r for r, _ in listed], [entries[w] for w in wanted], [done for _, _, done in wanted], len(entries), lines.sparkSession)
    found = rows.join(index, F.col("_number") == F.col("entry"), "left" if others else "inner")
    matches = F.col("_hit").isNotNull() | (F.col("entry").isNotNull() & (F.col("pattern").isNull() | F.rlike(line, F.col("pattern"))))
    return found.where(matches).select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)],
        F.coalesce("_hit.test_id", "test_id").alias("test_id"), F.coalesce("_hit.severity", "severity").alias("severity"))


def _hit(test_id: Column, severity: Column) -> Column:
    return F.struct(test_id.cast("string").alias("test_id"), severity.cast("string").alias("severity"))


def _entry(number: Column, hit: Column) -> Column:
    return F.struct(number.alias("entry"), hit.alias("hit"))
