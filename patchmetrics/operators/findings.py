"""Findings: scanner reports, rule scans, verification by anti-join, documentation lookup.

* ``explode_scan_report`` (S3 + P5): parse each document's report JSON and unnest its ``results``; malformed JSON
  or a report without results yields no rows (PERMISSIVE ``from_json`` + ``explode``).
* ``scan_lines`` (J11, default of F8): match every line against a caller-supplied rule table. The rules are
  inlined as literal patterns, ``RULES_PER_SCAN`` to a projection, so each pattern compiles once per task and the
  scan is narrow over the lines (no join, no shuffle, no pair explosion); a literal every match must contain is checked
  first with ``contains``. Larger catalogues go through the literal index of ``operators.rule_index``.
* ``verify_findings`` (J3): a finding is patched iff the re-scan of its document has no finding with the same
  rule anywhere in the document and the re-scan parsed; a left join against the de-duplicated re-scan keys.
* ``attach_docs`` (J4): normalised documentation URL -> page text, with the reference's sentinel texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rewrite_doc_version
from ..schemas import SCAN_REPORT_DDL

RULES_PER_SCAN = 500   # rules inlined into one projection; a larger catalogue is indexed

# Documentation lookup outcomes (sentinel texts).
NO_URL_TEXT = "No documentation URL provided."
DOCS_NOT_FOUND_TEXT = "docs not found"


def explode_scan_report(df: DataFrame, report_col: str = "report", keys=("doc_id",)) -> DataFrame:
    """S3 + P5: one row per reported issue with the reference's projection and renames.

    Output: ``keys..., finding_idx (1-based), issue_confidence, issue_severity, issue_text, line_range,
    test_id, test_name, more_info_url, code_snippet``.
    """
    parsed = df.select(*keys, F.from_json(F.col(report_col), SCAN_REPORT_DDL).alias("_r"))
    ex = parsed.select(*keys, F.posexplode("_r.results").alias("_pos", "_i"))
    i = F.col("_i")
    return ex.select(*keys, (F.col("_pos") + 1).alias("finding_idx"),
                     i["issue_confidence"].alias("issue_confidence"), i["issue_severity"].alias("issue_severity"),
                     i["issue_text"].alias("issue_text"), i["line_range"].alias("line_range"),
                     i["test_id"].alias("test_id"), i["test_name"].alias("test_name"),
                     i["more_info"].alias("more_info_url"), i["code"].alias("code_snippet"))


def first_line_projection(findings: DataFrame, keys=("doc_id", "finding_idx")) -> DataFrame:
    """``line_num = line_range[0]``; severity/confidence renamed."""
    return findings.select(*keys, "test_id", F.get(F.col("line_range"), 0).alias("line_num"),
                           F.col("issue_severity").alias("severity"), F.col("issue_confidence").alias("confidence"))


_CLASS_ESCAPES = set("dDwWsSbBAzZGhHvVR")
_META = set(".^$[](){}|*+?\\")


def required_literal(pattern: str) -> str | None:
    """Longest literal substring every match of ``pattern`` must contain, or None when unsure.

    Conservative: groups, alternation, nested or intersected character classes, and escapes that take arguments
    (``\\x``, ``\\u``, ``\\p``, ``\\Q`` ...) give None. Used as a ``contains`` prefilter so the regex only runs on lines that can match.
    """
    if any(ch in pattern for ch in "()|"):
        return None
    runs, cur, i, n = [], "", 0, len(pattern)
    while i < n:
        ch = pattern[i]
        literal = None
        if ch == "[":
            j = i + 1
            if j < n and pattern[j] == "^":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            while j < n and pattern[j] != "]":
                if pattern[j] == "[" or pattern.startswith("&&", j):
                    return None    # Java nests and intersects classes
                if pattern[j] == "\\" and pattern[j + 1:j + 2].isalnum() and pattern[j + 1] not in _CLASS_ESCAPES:
                    return None
                j += 2 if pattern[j] == "\\" else 1
            if j >= n:
                return None
            i = j + 1
        elif ch == "\\":
            if i + 1 >= n:
                return None
            nxt = pattern[i + 1]
            if nxt.isalnum():
                if nxt not in _CLASS_ESCAPES:
                    return None
            else:
                literal = nxt
            i += 2
        elif ch in ".^$":
            i += 1
        elif ch in "*+?{":
            return None            # quantifier without an operand: not a pattern we understand
        else:
            literal = ch
            i += 1
        # quantifier on the token just read
        lo = 1
        if i < n and pattern[i] in "*+?{":
            q = pattern[i]
            if q == "{":
                j = pattern.find("}", i)
                if j < 0:
                    return None
                body = pattern[i + 1:j].split(",")[0]
                if not body.isdigit():
                    return None
                lo, i = int(body), j + 1
            else:
                lo, i = (0 if q in "*?" else 1), i + 1
            if i < n and pattern[i] in "?+":
                i += 1              # lazy / possessive suffix
            if literal is not None and lo >= 1:
                cur += literal
            runs.append(cur)
            cur = ""
            continue
        if literal is None:
            runs.append(cur)
            cur = ""
        else:
            cur += literal
    runs.append(cur)
    best = max(runs, key=len)
    return best or None


def literal_and_tail(pattern: str) -> tuple[str, str] | None:
    """``(literal, tail)`` of a pattern that is a literal followed by a tail (maybe empty), each matching by itself.

    The pattern matches a text iff the literal ends somewhere at a place where the tail matches. None for patterns that
    ``required_literal`` does not understand or that begin otherwise, and for ``\\G``, which depends on earlier matches.
    """
    if required_literal(pattern) is None or "\\G" in pattern:
        return None
    literal, i, n = "", 0, len(pattern)
    while i < n:
        escaped = pattern[i] == "\\" and i + 1 < n and not pattern[i + 1].isalnum()
        if pattern[i] in _META and not escaped:
            break
        end = i + 2 if escaped else i + 1
        if end < n and pattern[end] in "*+?{":
            break                  # the quantifier belongs to this character
        literal, i = literal + pattern[end - 1], end
    return (literal, pattern[i:]) if literal else None


def scan_lines(lines: DataFrame, rules: DataFrame, line_col: str = "line",
               keys=("doc_id", "line_no")) -> DataFrame:
    """``lines JOIN rules ON regexp_like(line, pattern)`` as a narrow map.

    ``rules`` has ``test_id, severity, pattern``: a catalogue of patterns, read on the driver since patterns are code.
    Up to ``RULES_PER_SCAN`` rules are tested in one projection; a larger catalogue goes through the literal index of
    ``operators.rule_index``, again in one pass over the lines. Add ``line_col`` to ``keys`` to keep the text.
    """
    rows = rules.select("test_id", "severity", "pattern").where("pattern IS NOT NULL").collect()
    if not rows:
        return lines.select(*keys, F.lit(None).cast("string").alias("test_id"),
                            F.lit(None).cast("string").alias("severity")).limit(0)
    literals = [required_literal(r["pattern"]) for r in rows]
    if len(rows) > RULES_PER_SCAN:
        from .rule_index import scan_catalogue
        return scan_catalogue(lines, rows, literals, line_col, keys)
    return scan_projected(lines, rows, literals, line_col, keys)


def scan_projected(lines: DataFrame, rows: list, literals: list[str | None], line_col: str, keys) -> DataFrame:
    """Every rule tested on every line in one projection, a required literal first."""
    line = F.col(line_col)

    def matches(pattern: str, lit: str | None) -> Column:
        return (line.contains(lit) & line.rlike(pattern)) if lit else line.rlike(pattern)

    hits = F.array(*[F.when(matches(r["pattern"], x), F.struct(F.lit(r["test_id"]).alias("test_id"),
                                                               F.lit(r["severity"]).alias("severity")))
                     for r, x in zip(rows, literals)])
    matched = lines.select(*keys, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("_h"))
    return matched.select(*keys, F.col("_h.test_id").alias("test_id"), F.col("_h.severity").alias("severity"))


def scan_with(docs: DataFrame, scanner: Callable, schema: str) -> DataFrame:
    """F8: bring-your-own scanner, run per Arrow batch of documents (``mapInPandas``)."""
    return docs.mapInPandas(scanner, schema)


def findings_per_doc(findings: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of findings per document, 0 for documents without any (pre-aggregated, then one join)."""
    counts = findings.groupBy(key).agg(F.count(F.lit(1)).alias("n_findings"))
    return docs.select(key).join(counts, key, "left") \
        .select(key, F.coalesce(F.col("n_findings"), F.lit(0)).cast("bigint").alias("n_findings"))


def verify_findings(findings: DataFrame, rescan: DataFrame, parsed: DataFrame | None = None,
                    key: str = "doc_id") -> DataFrame:
    """Add ``is_patched`` to each finding.

    ``rescan`` holds the findings of the patched documents (``key, test_id``). It is reduced to distinct
    ``(key, test_id)`` before the join, so a rule that fires thousands of times in one document is one row.
    ``parsed`` (``key, rescan_ok``), when given, marks documents whose re-scan output could not be parsed:
    their findings are never patched.
    """
    present = rescan.select(key, "test_id").distinct().withColumn("_still", F.lit(True))
    out = findings.join(present, [key, "test_id"], "left")
    patched = F.col("_still").isNull()
    if parsed is not None:
        out = out.join(parsed.select(key, "rescan_ok"), key, "left")
        patched = patched & F.coalesce(F.col("rescan_ok"), F.lit(False))
    out = out.withColumn("is_patched", patched).drop("_still")
    return out.drop("rescan_ok") if parsed is not None else out


def patched_findings(findings: DataFrame, rescan: DataFrame, key: str = "doc_id") -> DataFrame:
    """J3, set form: findings whose rule no longer fires in their document (``left_anti``)."""
    return findings.join(rescan.select(key, "test_id").distinct(), [key, "test_id"], "left_anti")


def doc_url_key(url: Column) -> Column:
    """X3 applied to a documentation URL (the lookup key)."""
    return rewrite_doc_version(url)


def attach_docs(findings: DataFrame, docs: DataFrame, url_col: str = "more_info_url") -> DataFrame:
    """Findings left-join documentation text by normalised URL; sentinel texts for no URL / no page.

    ``docs`` has ``url, text`` (e.g. ``pages.article_text`` output); one text per normalised URL is kept
    (the page at the normalised URL itself, else the smallest URL). Findings often share one URL (every finding
    of a rule), so the docs side is pre-aggregated to one row per key and the join relies on AQE's skew split for hot URLs. ``url_col`` is
    dropped afterwards (P7).
    """
    keyed = docs.withColumn("_doc_key", doc_url_key(F.col("url")))
    # The page living at the normalised URL itself is the one the reference fetches; otherwise smallest URL.
    pick = F.struct((F.col("url") != F.col("_doc_key")).alias("moved"), F.col("url"))
    per_url = keyed.groupBy("_doc_key").agg(F.min_by("text", pick).alias("_doc_text"))
    f = findings.withColumn("_doc_key", doc_url_key(F.col(url_col)))
    # Findings without a URL need no page: they skip the join, so their common null key is no hot partition.
    has = F.col(url_col).isNotNull() & (F.col(url_col) != "")
    j = f.where(has).join(per_url, "_doc_key", "left").unionByName(
        f.where(~F.coalesce(has, F.lit(False))).withColumn("_doc_text", F.lit(None).cast("string")))
    scraped = (F.when(F.col(url_col).isNull() | (F.col(url_col) == ""), F.lit(NO_URL_TEXT))
               .when(F.col("_doc_text").isNull(), F.lit(DOCS_NOT_FOUND_TEXT))
               .otherwise(F.col("_doc_text")))
    return j.withColumn("scraped", scraped).withColumn("doc_url", F.col("_doc_key")) \
        .drop("_doc_key", "_doc_text", url_col)
