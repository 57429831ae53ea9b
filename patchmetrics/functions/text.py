"""Text functions as Spark Column expressions (JVM-side, codegen'd; no Python per row).

Python-parity notes: Python's ``str.strip``/``str.split`` whitespace is Unicode White_Space plus the four
information separators U+001C..U+001F, hence the class ``[\\s\\x1c-\\x1f]`` under ``(?U)``; Python's ``$`` after a
strip is the end of input, written ``\\z``. ``splitlines`` separators are \\n, \\r, \\r\\n, \\v, \\f, U+001C..U+001E,
U+0085, U+2028 and U+2029.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
WS_CLASS = r"[\s\x1c-\x1f]"
STRIP_RE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
FENCE_HEAD_RE = r"(?U)^```(?:python)?[\s\x1c-\x1f]*"
FENCE_TAIL_RE = r"(?U)[\s\x1c-\x1f]*```\z"
SPLITLINES_RE = r"(?<=\n)|(?<=[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)"
OTHER_SEPARATORS_RE = "[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"  # line separators other than \n
WORD_SPLIT_RE = r"(?U)[\s\x1c-\x1f]+"
DOC_VERSION_RE = r"(?<=/en/)[0-9]+(?:\.[0-9]+)*"
DOC_VERSION_REPLACEMENT = "latest"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()`` with Python's whitespace set."""
    return F.regexp_replace(_c(c), STRIP_RE, "")


def is_blank(c) -> Column:
    """``not s.strip()``; null counts as blank."""
    return F.coalesce(F.length(py_strip(c)) == 0, F.lit(True))


def strip_fences(c) -> Column:
    """Strip, drop one leading ```` ```(python)? ```` plus whitespace and one trailing whitespace + ```` ``` ````.

    Non-string (null) input becomes ``""``. Case-sensitive, so ```` ```py ```` leaves ``py`` behind.
    """
    s = py_strip(F.coalesce(_c(c), F.lit("")))
    return F.regexp_replace(F.regexp_replace(s, FENCE_HEAD_RE, ""), FENCE_TAIL_RE, "")


def clean_reply(c) -> Column:
    """Remove every ```` ```python ```` then every ```` ``` ````, then strip."""
    return py_strip(F.replace(F.replace(_c(c), F.lit("```python"), F.lit("")), F.lit("```"), F.lit("")))


def rewrite_doc_version(c) -> Column:
    """Version segment after ``/en/`` becomes ``latest`` (all occurrences); null stays null."""
    return F.regexp_replace(_c(c), DOC_VERSION_RE, DOC_VERSION_REPLACEMENT)


def split_lines_keepends(c) -> Column:
    """``s.splitlines(keepends=True)`` as ``array<string>``.

    Texts whose only line separator is ``\n`` (the common case) take a plain split with the terminators put
    back; the lookbehind split, which tests every character, runs only for texts holding another separator.
    """
    c = _c(c)
    parts = F.split(c, "\n", -1)
    n = F.size(parts)
    plain = F.transform(parts, lambda x, i: F.when(i < n - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    general = F.split(c, SPLITLINES_RE, -1)
    arr = F.when(c.rlike(OTHER_SEPARATORS_RE), general).otherwise(plain)
    return F.filter(arr, lambda x: x != F.lit(""))


def split_newlines(c) -> Column:
    """Plain ``split('\\n')`` (terminators dropped, trailing empty element kept)."""
    return F.split(_c(c), "\n", -1)


def word_count(c) -> Column:
    """``len(s.split())``."""
    return F.size(F.filter(F.split(_c(c), WORD_SPLIT_RE, -1), lambda x: x != F.lit("")))


def ensure_trailing_newline(c) -> Column:
    """X23."""
    c = _c(c)
    return F.when(c.endswith("\n"), c).otherwise(F.concat(c, F.lit("\n")))


def window_bounds(line, n_lines, window: int = 5) -> tuple[Column, Column]:
    """1-based inclusive bounds ``(start_line, end_line)`` of the +-window slice around ``line``.

    ``start = max(0, line-1-window)``, ``end = min(n, line+window)``; returned as ``start+1 .. end``. When
    ``line > n + window`` the start exceeds the end and the slice is empty.
    """
    line, n_lines = _c(line), _c(n_lines)
    start0 = F.greatest(F.lit(0), line - 1 - window)
    end = F.least(n_lines, line + window)
    return (start0 + 1).cast("int"), end.cast("int")


def slice_lines(lines, start_line, end_line, sep: str = "") -> Column:
    """``sep.join(lines[start-1:end])`` for 1-based inclusive bounds; empty when ``end < start``."""
    lines, s, e = _c(lines), _c(start_line), _c(end_line)
    s0 = F.greatest(s, F.lit(1))
    length = F.greatest(e - s0 + 1, F.lit(0))
    return F.array_join(F.slice(lines, s0, length), sep)


def splice_lines(lines, start_line, end_line, block) -> Column:
    """``lines[:start-1] + [block (+ '\\n')] + lines[end:]``; the block stays ONE element (reference quirk D6)."""
    lines, s, e = _c(lines), _c(start_line), _c(end_line)
    pre = F.slice(lines, F.lit(1), F.greatest(s - 1, F.lit(0)))
    post = F.slice(lines, F.greatest(e + 1, F.lit(1)), F.greatest(F.size(lines) - e, F.lit(0)))
    return F.concat(pre, F.array(ensure_trailing_newline(block)), post)
