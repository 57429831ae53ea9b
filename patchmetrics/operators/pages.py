"""Documentation pages to text (F6); URL normalisation (X3) lives in ``functions.text``.

``article_text`` runs a push-down automaton over the stream of a page's tags, with SQL functions only: a fold whose state
is the stack of open elements. An end tag closes everything up to the last open element of its name and is ignored if
there is none; a start tag closes nothing (so an unclosed paragraph holds the paragraphs behind it); void and self-closed
elements are closed at once. That gives, inside the first container element and however elements nest there,

* its paragraphs: every ``p`` without a ``class`` attribute that no ``li`` holds, and
* its headings: every ``h1``, ``h2`` and ``h3``, wherever they stand,

each as the range of tokens from its start tag to where it was closed. The text of a range is every text node in it,
stripped and joined without a separator, character references decoded; scripts, styles, comments and declarations hold no
text and part text nodes. Paragraphs come first, then headings, each in document order and joined by line ends, with
nothing between the two. A page without the container gives the "not found" text, a container without any text gives
null, a null page gives null.

References are decoded when they end in a semicolon; an unknown name stays as it is; a number that is no character
becomes U+FFFD. A ``<`` that starts no tag is text; a container that never ends reaches to the end of the page.
"""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import STRIP_RE
from .findings import DOCS_NOT_FOUND_TEXT

DEFAULT_CONTAINER = "article"
# Elements that never hold anything.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param", "source",
        "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer")
_TEXT = r"[^<]++(?:<(?![a-zA-Z/!?])[^<]*+)*+|(?:<(?![a-zA-Z/!?])[^<]*+)++"
_TOKEN = (r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\z)|<[!?][^>]*+>?"
          r"|</?[a-zA-Z][^>'\"]*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>'\"]*+)*+>|</?[a-zA-Z][^>]*+>?|</[^>]*+>?|" + _TEXT)
_REFERENCE = r"&(?:#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[a-zA-Z][a-zA-Z0-9]{1,40});|[^&]++|&"
_STATE = ("struct<stack:array<struct<name:string,at:int,keep:int,li:int>>,box:int,out:array<struct<at:int,till:int,keep:int>>>")
PARAGRAPH, HEADING = 1, 2


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, also where ``then`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def decode_references(text: Column) -> Column:
    """Character references (``&amp;``, ``&#233;``, ``&#xE9;``) to the characters they name."""
    names = F.from_json(F.lit(json.dumps({f"&{k}": v for k, v in html.entities.html5.items() if k.endswith(";")})), "map<string,string>")

    def one(x: Column) -> Column:
        hexed = x.rlike("^&#[xX]")
        digits = F.regexp_extract(x, "^&#[xX]?([0-9a-fA-F]+);$", 1)
        n = F.when(hexed, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
        valid = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        number = F.when(valid, char).otherwise(F.lit("�"))
        return (F.when(x.rlike("^&#[xX]?[0-9a-fA-F]+;$"), number).when(x.rlike("^&[a-zA-Z]"), F.coalesce(F.try_element_at(names, x), x))
                .otherwise(x))

    return F.when(~text.contains("&"), text).otherwise(
        F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), 0), one), ""))


def _tag(x: Column, i: Column, container: str, attribute: tuple[str, str] | None) -> Column:
    """Token ``i`` as ``(i, kind, name, plain, box, x)``: kind 0 text, 1 start, 2 end, 3 start and end, -1 nothing."""
    name = F.lower(F.regexp_extract(x, r"^</?([a-zA-Z][^\s/>]*)", 1))
    is_tag = x.rlike("^</?[a-zA-Z]")
    kind = (F.when(x.rlike(r"^(?:[^<]|<(?![a-zA-Z/!?]))"), 0).when(~is_tag | name.isin("script", "style"), -1)
            .when(x.startswith("</"), 2).when(name.isin(*VOID) | x.endswith("/>"), 3).otherwise(1))
    plain = ~F.regexp_replace(x, r"\"[^\"]*+\"|'[^']*+'", "''").rlike(r"(?i)[\s']class\s*+(?:=|[\s/>])")
    box = name == container
    if attribute:
        key, value = attribute
        box = box & x.rlike(rf"(?i:\s{key}\s*+=\s*+)(?:\"{value}\"|'{value}'|{value}(?=[\s>]))")
    return F.struct(i.cast("int").alias("i"), kind.cast("int").alias("kind"), name.alias("name"), plain.alias("plain"), box.alias("box"),
                    x.alias("x"))


def _range(e: Column, till: Column) -> Column:
    return F.struct(e["at"].alias("at"), till.cast("int").alias("till"), e["keep"].alias("keep"))


def _step(s: Column, t: Column) -> Column:
    """The automaton: state ``(stack, box, out)`` after tag ``t``. ``box`` is 0 before the container, then its place in the
    stack, and -1 behind it."""
    stack, box, out = s["stack"], s["box"], s["out"]

    def close(p: Column) -> Column:     # from place p on; one place behind the top closes nothing
        ended = F.filter(F.slice(stack, p, F.size(stack)), lambda e: e["keep"] > 0)
        return F.struct(F.slice(stack, F.lit(1), p - 1).alias("stack"), F.when(box >= p, -1).otherwise(box).alias("box"),
                        F.concat(out, F.transform(ended, lambda e: _range(e, t["i"]))).alias("out"))

    def start(e: Column) -> Column:
        found = (box == 0) & t["box"]
        once = F.struct(stack.alias("stack"), F.when(found, -1).otherwise(box).alias("box"),
                        F.when(e["keep"] > 0, F.concat(out, F.array(_range(e, t["i"])))).otherwise(out).alias("out"))
        push = F.struct(F.concat(stack, F.array(e)).alias("stack"), F.when(found, F.size(stack) + 1).otherwise(box).alias("box"),
                        out.alias("out"))
        return F.when(t["kind"] == 3, once).otherwise(push)

    li = F.coalesce(F.try_element_at(stack, F.lit(-1))["li"], F.lit(0))
    keep = (F.when(box <= 0, 0).when((t["name"] == "p") & (li == 0) & t["plain"], PARAGRAPH)
            .when(t["name"].isin("h1", "h2", "h3"), HEADING).otherwise(0))
    element = F.struct(t["name"].alias("name"), t["i"].alias("at"), keep.alias("keep"),
                       (li + (t["name"] == "li").cast("int")).alias("li"))
    last = F.array_position(F.reverse(F.transform(stack, lambda e: e["name"])), t["name"]).cast("int")
    return (F.when(box == -1, s).when(t["kind"] == 2, _let(F.size(stack) + 1 - last, close)).otherwise(_let(element, start)))


def article_text(html_col: str = "html", container: str = DEFAULT_CONTAINER, attribute: tuple[str, str] | None = None) -> Column:
    """Text of the page's first ``container`` element (with the ``(name, value)`` attribute, if one is given)."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(_TOKEN), F.lit(0))
    tokens = F.transform(found, lambda x, i: _tag(x, i, container, attribute))
    zero = F.struct(F.array().alias("stack"), F.lit(0).alias("box"), F.array().alias("out")).cast(_STATE)

    def ranges(tokens: Column) -> Column:
        def at_end(s: Column) -> Column:
            still = F.filter(s["stack"], lambda e: e["keep"] > 0)
            return F.struct(s["box"].alias("box"), F.array_sort(F.concat(s["out"], F.transform(
                still, lambda e: _range(e, F.size(tokens))))).alias("out"))

        kept = F.aggregate(F.filter(tokens, lambda t: t["kind"] > 0), zero, _step, at_end)
        texts = F.transform(tokens, lambda t: F.when(t["kind"] == 0, F.regexp_replace(decode_references(t["x"]), STRIP_RE, ""))
                            .otherwise(""))
        return _let(F.struct(kept.alias("kept"), texts.alias("texts")), joined)

    def joined(v: Column) -> Column:
        def of(kind: int) -> Column:
            own = F.filter(v["kept"]["out"], lambda e: e["keep"] == kind)
            return F.array_join(F.transform(own, lambda e: F.array_join(
                F.slice(v["texts"], e["at"] + 1, e["till"] - e["at"]), "")), "\n")

        return F.when(v["kept"]["box"] == 0, F.lit(DOCS_NOT_FOUND_TEXT)).otherwise(
            F.nullif(F.concat(of(PARAGRAPH), of(HEADING)), F.lit("")))

    return F.when(F.col(html_col).isNotNull(), _let(tokens, ranges))


def h1_headings(html_col: str = "html") -> Column:
    """Headings key: text of every ``<h1>`` without nested tags, newline-joined, entities left encoded."""
    return F.array_join(F.regexp_extract_all(F.col(html_col), F.lit(r"<h1[^>]*>([^<]*)</h1>"), 1), "\n")
