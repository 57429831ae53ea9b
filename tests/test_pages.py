"""Documentation page text (F6) against a plain push-down parser over the library's HTML tokenizer, and by hand."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from patchmetrics.operators.pages import VOID, article_text, decode_references, h1_headings

PAGE = ('<html><head><script>var t="</p>";</script></head><body><article class="d">'
        '<h1>Title &amp; more</h1><p>foo <b>bar</b></p><ul><li><p>in li</p></li></ul>'
        '<p class="x">classed</p><!-- <p>hidden</p> --><p id="k">one</p>\n<h3> Sub </h3></article><h2>outside</h2></body></html>')


class Tree(HTMLParser):
    """The definition, written over another tokenizer: elements with the stripped text nodes inside them."""

    def __init__(self, container, attribute=None):
        super().__init__(convert_charrefs=True)
        self.container, self.attribute, self.stack, self.all, self.data = container, attribute, [], [], ""
        self.box = None

    def node(self):
        text, self.data = self.data.strip(), ""
        for e in self.stack:
            e["text"] += text

    def handle_starttag(self, tag, attrs):
        self.node()
        e = {"tag": tag, "attrs": dict(attrs), "text": "", "li": any(x["tag"] == "li" for x in self.stack),
             "in": any(x is self.box for x in self.stack)}
        if self.box is None and tag == self.container and (not self.attribute or e["attrs"].get(self.attribute[0]) == self.attribute[1]):
            self.box = e
        self.all.append(e)
        self.stack.append(e)
        if tag in VOID:
            self.stack.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        self.node()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k]["tag"] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        if not any(x["tag"] in ("script", "style") for x in self.stack):
            self.data += data

    def handle_comment(self, data):
        self.node()

    handle_decl = handle_pi = unknown_decl = handle_comment


def plain(page, container="article", attribute=None):
    if page is None:
        return None
    t = Tree(container, attribute)
    t.feed(page)
    t.close()
    t.node()
    if t.box is None:
        return "docs not found"
    inside = [e for e in t.all if e["in"]]
    paragraphs = "\n".join(e["text"] for e in inside if e["tag"] == "p" and not e["li"] and "class" not in e["attrs"])
    return paragraphs + "\n".join(e["text"] for e in inside if e["tag"] in ("h1", "h2", "h3")) or None


def texts(spark, pages, *args):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    return {r[0]: r[1] for r in df.select("id", article_text("html", *args)).collect()}


def test_by_hand(spark):
    pages = [PAGE, None, "<p>x</p>", "<article><ul><li>x</li></ul></article>", "",
             "<article><h2>A</h2></article><article><p>second</p></article>",
             "<article>a<p>one<article><p>nested</p></article><p>after</p></article><p>out</p>",     # nested container
             "<article><p>un <b>closed<p>next</article><p>out</p>",                              # text repeats in the outer
             "<article><p>foo <b>bar</b> baz</p><p></p><h1>H</h1><p/><p>a &lt; b &#233;&#xE9; &nope; &amp</p></article>",
             "<li><article><p>in a list outside</p><h2>still</h2></article></li>",
             "<article><p title='a > b' data-x=\"class=\">quoted</p><P CLASS=z>no</P><p class>no</p><p>a < b</p>", "<article/><p>x</p>"]
    want = ["foobar\noneTitle & more\nSub", None, "docs not found", None, "docs not found", "A", "onenestedafter\nnested\nafter",
            "unclosednext\nnext", "foobarbaz\n\n\na < b éé &nope; &ampH", "still", "quoted\na < b", None]
    assert list(texts(spark, pages).values()) == want
    df = spark.createDataFrame([(PAGE,)], "html string")
    assert df.select(h1_headings("html")).first()[0] == "Title &amp; more"


def test_container_by_attribute(spark):
    pages = ['<div>no</div><div itemprop="articleBody"><div><p>a</p></div><p>b</p></div><p>c</p>', "<div itemprop='articleBody'><h1>t</h1>",
             "<div itemprop=articleBody><p>x", "<div itemprop='articleBodyX'><p>x", "<section itemprop='articleBody'><p>x"]
    got = texts(spark, pages, "div", ("itemprop", "articleBody"))
    assert list(got.values()) == ["a\nb", "t", "x", "docs not found", "docs not found"]
    assert list(got.values()) == [plain(p, "div", ("itemprop", "articleBody")) for p in pages]


def test_equal_to_a_plain_parser_on_random_pages(spark):
    rng = random.Random(12)
    bits = ["<p>", "</p>", "<p class='k'>", "<p id=a>", "<li>", "</li>", "<ul>", "</ul>", "<article>", "</article>", "<b>", "</b>", "<br>",
            "<br/>", "<h1>", "</h1>", "<h2 class=q>", "</h2>", "<h3>", "<h4>", "</h4>", "<div>", "</div>", " text ", "more", " a&amp;b ", "\n",
            "<!-- <p>c</p> -->", "<script>var p='<p>';</script>", "<style>p{}</style>", "&eacute;", "<!DOCTYPE x>", "<img src='a>b'>", "<P>", "</DIV>"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    pages = [("<article>" if rng.random() < 0.8 else "") + p for p in pages]
    got = texts(spark, pages)
    for i, p in enumerate(pages):
        assert got[i] == plain(p), p


def test_long_pages(spark):
    pages = ["<article>" + "<p>word &amp; word</p>" * 3000 + "<h1>end</h1></article>", "<article><p>" + "long text < " * 20_000, "<" * 5000,
             "<article><p>" + "&lt;" * 20_000 + "</p>"]
    got = texts(spark, pages)
    assert got[0] == "word & word\n" * 2999 + "word & wordend" and got[2] == "docs not found"
    assert got[1] == ("long text < " * 20_000).strip() and got[3] == "<" * 20_000


def test_references(spark):
    pairs = [("&amp;&lt;&#65;&#x41;&hellip;&NotEqualTilde;", "&<AA…≂̸"), ("&unknown; &amp &; & &#0;&#xD800;&#1114112;", "&unknown; &amp &; & ���"),
             ("plain", "plain"), ("&&amp;amp;", "&&amp;"), ("&#128512;", "😀")]
    df = spark.createDataFrame(pairs, "x string, y string")
    for r in df.select(decode_references(F.col("x")).alias("got"), "y").collect():
        assert r["got"] == r["y"]
