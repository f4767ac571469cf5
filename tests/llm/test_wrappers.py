import html
import json
import random
import re
from html.parser import HTMLParser

import pytest

from corpuscope.llm import wrappers as module
from corpuscope.llm.markup import DEEPEST, parse
from corpuscope.llm.registry import QUERIES
from corpuscope.llm.wrappers import _merged, aligned, article, expression, extract_articles, labelled, shape
from tests.conftest import DATA

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def words(seed, n=12):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) for _ in range(n)).capitalize() + "."


def read(page, *others):
    wrapper = shape(parse(page))
    for other in others:
        wrapper = _merged(wrapper, shape(parse(other)))
    return "\n\n".join(article(parse(page), labelled(wrapper)))


class Plain(HTMLParser):
    """All text of the article element by block, with the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks, self.piece = False, [], ""

    def flush(self):
        text = " ".join(self.piece.split())
        self.blocks += [text] if text else []
        self.piece = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "h1", "p"):
            self.flush()
            self.inside = self.inside or tag == "article"
        elif tag == "br":
            self.piece += " "

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p"):
            self.flush()
            self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.piece += data


def test_query_on_the_table(llm):
    pages = llm.read.parquet(f"{DATA}/pages.parquet").collect()
    expected = {}
    for row in pages:
        parser = Plain()
        parser.feed(row.html)
        parser.close()
        expected[row.page_id] = (row.url, "\n\n".join(parser.blocks))
    got = QUERIES["op11_page_wrappers"](llm, DATA).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == expected
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(pages)


def full_page(seed, paragraphs, aside=True, comments=True):
    body = "".join(f"<p class='t{i}'>{words(seed * 100 + i)}" for i in range(paragraphs))
    return f"""<!DOCTYPE html><html><head><title>T &amp; T</title><style>p > a {{}}</style></head>
    <body class="has-sidebar"><header class="site"><a href="/">Logo</a><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav>
    <div class="cookie-notice">We use <b>cookies</b></div>
    <div id="content"><article id="post-{seed}"><header><h1>Title {seed}</h1><span>By someone</span></header>
    {body}<div class="adBox">Buy now</div><blockquote>Caf&eacute; &lt;b&gt; &#8212;&nbsp;x</blockquote>
    <form><label>Name</label><input></form><footer>Tags</footer></article>
    {"<aside>Related things</aside>" if aside else ""}
    {"<div id='comments'><h3>2 comments</h3><article class='comment'><p>" + words(seed + 7, 80) + "</article></div>" if comments else ""}
    </div><script>if (a < b) document.write("</p><p>no</p>")</script><footer>&copy; 2020</footer></body></html>"""


def full_text(seed, paragraphs):
    blocks = [f"Title {seed}", *(words(seed * 100 + i) for i in range(paragraphs)), "Café <b> — x"]
    return "\n\n".join(blocks)


def test_only_the_article_is_left(llm):
    rows = [(i, "https://Example.org/%d" % i, full_page(i, i % 5 + 1, i % 2 == 0, i % 3 == 0)) for i in range(40)]
    rows += [(7, "https://example.org/7", full_page(7, 3))] * 2 + [(None, "http://other.example/", full_page(50, 2))]
    df = llm.createDataFrame(rows, "page_id long, url string, html string").repartition(5).selectExpr("*", "'x' AS text", "1 AS host", "2 AS wrapper")
    got = sorted(((r.page_id, r.url, r.text) for r in extract_articles(df).collect()), key=repr)
    expected = [(i, u, full_text(i, i % 5 + 1)) for i, u, _ in rows[:40]] + [(7, "https://example.org/7", full_text(7, 3))] * 2
    assert got == sorted([*expected, (None, "http://other.example/", full_text(50, 2))], key=repr)


def test_nulls_and_empty_tables(llm):
    schema = "page_id long, url string, html string"
    rows = [(1, None, None), (2, "no address", ""), (3, None, "<p>only text"), (4, "http://a.b", "<nav>menu</nav>"), (5, "http://a.b", None)]
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract_articles(llm.createDataFrame(rows, schema)).collect()}
    assert got == {1: (None, "", 0), 2: ("no address", "", 0), 3: (None, "only text", 9), 4: ("http://a.b", "", 0), 5: ("http://a.b", "", 0)}
    assert extract_articles(llm.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>a<p>b <b>c</b>d<br>e</article>", "a\n\nb cd e"),
        ("<article>a<div>b</div>c<ul><li>d<li>e</ul>f", "a\n\nb\n\nc\n\nd\n\ne\n\nf"),
        ("<main><p>x &amp;amp; y &ampz &am &#x41;</main><div>junk</div>", "x &amp; y &z &am A"),
        ("<article><a title=\"a > b\">link</a> <!-- <p>no</p> -->1 < 2 <3</article>", "link 1 < 2 <3"),
        ("<article>cut <p>in the <b", "cut\n\nin the"),
        ("<article>x<script>var a = '<p>no</p>'", "x"),
        ("<article>x</article", "x"),
        ("<article><p>one <span class='ad'>no</span> two</p></article>", "one two"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\n\nb\n\nc"),
        ("<article hidden>no</article><article><p>yes</article>", "yes"),
        ("<div class='story'><p>yes yes</div><div class='box'>no</div>", "yes yes"),
        ("<article><p style='display: none'>no<p>yes</article>", "yes"),
        ("<ARTICLE> a\t\n b c</ARTICLE>", "a b c"),
        ("no markup at all", "no markup at all"),
        ("</p></div>stray", "stray"),
        ("", ""),
    ],
)
def test_small_pages(page, text):
    assert read(page) == text


def test_deep_and_long_pages():
    deep = "<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after</article>"
    assert read(deep) == "deep\n\nafter"
    assert read("<article>" + "<p>x y</p>" * 50_000 + "</article>").count("x y") == 50_000
    kinds = "<article>" + "".join(f"<div class='{a}{b}'>{a}{b}</div>" for a in "qwrtz" for b in "abcdefghijklmnopqrstuvwxyz") + "</article>"
    assert read(kinds).split("\n\n") == [f"{a}{b}" for a in "qwrtz" for b in "abcdefghijklmnopqrstuvwxyz"]
    assert read("<article>" + "<p <p" * 20_000).strip() == ""
    assert DEEPEST < 500


def test_repeats_and_options():
    one = shape(parse("<article><h2>a</h2><p>b</p><h2>c</h2><p>d</p><p>e</p></article>"))
    assert expression(one) == "<html><article>(<h2>#</h2>(<p>#</p>)+)+</article></html>"
    two = shape(parse("<div>x</div><article><h2>a</h2></article>"))
    assert expression(_merged(one, two)) == "<html>(<div>#</div>)?<article>(<h2>#</h2>(<p>#</p>)*)+</article></html>"


def test_alignment_matches_every_page_it_came_from():
    """Brute force: every page's tokens match the wrapper as a regular expression."""
    pick = random.Random(5)

    def made(depth):
        out = ""
        for _ in range(pick.randrange(4)):
            tag = pick.choice(["div", "section", "ul"])
            out += f"<{tag}>{made(depth - 1) if depth else 'x'}</{tag}>"
        return out or "x"

    def pattern(node):
        inner = "".join(map(pattern, node[4]))
        whole = f"(?:{inner})" if node[0] == module.GROUP else "#" if node[0] == "#" else f"(?:<{node[0]}>{inner}</{node[0]}>)"
        if node[0] == module.GROUP:  # members are optional
            whole = "(?:" + "".join(f"(?:{pattern(m)})*" for m in node[4]) + ")"
        return whole + {0: "", 1: "?", 2: "+", 3: "*"}[node[1]]

    def tokens(element):
        if element.key == "#":
            return "#"
        return f"<{element.key}>{''.join(map(tokens, element.children))}</{element.key}>"

    for _ in range(60):
        pages = [made(2) for _ in range(4)]
        wrapper = shape(parse(pages[0]))
        for page in pages[1:]:
            wrapper = _merged(wrapper, shape(parse(page)))
        for page in pages:
            assert re.fullmatch(pattern(wrapper), tokens(parse(page)))
        assert json.loads(json.dumps(wrapper)) == wrapper


def test_alignment_of_lists():
    def nodes(keys):
        return [[k, 0, 0, 0, []] for k in keys]

    assert [(n[0], n[1]) for n in aligned(nodes("abc"), nodes("adc"))] == [("a", 0), ("b", 1), ("d", 1), ("c", 0)]
    assert html.unescape("&amp") == "&"
