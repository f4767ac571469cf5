"""HTML extraction by union-free regular expressions that pages of one host are aligned to.

A wrapper is an expression over the tokens of pages: elements, text slots, optional and repeated parts. It begins
as the first page; each further page is aligned with it, and what does not match becomes optional or
repeated, never a choice between alternatives. What the slots of a host's wrapper hold in all its pages
tells which part of it is the article; pages are read through it.
"""

from __future__ import annotations

import html
import json
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.markup import ASIDES, HEADERS, TEXT, Element, Slot, inline, parse, told_words
from corpuscope.llm.registry import query, table
from corpuscope.session import shuffle_partitions, stored

#: Kinds of children from which a list of children is one repeated group of optional ones.
KINDS = 64
#: Ways that the pages of one host are dealt before their wrappers meet.
WAYS = 64
#: Shapes and wrappers that a task remembers.
REMEMBERED = 4096

#: The key of a repeated group, whose members are optional and stand in any number.
GROUP = "()"
OPTIONAL, REPEATED = 1, 2

# A node of a wrapper: key, marks, signs of text, signs of text in links, children.
Node = list

# fixed values: element names that hold no text of an article
_LEFT_OUT = frozenset(
    "head nav footer aside form button select option optgroup noscript template svg object canvas audio video dialog menu dir search".split()
)
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
_LISTS = frozenset("ul ol dl table menu dir".split())
#: Words in names that mark the part with the article, if no element does.
_MAIN = frozenset("content main article post entry story".split())
#: The share of a page's plain text that an element must hold to be the article, and to be looked into.
_ENOUGH, _MOST = 0.3, 0.7
#: The share of links from which a list outside an article element is a menu.
_LINKED = 0.8


def _words(key: str) -> set[str]:
    return {word for name in key.split(" ")[1:] for word in told_words(name)}


def _tag(key: str) -> str:
    return key.partition(" ")[0].lstrip("~")


def left_out(key: str) -> bool:
    """Whether an element is no part of an article, by its own name."""
    tag = _tag(key)
    if tag in ("html", "body", "main"):
        return False
    return tag in _LEFT_OUT or bool(_words(key) & ASIDES)


def _header(key: str) -> bool:
    return _tag(key) == "header" or bool(_words(key) & HEADERS)


# --- inference ------------------------------------------------------------------------------------


def _absorb(nodes: list[Node], keys: set[str]) -> list[Node]:
    """Every run of nodes of these keys, and of groups, as one group."""
    out: list[Node] = []
    for node in nodes:
        if node[0] != GROUP and node[0] not in keys:
            out.append(node)
            continue
        members = node[4] if node[0] == GROUP else [node]
        if out and out[-1][0] == GROUP:
            out[-1] = [GROUP, out[-1][1] | node[1] & OPTIONAL, 0, 0, _members(out[-1][4] + members)]
        else:
            out.append([GROUP, node[1] & OPTIONAL | REPEATED, 0, 0, _members(members)])
    return out


def _members(nodes: list[Node]) -> list[Node]:
    """One node for each key, in order of first appearance."""
    kept: dict[str, Node] = {}
    for node in nodes:
        kept[node[0]] = _merged(kept[node[0]], node) if node[0] in kept else node
    return list(kept.values())


def _repeats(nodes: list[Node]) -> list[Node]:
    """Neighbours of one key as one repeated node, and stretches that repeat as repeated groups."""
    out: list[Node] = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            out[-1] = _merged(out[-1], node)
            out[-1][1] |= REPEATED
        else:
            out.append(node)
    if len(out) > KINDS:
        out = _absorb(out, {node[0] for node in out})
    period = 2
    while 2 * period <= len(out):
        keys = [node[0] for node in out]
        run = start = 0
        for i in range(period, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[i - period]:
                run += 1
                continue
            if run >= period:  # a stretch that stands twice at least
                start = i - run - period
                break
            run = 0
        if run >= period:
            out = _absorb(out, {node[0] for node in out[start : start + run + period]} - {GROUP})
            period = 2
        else:
            period += 1
    if len(out) == 1 and out[0][0] == GROUP and len(out[0][4]) > KINDS:
        out = [[GROUP, out[0][1], 0, 0, _members([_plain(node) for node in out[0][4]])]]
    return out


def _plain(node: Node) -> Node:
    """A node known by its name and the words that tell its part only."""
    key = node[0]
    if key == TEXT:
        return node
    lead = "~" if inline(key) else ""
    told = sorted(_words(key) & (ASIDES | HEADERS | _MAIN))
    return [" ".join([lead + _tag(key), *told]), *node[1:]]


def _merged(a: Node, b: Node) -> Node:
    """A node that matches what either matches."""
    return [a[0], a[1] | b[1], a[2] + b[2], a[3] + b[3], aligned(a[4], b[4]) if a[4] or b[4] else []]


def _optional(node: Node) -> Node:
    return [node[0], node[1] | OPTIONAL, *node[2:]]


def aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """The children of a wrapper's node aligned with those of another: what only one has is optional."""
    if [n[0] for n in a] == [n[0] for n in b]:
        return [_merged(x, y) for x, y in zip(a, b, strict=True)]
    grouped = {m[0] for n in (*a, *b) if n[0] == GROUP for m in n[4]}
    if grouped:
        a, b = _absorb(a, grouped), _absorb(b, grouped)
    # the longest common sequence of keys; lists are short, as repeats are one node
    rows, columns = len(a), len(b)
    longest = [[0] * (columns + 1) for _ in range(rows + 1)]
    for i in range(rows - 1, -1, -1):
        for j in range(columns - 1, -1, -1):
            if a[i][0] == b[j][0]:
                longest[i][j] = longest[i + 1][j + 1] + 1
            else:
                longest[i][j] = max(longest[i + 1][j], longest[i][j + 1])
    out: list[Node] = []
    i = j = 0
    while i < rows or j < columns:
        if i < rows and j < columns and a[i][0] == b[j][0]:
            out.append(_merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == columns or (i < rows and longest[i + 1][j] >= longest[i][j + 1]):
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return _repeats(out)


def shape(element: Element | Slot) -> Node:
    """A page's own wrapper: its tree with repeats found."""
    if isinstance(element, Slot):
        size = sum(len(piece.strip()) for piece in element.pieces)
        return [TEXT, 0, size, min(size, element.links), []]
    children = [shape(c) for c in element.children if not isinstance(c, Slot) or any(map(str.strip, c.pieces))]
    return [element.key, 0, 0, 0, _repeats(children)]


def expression(node: Node) -> str:
    """The wrapper as a regular expression over tags and slots."""
    inner = "".join(map(expression, node[4]))
    if node[0] == TEXT:
        whole = TEXT
    else:
        whole = inner if node[0] == GROUP else f"<{node[0]}>{inner}</{_tag(node[0])}>"
    sign = {0: "", OPTIONAL: "?", REPEATED: "+", OPTIONAL | REPEATED: "*"}[node[1]]
    return f"({whole}){sign}" if sign or node[0] == GROUP else whole


# --- which part is the article --------------------------------------------------------------------


def _masses(node: Node, inside: bool, found: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """Plain text and linked text below each node, without what is left out."""
    plain, linked = (0, 0) if inside else (node[2] - node[3], node[3])
    inside = inside or left_out(node[0])
    for child in node[4]:
        more = _masses(child, inside, found)
        plain, linked = plain + more[0], linked + more[1]
    found[id(node)] = (0, 0) if inside else (plain, linked)
    return found[id(node)]


def _below(node: Node) -> Iterator[Node]:
    for child in node[4]:
        if not left_out(child[0]):
            yield child
            yield from _below(child)


def labelled(wrapper: Node) -> Node:
    """The wrapper with the article marked: nodes as key, kind, members; kind 1 is the article, 2 is left out.

    The article is the article element that holds most of the plain text in all pages; else the main
    element or one whose names say so; else the innermost element that still holds most of the text. Around and
    in it the elements that are no part of an article are left out, by name, and lists of links outside an article element.
    """
    found: dict[int, tuple[int, int]] = {}
    whole, _ = _masses(wrapper, False, found)
    chosen, sure = None, False
    tests = (
        lambda key: _tag(key) == "article",
        lambda key: _tag(key) == "main",
        lambda key: not inline(key) and bool(_words(key) & _MAIN),
    )
    for test in tests:
        options = [node for node in _below(wrapper) if node[0] not in (TEXT, GROUP) and test(node[0])]
        best = max(options, key=lambda node: found[id(node)][0], default=None)
        if best is not None and found[id(best)][0] > 0 and found[id(best)][0] >= _ENOUGH * whole:
            chosen, sure = best, test is tests[0]
            break
    if chosen is None:
        chosen = wrapper
        while True:
            inner = [n for n in chosen[4] if n[0] != TEXT and not n[1] & REPEATED and not left_out(n[0])]
            best = max(inner, key=lambda node: found[id(node)][0], default=None)
            if best is None or not best[4] or found[id(best)][0] < _MOST * max(1, found[id(chosen)][0]):
                break
            chosen = best

    def told(node: Node) -> list:
        kind = 0
        plain, linked = found[id(node)]
        if node is chosen:
            kind = 1
        elif left_out(node[0]) or (not sure and _tag(node[0]) in _LISTS and linked > _LINKED * (plain + linked)):
            kind = 2
        return [node[0], kind, [told(child) for child in node[4]]]

    return told(wrapper)


def _matched(keys: list[str], nodes: list) -> Iterator[list | None]:
    """The wrapper's node of each child of a page, in order."""
    at = 0

    def fits(node: list, key: str) -> list | None:
        if node[0] == key:
            return node
        if node[0] == GROUP:
            return next((m for m in node[2] if m[0] == key), None)
        return None

    plain = {}
    for key in keys:
        hit = None
        for i in (*range(at, len(nodes)), *range(at)):
            hit = fits(nodes[i], key)
            if hit is not None:
                at = i
                break
        if hit is None:  # keys of a crowded list are known by their telling words
            if key not in plain:
                plain[key] = _plain([key])[0]
            if plain[key] != key:
                hit = next((h for n in nodes if (h := fits(n, plain[key])) is not None), None)
        yield hit


def article(page: Element, wrapper: list) -> list[str]:
    """The blocks of the article of a page, read through a labelled wrapper."""
    blocks: list[str] = []
    pieces: list[str] = []

    def flush() -> None:
        block = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if block:
            blocks.append(block)

    def walk(element: Element, node: list | None, inside: bool, headings: bool) -> None:
        """``headings``: within a header, where only headings belong to the article."""
        nodes = node[2] if node is not None else []
        keys = [child.key for child in element.children]
        for child, own in zip(element.children, _matched(keys, nodes), strict=True):
            if isinstance(child, Slot):
                if inside and not headings:
                    pieces.extend(child.pieces)
                continue
            if own[1] == 2 if own is not None else left_out(child.key):
                continue
            here = inside or (own is not None and own[1] == 1)
            if not inline(child.key):
                flush()
            bare = (headings or (here and _header(child.key))) and _tag(child.key) not in _HEADINGS
            walk(child, own, here, bare)
            if not inline(child.key):
                flush()

    walk(page, wrapper, wrapper[1] == 1, False)
    flush()
    return blocks


# --- over tables ----------------------------------------------------------------------------------


def host(url: Column) -> Column:
    """The host of an address in lower case, empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))


def _told(wrappers: dict[str, Node]) -> Iterator[pa.RecordBatch]:
    names = sorted(wrappers)
    for first in range(0, len(names), 256):
        some = names[first : first + 256]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array([json.dumps(wrappers[n], separators=(",", ":")) for n in some])],
            names=["host", "wrapper"],
        )


def _inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A wrapper for each host among a task's pages; pages of one shape are aligned once."""
    wrappers: dict[str, Node] = {}
    for batch in batches:
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = shape(parse(page.as_py() or ""))
            wrappers[name] = _merged(wrappers[name], own) if name in wrappers else own
        if len(wrappers) >= REMEMBERED:
            yield from _told(wrappers)
            wrappers = {}
    yield from _told(wrappers)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host out of those that stand in a row; one at a time is held."""
    name, wrapper = None, None
    for batch in batches:
        for following, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            node = json.loads(text)
            if following == name:
                wrapper = _merged(wrapper, node)
                continue
            if name is not None:
                yield from _told({name: wrapper})
            name, wrapper = following, node
    if name is not None:
        yield from _told({name: wrapper})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """A wrapper for each host: ``host``, ``wrapper`` (JSON), from ``url`` and ``html`` of all pages.

    Every task aligns its own pages, so a host that holds a third of all rows sends one wrapper from
    each task. These are dealt 64 ways and aligned, and then the 64 of each host.
    """
    parts = shuffle_partitions(pages.sparkSession)
    schema = "host string, wrapper string"
    found = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_inferred, schema)
    found = stored(found, "shapes")
    dealt = found.withColumn("way", F.pmod(F.xxhash64("wrapper"), F.lit(WAYS)))
    dealt = dealt.repartition(parts, "host", "way").sortWithinPartitions("host", "way", "wrapper").select("host", "wrapper")
    some = dealt.mapInArrow(_folded, schema)
    some = some.repartition(parts, "host").sortWithinPartitions("host", "wrapper")
    return some.mapInArrow(_folded, schema)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: OrderedDict[str, list] = OrderedDict()
    for batch in batches:
        texts = []
        for page, told in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            if told not in known:
                known[told] = labelled(json.loads(told))
                if len(known) > REMEMBERED:
                    known.popitem(last=False)
            tree = parse(page.as_py() or "")
            blocks = article(tree, known[told])
            if not blocks:  # a page of another kind than the host's others is its own wrapper
                blocks = article(tree, labelled(shape(tree)))
            texts.append("\n\n".join(blocks))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_articles(pages: DataFrame) -> DataFrame:
    """The main text of every page: ``page_id``, ``url``, ``text``, ``n_chars`` (its code points).

    The text is that of the article: no menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
    markup or reader comments. Character references are decoded, white space within a block is one
    space, blocks stand in page order with an empty line between; nothing is cut off.

    A null or empty page has an empty text, and so has one without an article. Pages without a host
    share one wrapper. Each row is a page of its own, repeated rows and null ids too; extra columns are left
    aside. An empty table gives no rows. Markup may be broken or end anywhere.
    """
    wrappers = stored(infer_wrappers(pages), "wrappers")
    plain = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("_host"))
    full = plain.join(wrappers, F.col("_host") == F.col("host")).select("page_id", "url", "html", "wrapper")
    kind = pages.schema["page_id"].dataType.simpleString()
    return full.mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")


@query("op11_page_wrappers")
def op11_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_articles(table(spark, sf_dir, "pages"))
