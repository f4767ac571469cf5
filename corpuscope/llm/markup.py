"""Web pages as trees of block elements and text slots, with the end tags that pages leave out."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# fixed values: element names of HTML by what they do to blocks
BLOCKS = frozenset(
    "html head body address article aside blockquote button canvas caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav noscript object "
    "ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul audio video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; all of it is left out.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
#: What an opening tag ends if it is still open, and the elements it does not look beyond.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"optgroup"}, {"select"}),
    **{section: ({"thead", "tbody", "tfoot"}, {"table"}) for section in ("thead", "tbody", "tfoot")},
    **{f"h{i}": ({f"h{j}" for j in range(1, 7)}, BLOCKS - {f"h{j}" for j in range(1, 7)}) for i in range(1, 7)},
}
#: Elements nest no deeper than this; a deeper one stands beside the last.
DEEPEST = 100
#: The key of a text slot.
TEXT = "#"

# a value in quotes may hold any sign; a quote that never ends is like any other sign
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"[^a-z]+")

# fixed values: words in names of classes, ids and roles that mark what is not the article
ASIDES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promoted "
    "promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer "
    "masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login comment comments commentlist respond reply replies disqus discussion share sharing social related "
    "recommended recommendations pagination pager search skip copyright contentinfo complementary dialog alertdialog hidden".split()
)
HEADERS = frozenset({"header"})
_NEGATED = frozenset("with has no without not is hide".split())


@dataclass
class Slot:
    """A stretch of text between structural tags, as it stands in the page, and how much of it is in links."""

    pieces: list[str] = field(default_factory=list)
    links: int = 0
    key: str = TEXT


@dataclass
class Element:
    """A structural element: its key (name and what its attributes tell of its role) and its children."""

    key: str
    children: list[Element | Slot] = field(default_factory=list)

    @property
    def tag(self) -> str:
        return self.key.partition(" ")[0]


def inline(key: str) -> bool:
    """Whether a key is that of an element within a line, which does not end a block."""
    return key.startswith("~")


def name_words(name: str) -> list[str]:
    return [w for w in _WORDS.split(_CAMEL.sub("-", name).lower()) if w]


def told_words(name: str) -> frozenset[str]:
    """The role words of one class or id; none if the name says that something has or lacks them."""
    words = name_words(name)
    return frozenset() if words and words[0] in _NEGATED else frozenset(words)


def _key(tag: str, attributes: str) -> str:
    """Name, then class, id and role in order of name; digits all count as 0."""
    names: set[str] = set()
    for match in _NAMED.finditer(attributes):
        kind, value = match.group(1).lower(), match.group(2) or match.group(3) or match.group(4) or ""
        if kind == "style":
            if "display:none" in value.replace(" ", "").lower():
                names.add("hidden")
        elif kind == "hidden" or (kind == "aria-hidden" and value.lower() == "true"):
            names.add("hidden")
        elif kind != "aria-hidden":
            names.update(re.sub(r"\d+", "0", name) for name in value.split())
    return " ".join([tag, *sorted(names)])


def parse(page: str) -> Element:
    """The tree of a page.

    Comments, declarations and raw elements are left out. End tags may be missing and markup may
    end anywhere; what follows a tag that never closes is no text. Elements within a line are part
    of the text around them unless their names tell that they are not of the article.
    """
    root = Element("html")
    stack: list[Element] = [root]
    links: list[int] = []  # depths at which links were opened
    at, size = 0, len(page)

    def text(piece: str) -> None:
        top = stack[-1]
        if top.key == "head" and piece.strip():
            stack.pop()
            top = stack[-1]
        if not top.children or not isinstance(top.children[-1], Slot):
            top.children.append(Slot())
        slot = top.children[-1]
        slot.pieces.append(piece)
        if links:
            slot.links += len(piece.strip())

    def close_to(depth: int) -> None:
        del stack[depth:]
        while links and links[-1] > len(stack):
            links.pop()

    while at < size:
        opening = page.find("<", at)
        if opening < 0:
            text(page[at:])
            break
        if opening > at:
            text(page[at:opening])
        following = page[opening + 1 : opening + 2]
        if following in ("!", "?"):
            if page.startswith("<!--", opening):
                end = page.find("-->", opening + 4)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", opening)
                at = size if end < 0 else end + 1
            continue
        match = _TAG.match(page, opening) if following == "/" or following.isalpha() else None
        if match is None:
            if following == "/" or (following.isascii() and following.isalpha()):
                closing = page.find(">", opening)
                if following == "/" and closing >= 0:  # </ and no name: a comment
                    at = closing + 1
                    continue
                break  # a tag that never closes
            text("<")
            at = opening + 1
            continue
        at = match.end()
        tag, attributes = match.group(2).lower(), match.group(3)
        if match.group(1):
            if tag in ("html", "body"):
                continue
            if tag == "a" and links:
                links.pop()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag.lstrip("~") == tag:
                    close_to(depth)
                    break
            continue
        if stack[-1].key == "head" and tag not in _HEAD_ONLY:
            stack.pop()
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            if end is None:
                break
            closing = page.find(">", end.end())
            at = size if closing < 0 else closing + 1
            continue
        if tag == "br":
            text(" ")
            continue
        if tag == "html":
            continue
        block = tag in BLOCKS or tag == "hr"
        if tag in VOID and tag != "hr":
            continue
        if not block:
            if attributes.endswith("/"):
                continue
            if tag == "a":
                links.append(len(stack))
            key = "~" + _key(tag, attributes)
            if not any(told_words(name) & ASIDES for name in key.split(" ")[1:]):
                continue
            stack[-1].children.append(Element(key))
            if len(stack) < DEEPEST:
                stack.append(stack[-1].children[-1])
            continue
        while inline(stack[-1].key):
            close_to(len(stack) - 1)
        if stack[-1].tag == "p":
            close_to(len(stack) - 1)
        if tag in _ENDS:
            ended, barred = _ENDS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ended:
                    close_to(depth)
                    break
                if stack[depth].tag in barred:
                    break
        if tag == "body" and any(e.tag == "body" for e in stack):
            continue
        while len(stack) >= DEEPEST:
            close_to(len(stack) - 1)
        element = Element(_key(tag, attributes))
        stack[-1].children.append(element)
        if tag != "hr" and not attributes.endswith("/"):
            stack.append(element)
    return root
