"""Functions against plain Python on random input, all inputs of a test in one DataFrame."""

import json
import math
import posixpath
import random
import re

from pyspark.sql import functions as F

from corpuscope.functions import html, jsontext, numbers, paths

RNG = random.Random(11)


def random_json(depth=0):
    pick = RNG.randrange(8 if depth < 3 else 5)
    if pick == 0:
        return RNG.choice([None, True, False])
    if pick == 1:
        return RNG.randrange(-1000, 1000)
    if pick == 2:
        return RNG.choice([0.5, -2.25, 1e-7, 1e21, 12345.678])
    if pick in (3, 4):
        return "".join(RNG.choice('ab"\\]},:{[ \u00e9\n1') for _ in range(RNG.randrange(6)))
    if pick == 5:
        return [random_json(depth + 1) for _ in range(RNG.randrange(4))]
    return {RNG.choice("abcdef"): random_json(depth + 1) for _ in range(RNG.randrange(4))}


def refuse(constant):
    raise ValueError(constant)


def test_json_validity(values):
    texts = []
    for _ in range(3000):
        text = json.dumps(random_json(), ensure_ascii=RNG.random() < 0.5)
        if RNG.random() < 0.7:
            at = RNG.randrange(len(text) + 1)
            change = RNG.choice(["]", "}", ",", " x", '"', "1", "", "{}", "[", ":", " "])
            text = text[:at] + change + text[at + RNG.randrange(2):]
        texts.append(text)

    def parsed(text):
        try:
            return json.loads(text, parse_constant=refuse)
        except ValueError:
            return "invalid"

    expected = [parsed(t) for t in texts]
    got = values(lambda c: F.to_json(jsontext.parse_json(c)), texts)
    got = ["invalid" if g is None else json.loads(g) for g in got]
    wrong = [(t, e, g) for t, e, g in zip(texts, expected, got) if e != g]
    assert not wrong, wrong[:3]
    assert 500 < expected.count("invalid") < 2500


def test_paths(values):
    items = ["/" * RNG.randrange(2) + "/".join(RNG.choice(["a", "b", "..", ".", "", "c.d"]) for _ in range(6))
             for _ in range(500)]

    def resolved(path):
        stack = []
        for piece in path.split("/"):
            if piece == "..":
                stack = stack[:-1]
            elif piece not in (".", ""):
                stack.append(piece)
        return ("/" if path.startswith("/") else "") + "/".join(stack)

    assert values(paths.normalize_path, items) == [resolved(i) for i in items]
    assert values(paths.base_name, items) == [posixpath.basename(i) for i in items]


def test_rounding_and_number_text(values):
    items = [RNG.uniform(-5, 5) for _ in range(300)] + [n / 2 for n in range(-21, 21)]
    items += [RNG.uniform(-1, 1) * 10.0 ** RNG.randrange(-9, 24) for _ in range(500)]
    halves = [float(math.floor(i) + (i - math.floor(i) >= 0.5)) if abs(i) < 2**52 else i for i in items]
    assert values(numbers.round_half_up, items, "double") == halves
    printed = values(numbers.number_text, items, "double")
    assert [float(p) for p in printed] == items
    for number, text in zip(items, printed):
        size = abs(number)
        plain = number == 0 or 1e-6 <= size < 1e21
        assert ("e" not in text) == plain, (number, text)
        assert not re.search(r"\.0*$", text), (number, text)


TAGS = ["<a href='/x'>", '<A class="k" href="/y" >', "<a>", "</a>", '<img src="i.png"/>', "<IMG alt='' src='j'>",
        "<script>var a;</script>", "<script>\nx</script>", "<style >p</style>", "<p>", "</p>", "<title>T </title>",
        "<title></title>", "word", " ", "\n", "\t", " ", "&amp;", "<", ">", '"', "<abbr href='/z'>"]
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def test_html(values):
    pages = ["".join(RNG.choice(TAGS) for _ in range(25)) for _ in range(400)]
    line = "[^\n\r\u2028\u2029]"

    def text(page):
        page = re.sub(rf"<script[^>]*>{line}*?</script>", "", page, flags=re.I)
        page = re.sub(rf"<style[^>]*>{line}*?</style>", "", page, flags=re.I)
        page = re.sub("<[^>]+>", " ", page)
        return re.sub(f"[{SPACES}]+", " ", page).strip(SPACES)

    def title(page):
        found = re.search("<title[^>]*>([^<]+)</title>", page, re.I)
        return found.group(1).strip(SPACES) if found else ""

    link = re.compile("""<a[^>]+href=["']([^"']+)["'][^>]*>""", re.I)
    image = re.compile("""<img[^>]+src=["']([^"']+)["'][^>]*>""", re.I)
    assert values(html.html_text, pages) == [text(p) for p in pages]
    assert values(html.html_title, pages) == [title(p) for p in pages]
    assert values(html.html_links, pages) == [link.findall(p) for p in pages]
    assert values(html.html_images, pages) == [image.findall(p) for p in pages]
    grouped = re.compile("<(p|img)?[^>]*>", re.I)
    expected = [[m.group(1) or m.group(0) for m in grouped.finditer(p)] for p in pages]
    assert values(lambda c: html.html_pattern(c, "<(p|img)?[^>]*>"), pages) == expected
