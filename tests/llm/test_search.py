import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpuscope.llm import search as module
from corpuscope.llm.search import Queries, build_index, search, term_counts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    counted = [(d, Counter(terms(t))) for d, t, *_ in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    found = []
    for item, text in items:
        scores = []
        asked = Counter(terms(text))
        weight = {}
        for t in asked:
            df = sum(t in c for _, c in counted)
            weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        for doc, c in counted:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // length
            score = sum(r * weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in asked.items() if c[t])
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scores, key=lambda s: s[:3])[:top], 1):
            found.append((item, rank, doc, -score))
    return sorted(found, key=repr)


def rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture
def items(llm):
    return lambda pairs: llm.createDataFrame(pairs, "item_id long, text string").selectExpr("*", "'x' AS doc_id", "1 AS score")


def made(sentence):
    pick = random.Random(3)
    docs = [(i, sentence(i, pick.choice([1, 5, 30, 200])), "en", None) for i in range(150)]
    docs += [(None, "alpha beta"), (None, "alpha beta"), (7, "alpha Été beta"), (7, "ALPHA été beta"), (200, None), (201, ""), (202, " .,!"), (203, "a" * 5000)]
    docs += [(300 + i, "alpha beta gamma") for i in range(40)]  # ties beyond the limit
    docs += [(400, sentence(400, 300_000)), (401, "the " * 70_000 + "alpha")]
    return docs


def test_search_finds_what_brute_force_finds(documents, items, sentence):
    docs = made(sentence)
    asked = [(1, sentence(5, 30)), (2, "alpha beta beta"), (2, "gamma, ÉTÉ été"), (3, None), (4, ""), (5, "unseen"), (6, "a" * 5000), (None, "the of the")]
    assert rows(search(documents(docs), items(asked))) == brute(docs, asked)


def test_groups_of_queries_and_blocks_change_nothing(documents, items, sentence, monkeypatch):
    monkeypatch.setattr(module, "ASKED", 2)
    docs = [(i, sentence(i, 20)) for i in range(60)]
    asked = [(i, sentence(i, 8)) for i in range(5)]
    assert rows(search(documents(docs), items(asked), top=3)) == brute(docs, asked, top=3)


def test_empty_tables(documents, items, sentence):
    assert rows(search(documents([]), items([(1, "alpha")]))) == []
    assert rows(search(documents([(1, "alpha")]), items([]))) == []
    assert rows(search(documents([(1, None), (2, "")]), items([(1, "alpha")]))) == []


def test_most_documents_are_excluded_by_their_bounds(documents, sentence):
    docs = [(i, " ".join(f"w{random.Random(i * 50 + j).randrange(4000)}" for j in range(50))) for i in range(800)]
    counted = [term_counts(t.encode()) for _, t in docs]
    asked = term_counts(docs[17][1].encode())
    weights = {t: math.floor(1000 * math.log(1602 / (2 * sum(t in c for c in counted) + 1))) for t in asked}
    queries = Queries([1], [asked], weights, 800, sum(sum(c.values()) for c in counted))
    scores = np.array([queries.score(c, 0) for c in counted])
    bounds = {}
    for row in build_index(documents(docs)).collect():
        sizes = np.frombuffer(row.sizes, "<i8")
        for _, bound in module._Bounds(queries).of(row.width, sizes, row.slices):
            bounds |= dict(zip(np.frombuffer(row.keys, "<i8").tolist(), bound.tolist(), strict=True))
    keys = {r.doc_id: r.k for r in documents(docs).select("doc_id", module.row_key().alias("k")).collect()}
    bound = np.array([bounds[keys[i]] for i, _ in docs])
    assert (bound >= scores).all()
    assert (bound >= scores[17]).sum() < 5  # the document that was asked for, and hardly another


def test_terms_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choice(["Ab", "é9", "-", "xyz" * 9]) for _ in range(500)).encode()
    whole = term_counts(text)
    monkeypatch.setattr(module, "_PIECE", 7)
    assert term_counts(text) == whole
