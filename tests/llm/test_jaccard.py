import random
import re

import pytest

from corpuscope.llm.components import components
from corpuscope.llm.jaccard import Join, _global_order, _Texts, similar_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, join):
    sets = [(d, shingles(t, join.words)) for d, t in rows]
    least = {d: d for d, _ in sets if d is not None}

    def find(d):
        while least[d] != d:
            d = least[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y:
                both = len(x & y)
                if join.under * both >= join.over * (len(x) + len(y) - both):
                    low, high = sorted((find(a), find(b)))
                    least[high] = low
    return [(d, len(s), None if d is None else find(d)) for d, s in sets]


def edited(text, seed, changes):
    pick, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[pick.randrange(len(words))] = f"w{pick.randrange(10**6)}"
    return " ".join(words)


def _rows(sentence):
    bases = [sentence(f"b{i}", 60 + 10 * i) for i in range(6)]
    rows = [(i, edited(bases[i % 6], i, i % 5)) for i in range(90)]
    common = sentence("c", 30)
    rows += [(200 + i, f"{common} {sentence(i, 25)}") for i in range(40)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "One two"), (304, "one TWO"), (305, "É two"), (306, "é two")]
    rows += [(400 + i, bases[0]) for i in range(25)] + [(500, bases[1]), (500, bases[1]), (None, bases[1])]
    rows += [(600, sentence("long", 8000)), (601, edited(sentence("long", 8000), 1, 100))]
    # a chain: each close to the next, the ends far apart
    words = [f"c{i}" for i in range(80)]
    rows += [(700 + i, " ".join(words[i * 2 : i * 2 + 60])) for i in range(8)]
    return rows


@pytest.mark.parametrize("join", [Join(4, 85, 100), Join(5, 80, 100), Join(2, 1, 2)])
def test_against_brute_force(documents, sentence, join):
    rows = _rows(sentence)
    got = similar_sets(documents(rows), join).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, brute(rows, join)))


def test_long_lists_are_cut_into_blocks(documents, sentence, monkeypatch):
    from corpuscope.llm import jaccard

    monkeypatch.setattr(jaccard, "LONG_LIST", 4)
    monkeypatch.setattr(jaccard, "BAND", 2)
    rows = _rows(sentence)
    got = similar_sets(documents(rows), Join(4, 7, 10)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, brute(rows, Join(4, 7, 10))))


def test_followers_cut_at_the_ends_link_groups(documents):
    """Two texts of one body with other endings, too far apart, and copies of both without some words at the ends."""
    families = {
        3: [(1, 2, 3), (0, 2, 0), (1, 1, 1), (0, 0, 0), (1, 2, 0), (1, 0, 0)],
        23: [(1, 2, 0), (0, 3, 1), (0, 0, 0), (1, 0, 0), (1, 0, 3), (1, 1, 3)],
        26: [(0, 0, 0), (1, 0, 0), (0, 0, 2), (1, 3, 0), (1, 3, 3), (1, 1, 0)],
        73: [(0, 0, 0), (0, 2, 1), (1, 1, 2), (1, 0, 0)],
        96: [(0, 3, 0), (0, 0, 0), (1, 3, 3), (1, 0, 0), (1, 3, 0), (1, 0, 1)],
    }
    rows = []
    for f, copies in families.items():
        whole = [[f"f{f}b{i}" for i in range(131)] + [f"f{f}t{t}_{i}" for i in range(12)] for t in (0, 1)]
        rows += [(10 * f + i + 1, " ".join(whole[t][a : 143 - b])) for i, (t, a, b) in enumerate(copies)]
    want = brute(rows, Join(4, 85, 100))
    assert {c for _, _, c in want} == {10 * f + 1 for f in families}
    got = similar_sets(documents(rows), Join(4, 85, 100)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_table(documents):
    assert similar_sets(documents([])).collect() == []


def test_components_of_a_path_and_a_star(llm):
    path = [(i, i + 1) for i in range(1, 300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = llm.createDataFrame([*path, *star, (5, 5), (1001, 1000)], "a long, b long").repartition(7)
    got = {r.id: r.component_id for r in components(edges).collect()}
    assert got == {i: 1 for i in range(2, 301)} | {1000 + i: 1000 for i in range(1, 200)}
    assert components(edges.limit(0)).collect() == []


def test_long_words_that_sums_of_powers_confuse(documents):
    """Thue-Morse words agree in every polynomial hash modulo a power of two."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"{word} x"), (4, f"{other} x"), (5, word)]
    got = {r.doc_id: r.component_id for r in similar_sets(documents(rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_what_is_gathered_takes_no_job_for_each_partition(llm, documents, sentence):
    """The order of cells and the filter of ids, with many shuffle partitions."""
    parts, context = llm.conf.get("spark.sql.shuffle.partitions"), llm.sparkContext
    docs = documents([(i, sentence(i, 20)) for i in range(10)]).select("doc_id", "text")
    llm.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        context.setJobGroup("gathered", "")
        places = _global_order(docs.select("text"), 4)
        asked = _Texts(docs, Join(), places)._asked(docs.filter("doc_id < 3").select(docs.doc_id.alias("id")))
        context.setLocalProperty("spark.jobGroup.id", None)
        assert len(context.statusTracker().getJobIdsForGroup("gathered")) <= 8
        assert sorted(row.doc_id for row in asked.collect()) == [0, 1, 2]
    finally:
        llm.conf.set("spark.sql.shuffle.partitions", parts)
