import hashlib
import random
from collections import Counter

from corpuscope.llm.runindex import build, matching_statistics
from corpuscope.llm.suffix_dedup import repeated_bytes
from corpuscope.llm.textbytes import Stretches


def brute(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for (doc, _), text in zip(rows, texts, strict=True):
        covered = [False] * len(text)
        for i in range(len(text) - window + 1):
            if seen[text[i : i + window]] > 1:
                covered[i : i + window] = [True] * window
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        kept = bytes(b for b, c in zip(text, covered, strict=True) if not c)
        out.append((doc, len(text), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_matching_statistics_against_all_pairs():
    pick = random.Random(3)
    base = bytes(pick.choice(b"ab\0") for _ in range(40))
    for _ in range(60):
        pieces = [base[a : a + pick.randint(0, 14)] for a in (pick.randint(0, 30) for _ in range(pick.randint(1, 6)))]
        index, starts = build(pieces)
        found = matching_statistics(index)
        places = [(i, j) for i, p in enumerate(pieces) for j in range(len(p))]

        def common(a, b):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n

        for i, j in places:
            others = [common(pieces[i][j:], pieces[k][m:]) for k, m in places if (k, m) != (i, j)]
            assert found[starts[i] + j] == max(others, default=0)


def test_runs_are_fewer_than_bytes_in_repetitive_text():
    index, _ = build([b"the same passage again, " * 8 + bytes([65 + i]) for i in range(40)])
    assert len(index.heads) < index.length / 10
    assert index.run_lengths.sum() == index.length


def _corpus(sentence):
    passage = sentence("p", 60)
    short = sentence("s", 20)[:95]
    rows = [(i, f"{sentence(i, 30)} {short} {passage if i % 3 else ''}\n{sentence(-i, 20)}") for i in range(40)]
    rows += [(100, rows[1][1]), (100, rows[1][1]), (101, None), (102, ""), (None, rows[2][1]), (103, "ab" * 300)]
    rows += [(104, "é" * 150), (105, "xé" + "é" * 150), (106, "tiny"), (107, sentence("long", 4000) + passage)]
    return rows


def test_against_brute_force(documents, sentence):
    rows = _corpus(sentence)
    want = sorted(map(str, brute(rows, 60)))
    for crowd in (1024, 3):  # with few passages to an anchor, its windows are counted instead
        got = repeated_bytes(documents(rows), 60, 30, most_passages=crowd).collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_text_and_extra_columns(documents, sentence):
    rows = [(1, "é" + "ü" * 40 + "ab", "de", "s"), (2, "ü" * 40 + "cd", None, "t"), (3, None, "x", None)]
    got = {r.doc_id: r for r in repeated_bytes(documents(rows), 60, 30, with_text=True, extra=("lang", "size")).collect()}
    assert got[1].text == "éab" and got[1].lang == "de" and got[1].size == "x"
    assert got[2].text == "cd" and got[3].text == "" and got[3].lang == "x"


def test_empty_table(documents):
    assert repeated_bytes(documents([])).collect() == []


def _passages(seed, n):
    pick = random.Random(seed)
    common = bytes(pick.choice(b"abcdefgh \0") for _ in range(120))
    tails = [bytes(pick.choice(b"abcdefgh ") for _ in range(pick.randint(0, 90))) for _ in range(6)]
    return [pick.choice(tails) + common[pick.randint(0, 30) :] + pick.choice(tails) for _ in range(n)] + [b"", b"a", b"a"]


def test_samples_at_run_ends_are_what_neighbours_share():
    for seed in range(20):
        pieces = _passages(seed, 8)
        index, starts = build(pieces)
        text = b"".join(p + b"\0" for p in pieces)
        ends = {at: int(starts[i + 1]) - 1 for i in range(len(pieces)) for at in range(starts[i], starts[i + 1])}

        def common(a, b):
            return next((k for k in range(len(text)) if a + k >= ends[a] or b + k >= ends[b] or text[a + k] != text[b + k]), 0)

        pairs = list(zip(index.tails[:-1], index.heads[1:], strict=True))
        want = [common(int(a), int(b)) for a, b in pairs]
        assert index.head_lcp.tolist() == [0, *want] and index.tail_lcp.tolist() == [*want, 0]


def test_few_stretches_are_hashed_to_build_an_index(monkeypatch):
    hashed = []

    def counted(name):
        work = getattr(Stretches, name, None)
        monkeypatch.setattr(Stretches, name, lambda self, a, *rest: hashed.append(len(a)) or work(self, a, *rest), raising=False)

    counted("hashes")
    counted("same")
    index, _ = build(_passages(1, 200))
    # a bisection from nothing for both ends of each run would take more than twenty times as many stretches as runs
    assert 0 < sum(hashed) < 4 * len(index.heads)
