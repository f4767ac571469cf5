import hashlib

import numpy as np

from corpuscope.llm.fingerprints import compare_versions, differing, likeness, paragraph_digests, peel, sketch


def digests(text):
    return set(paragraph_digests([text.encode()])[0].tolist())


def alike(a, b):
    a, b = digests(a), digests(b)
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), alike(text, edited), alike(text, following)))
    return out


def test_against_brute_force(documents, sentence):
    rows = [(i * 3, sentence(i, i % 60)) for i in range(120)]
    rows += [(1000, None), (1001, ""), (None, "nul ids first"), (1002, sentence("l", 30000)), (1003, rows[50][1]), (1004, rows[50][1])]
    rows += [(2000, "same row again"), (2000, "same row again"), (2001, "é" * 33 + "\n\n\0" + "漢" * 700)]
    for part in (rows, rows[:1], [(1, None)], []):
        got = compare_versions(documents(part)).collect()
        shown = sorted(str((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next)) for r in got)
        assert shown == sorted(map(str, brute(part)))


def test_equal_texts_have_equal_fingerprints(documents, sentence):
    texts = [sentence(i % 7, 40) for i in range(30)]
    got = compare_versions(documents(list(enumerate(texts)))).collect()
    by_text = {(texts[r.doc_id], r.fingerprint) for r in got}
    assert len(by_text) == 7 and len({f for _, f in by_text}) == 7


def test_peeling_recovers_the_difference():
    random = np.random.default_rng(2)
    common = random.integers(0, 2**63, 500).astype(np.uint64)
    a, b = random.integers(0, 2**63, (2, 6)).astype(np.uint64)
    left, right = np.concatenate([common, a]), np.concatenate([common, b])
    zeros = np.zeros(506, dtype=np.int64)
    rows, found, signs, whole = peel(sketch(left, zeros, 1, 60) - sketch(right, zeros, 1, 60))
    assert whole.all() and set(found[signs > 0]) == set(a) and set(found[signs < 0]) == set(b)


def test_too_small_sketches_are_made_larger():
    random = np.random.default_rng(3)
    left, right = random.integers(0, 2**63, (2, 900)).astype(np.uint64)
    zeros = np.zeros(900, dtype=np.int64)
    first = sketch(left, zeros, 1, 24) - sketch(right, zeros, 1, 24)
    assert not peel(first)[3].any()
    assert differing((left, zeros), (right, zeros), first)[0] == 1800


def test_likeness_of_nothing():
    assert likeness(np.array([0, 5]), np.array([0, 5]), np.array([0, 0])).tolist() == [1.0, 0.0]


def test_digests_do_not_depend_on_neighbours(sentence):
    texts = [sentence(i, 20).encode() for i in range(20)] + [b"", b"\n\n", b"a"]
    together, rows = paragraph_digests(texts)
    for i, text in enumerate(texts):
        assert sorted(together[rows == i]) == sorted(paragraph_digests([text])[0])
