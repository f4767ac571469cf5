import numpy as np
import pytest

from corpuscope.llm.embeddings import linked_pairs, near_vectors, quantised


def brute(rows, threshold):
    usable = []
    for vec, values, label in rows:
        ok = label is not None and values is not None and len(values) and None not in values
        if ok and np.isfinite(values).all() and np.any(values):
            array = np.array(values, dtype=np.float32).astype(float)
            usable.append((vec, label, array))
    links = {i: [] for i in range(len(usable))}
    for i, (_, label, a) in enumerate(usable):
        for j, (_, other, b) in enumerate(usable):
            if i != j and label == other and len(a) == len(b):
                scaled = (a / np.abs(a).max()) @ (b / np.abs(b).max())
                cosine = scaled / np.linalg.norm(a / np.abs(a).max()) / np.linalg.norm(b / np.abs(b).max())
                if cosine >= threshold:
                    links[i].append(j)
    out = []
    for i, (vec, _, _) in enumerate(usable):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(usable[j][0] for j in seen)
        out.append((vec, len(links[i]), least, vec == least))
    known = {id(u) for u in usable}
    del known
    skipped = [r for r in rows if not any(r[0] == u[0] for u in usable)]
    return out + [(vec, 0, vec, True) for vec, _, _ in skipped]


@pytest.fixture
def vectors(llm):
    def make(rows):
        return llm.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
            "*", "1 AS id", "2 AS links", "3 AS block", "4 AS body"
        )

    return make


def _rows():
    random = np.random.default_rng(4)
    rows = []
    for i in range(240):
        base = random.standard_normal(16) if i % 6 == 0 else base + 0.08 * random.standard_normal(16)
        rows.append((i * 2, base.tolist(), i // 80))
    same = rows[10][1]
    rows += [(1001 + i, same, rows[10][2]) for i in range(30)] + [(1100, same, 2), (1101, same, None)]
    rows += [(1200, None, 1), (1201, [], 1), (1202, [0.0] * 16, 1), (1203, [float("nan")] * 16, 1)]
    rows += [(1204, [1.0] * 15 + [None], 1), (1205, same[:8], 0), (1206, [1e30 * x for x in same], 0)]
    rows += [(1207, [1e-30 * x for x in same], 0), (1208, [float("inf")] * 16, 0)]
    return rows


def test_against_brute_force(vectors):
    rows = _rows()
    want = sorted(map(str, brute(rows, 0.98)))
    for block in (256, 7):
        got = near_vectors(vectors(rows), 0.98, block=block).collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_rows_without_an_id_and_with_the_same_id(vectors):
    random = np.random.default_rng(6)
    a, b = random.standard_normal(8), random.standard_normal(8)
    near = (a + 0.01 * random.standard_normal(8)).tolist()
    a, b, big = a.tolist(), b.tolist(), 2**53
    cases = [
        # ids that doubles cannot tell apart, beside a null
        (
            [(None, a, 0), (big + 1, near, 0), (big + 3, b, 0)],
            [(None, 1, big + 1, False), (big + 1, 1, big + 1, True), (big + 3, 0, big + 3, True)],
        ),
        # one id in two labels
        ([(1, a, 0), (1, b, 1), (2, near, 0)], [(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False)]),
        # one id twice in a label, linked and not
        ([(1, a, 0), (1, near, 0), (1, b, 0)], [(1, 1, 1, True), (1, 1, 1, True), (1, 0, 1, True)]),
        # no ids at all, equal and near
        ([(None, a, 0), (None, a, 0), (None, near, 0), (None, b, None)], [(None, 2, None, True)] * 3 + [(None, 0, None, True)]),
        # the least id of a group need not be that of its first class
        ([(9, a, 0), (3, near, 0), (5, a, 0)], [(9, 2, 3, False), (3, 2, 3, True), (5, 2, 3, False)]),
    ]
    for rows, want in cases:
        for block in (256, 1):
            got = near_vectors(vectors(rows), 0.98, block=block).collect()
            assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))


def test_no_vectors(vectors):
    assert near_vectors(vectors([])).collect() == []
    assert near_vectors(vectors([(1, None, 1)])).collect()[0].kept


def test_bounds_hold_and_save_products():
    random = np.random.default_rng(5)
    left = random.standard_normal((300, 64))
    right = left + 0.02 * random.standard_normal((300, 64))
    a, b, exact = linked_pairs(left, right, 0.98)
    cosine = (left @ right.T) / np.linalg.norm(left, axis=1)[:, None] / np.linalg.norm(right, axis=1)[None]
    assert sorted(zip(a, b, strict=True)) == sorted(zip(*np.nonzero(cosine >= 0.98), strict=True))
    assert len(a) <= exact < 1000
    unit = left / np.linalg.norm(left, axis=1, keepdims=True)
    whole, scale, error = quantised(unit)
    assert (np.linalg.norm(unit - whole * scale[:, None], axis=1) <= error + 1e-12).all()
