import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpuscope.llm.langid import _losses, code_matrix, fit_languages, identify
from corpuscope.llm.learning import bounded_sample, held_out, logistic
from corpuscope.llm.quality import _learned_rows, _pair_parts, fit_quality, score_quality


def test_codewords_differ():
    for n in [*range(2, 12), 40, 300]:
        codes = code_matrix(n)
        assert len({tuple(row) for row in codes}) == n
        assert (np.abs(codes.sum(axis=0)) < n).all()


def test_languages_are_told_apart(documents, sentence):
    rows = [(i, sentence(i, 40, lang), lang, "s") for i in range(150) for lang in [("en", "fr", "de")[i % 3]]]
    model = fit_languages(documents(rows))
    assert model.languages == ["de", "en", "fr"]
    cases = [(i, sentence(1000 + i, 12, lang), lang, None) for i in range(30) for lang in [("en", "fr", "de")[i % 3]]]
    cases += [(900, None, "en", None), (901, "", None, None), (902, "12 !? ...", None, None), (None, sentence(7, 30), "en", None)]
    cases += [(903, "漢字", None, None), (904, sentence("long", 50000, "fr"), "fr", None), (905, "x", None, None)]
    got = {r.doc_id: r for r in identify(documents(cases), model, extra=("lang", "size")).select("doc_id", "lang_pred", "lang", "ambiguous").collect()}
    right = [got[i].lang_pred == got[i].lang for i in range(30)]
    assert sum(right) >= 28 and got[904].lang_pred == "fr" and got[None].lang_pred == "en"
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert got[903].lang_pred in model.languages


def test_nothing_to_learn_from(documents):
    model = fit_languages(documents([(1, "text", None, None)]))
    assert [r.lang_pred for r in identify(documents([(1, "text")]), model).collect()] == ["und"]
    one = fit_languages(documents([(i, "only this", "en", None) for i in range(20)]))
    assert {r.lang_pred for r in identify(documents([(1, "text")]), one).collect()} == {"en"}
    assert identify(documents([]), model).collect() == []


def test_held_out_rows_teach_nothing(documents, sentence):
    rows = [(i, sentence(i, 30, lang), lang, None) for i in range(60) for lang in [("en", "fr")[i % 2]]]
    out = {r.doc_id for r in documents(rows).filter(held_out(F.col("doc_id"))).collect()}
    changed = [(d, "zzz qqq", "xx", None) if d in out else (d, t, lang, s) for d, t, lang, s in rows]
    a, b = fit_languages(documents(rows)), fit_languages(documents(changed))
    assert a.languages == b.languages and np.allclose(a.weights, b.weights)


def _labelled(llm, documents, sentence):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = sentence(i, 50)
        rows.append((i, " ".join(w + "$$$" for w in text.split()) if bad else text))
        labels.append((i, 0 if bad else 1))
    labels += [(401, None), (None, 1), (0, 0)]
    return documents(rows), llm.createDataFrame(labels, "doc_id long, quality int")


def test_bad_documents_score_low(llm, documents, sentence):
    docs, labels = _labelled(llm, documents, sentence)
    model = fit_quality(docs, labels)
    got = {r.doc_id: r for r in score_quality(docs, model).collect()}
    assert all(got[i].predicted == (i % 4 != 0) for i in range(400))
    assert min(got[i].score for i in range(400) if i % 4) > max(got[i].score for i in range(0, 400, 4))
    odd = documents([(1, None), (2, ""), (None, "a b"), (3, sentence("x", 40000)), (3, "same"), (3, "same")])
    scores = [r.score for r in score_quality(odd, model).collect()]
    assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)


def test_all_labelled_documents_teach(llm, documents):
    """9,000 rows, of which the last 300 alone show what a bad one looks like."""
    ids = [i for i in range(12000) if zlib.crc32(str(i).encode()) % 5][:9000]
    rows = [(i, f"plain words {i} and more" if k < 8700 else f"{i} $$$ ### $$$ {i}") for k, i in enumerate(ids)]
    labels = llm.createDataFrame([(i, int(k < 8700)) for k, i in enumerate(ids)], "doc_id long, quality int")
    found = _learned_rows(documents(rows), labels)
    assert found.count() == 9000 and found.filter("not good").count() == 300
    model = fit_quality(documents(rows), labels)
    scores = score_quality(documents(rows), model)
    assert scores.filter("predicted = 0").count() == 300
    again = fit_quality(documents(rows[::-1]), labels)
    assert np.allclose(model.weights, again.weights, atol=1e-4) and math.isclose(model.cut, again.cut, abs_tol=1e-3)


def test_pairs_against_plain_python():
    pick = np.random.default_rng(4)
    x, good, weights = pick.normal(size=(9, 3)), np.arange(9) % 3 == 0, pick.normal(size=3)
    found = _pair_parts(weights, x, good, (x[good].mean(axis=0), x[~good].mean(axis=0)))
    pairs = [a - b for a in x[good] for b in x[~good]]
    chance = [1 / (1 + math.exp(d @ weights)) for d in pairs]
    assert found[0] == 18 and np.isclose(found[1], sum(math.log1p(math.exp(-(d @ weights))) for d in pairs))
    assert np.allclose(found[2:5], sum(-c * d for c, d in zip(chance, pairs, strict=True)))
    assert np.allclose(found[5:].reshape(3, 3), sum(c * (1 - c) * np.outer(d, d) for c, d in zip(chance, pairs, strict=True)))
    # a group of one class meets the other's mean
    alone = _pair_parts(weights, x[good], good[good], (x[0], x[1]))
    assert alone[0] == 3 and alone[1] > 0


def test_one_class_only(llm, documents):
    labels = llm.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    docs = documents([(i, f"text {i}") for i in range(20)])
    assert fit_quality(docs, labels) is None
    assert {(r.score, r.predicted) for r in score_quality(docs, None).collect()} == {(0.5, 1)}
    assert fit_quality(docs.limit(0), labels.limit(0)) is None


def test_the_sample_is_bounded(documents, sentence):
    rows = [(7, f"text {i}", "en", None) for i in range(3000)] + [(8, "same", "fr", None)] * 3000
    rows += [(i + 100, sentence(i, 3, "de"), "de", None) for i in range(500)]
    docs = documents(rows)
    for even in (True, False):
        sample = bounded_sample(docs, "lang", ("doc_id", "text"), 90, even).collect()
        counts = Counter(r.lang for r in sample)
        assert len(sample) <= 90 and len({(r.doc_id, r.text) for r in sample}) == len(sample)
        if even:
            assert counts == {"en": 30, "fr": 1, "de": 30}
        again = bounded_sample(docs.repartition(3), "lang", ("doc_id", "text"), 90, even).collect()
        assert {(r.doc_id, r.text) for r in again} == {(r.doc_id, r.text) for r in sample}
    assert bounded_sample(docs.limit(0), "lang", ("doc_id", "text"), 9, True).collect() == []


def test_many_languages(documents):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q word{i}" * 3, f"l{i:04}", None) for i in range(700)]
    model = fit_languages(documents(rows))
    assert len(model.languages) > 500
    assert all(r.lang_pred in model.languages for r in identify(documents(rows[:50]), model).collect())


def test_decoding_against_plain_python():
    random = np.random.default_rng(3)
    margins, codes = random.normal(size=(40, 7)) * 9, random.choice((-1.0, 1.0), (12, 7))
    plain = [[sum(math.log1p(math.exp(-m * c)) for m, c in zip(row, code, strict=True)) for code in codes] for row in margins]
    assert np.allclose(_losses(margins, codes), plain)


def test_ranking_against_plain_python():
    """The logistic loss on feature differences, minimised by plain gradient descent."""
    pick = random.Random(1)
    x = [[pick.gauss(0, 1) for _ in range(3)] for _ in range(40)]
    pairs = [(a, b) if a[0] - a[1] > b[0] - b[1] else (b, a) for a, b in itertools.combinations(x, 2)][:200]
    differences = [[p - q for p, q in zip(a, b, strict=True)] for a, b in pairs]
    weights = [0.0] * 3
    for _ in range(3000):
        gradient = [0.1 * w for w in weights]
        for d in differences:
            chance = 1 / (1 + math.exp(sum(w * v for w, v in zip(weights, d, strict=True))))
            gradient = [g - chance * v / len(differences) for g, v in zip(gradient, d, strict=True)]
        weights = [w - 0.3 * g for w, g in zip(weights, gradient, strict=True)]
    found = logistic(np.array(differences), np.ones((len(differences), 1)), 0.1, 300)[:, 0]
    assert np.allclose(found, weights, atol=1e-3)
