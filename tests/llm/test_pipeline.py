import hashlib
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpuscope.llm.queries import ORACLES, QUERIES
from tests.llm.test_jaccard import brute as brute_groups
from tests.llm.test_suffix_dedup import brute as brute_cuts

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_stages_of_a_small_corpus(llm, documents, sentence, tmp_path):
    passage = sentence("passage", 60)
    rows = [(i, sentence(i, 40, lang), lang, f"s{i % 3}") for i in range(90) for lang in [("en", "fr", "de")[i % 3]]]
    rows += [(200 + i, rows[i][1] + " more", rows[i][2], "s1") for i in range(10)]
    rows += [(300 + i, f"{sentence(i, 25, 'fr')} {passage} {sentence(-i, 25, 'fr')}", None, None) for i in range(6)]
    rows += [(400, None, "en", "s0"), (401, "", "en", None), (402, "123 456 ...", None, "s0"), (0, rows[0][1], "en", "s0")]
    pd.DataFrame({"doc_id": [1, 2], "quality": [1, 0], "toxic": [0, 0]}).to_parquet(tmp_path / "labels.parquet")
    docs = documents(rows)

    kept = corpus_pipeline.language(llm, docs, str(tmp_path))
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    ids = Counter(r.doc_id for r in kept.collect())
    assert not {400, 401, 402} & set(ids) and len(ids) == len({r[0] for r in rows}) - 3

    kept = corpus_pipeline.stored(kept, "kept")
    before = [(r.doc_id, r.text) for r in kept.collect()]
    kept = corpus_pipeline.stored(corpus_pipeline.near_copies(llm, kept, str(tmp_path)), "kept")
    want = {d for d, _, c in brute_groups(before, corpus_pipeline.Join(5, 80, 100)) if d == c}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)

    before = [(r.doc_id, r.text) for r in kept.collect()]
    cut = corpus_pipeline.stored(corpus_pipeline.repeated_passages(llm, kept, str(tmp_path)), "cut")
    want_cut = {d: sha for d, _, _, _, sha in brute_cuts(before, 200)}
    got_cut = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in cut.collect()}
    assert got_cut == want_cut and all(r.n_chars == len(r.text) for r in cut.collect())
    assert all(passage not in r.text for r in cut.collect())

    mixed = corpus_pipeline.stored(corpus_pipeline.mixed_sources(llm, cut, str(tmp_path)), "mixed")
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 3 and set(copies) <= set(want_cut)
    assert mixed.columns == list(corpus_pipeline.COLUMNS)

    encoded = corpus_pipeline.tokens(llm, mixed, str(tmp_path)).collect()
    library = Tokenizer.from_file(__import__("public_tokenizers").path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert Counter(r.doc_id for r in encoded) == copies
    for r in encoded:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_near_copies_of_rows_that_repeat_an_id_or_have_none(llm, documents, sentence, tmp_path):
    a, b, c, d, e = (sentence(f"near{i}", 60) for i in range(5))
    rows = [(1, a), (1, b), (1, b), (2, f"{b} more"), (3, f"{a} more"), (None, c), (None, f"{c} more"), (4, d)]
    rows += [(None, f"{d} more"), (5, e), (5, f"{e} more"), (None, None), (6, ""), (6, " ")]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(llm, documents(rows), str(tmp_path)).collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= set(rows)
    assert {(1, a), (1, b), (4, d), (None, None), (6, ""), (6, " ")} <= set(kept)
    rest = [(i, t.removesuffix(" more")) for i, t in set(kept) - {(1, a), (1, b), (4, d), (None, None), (6, ""), (6, " ")}]
    assert sorted(rest, key=str) == sorted([(None, c), (5, e)], key=str)


def test_empty_table(llm, documents, tmp_path):
    pd.DataFrame({"doc_id": [1], "quality": [1], "toxic": [0]}).to_parquet(tmp_path / "labels.parquet")
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(llm, docs, str(tmp_path))
        assert docs.collect() == []


def test_run_writes_and_reads_every_stage(llm):
    result = QUERIES["pipeline"](llm, DATA)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and result.count() > 100


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(llm, name):
    tables = duckdb.connect()
    for file in os.listdir(DATA):
        tables.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    got = QUERIES[name](llm, DATA)
    want = tables.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got.select(columns)) == sorted(map(str, want.select(*(f'"{c}"' for c in columns)).fetchall()))


def test_every_operator_is_registered():
    numbers = {int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in QUERIES
