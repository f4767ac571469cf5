import hashlib
import itertools
import random
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpuscope.llm.bpe import TrieBpe, WordCodes, _encoded, encode
from corpuscope.llm.pfor import Segment, write_segment
from corpuscope.llm.pretokens import WORDS
from corpuscope.llm.token_files import LibraryWords, _segments, read_token_files, write_token_files
from corpuscope.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
CHARS = "abcdefgzZÀéßÿ×÷'sSTt1234!$.,-<|>\x1c\x85\xa0 \n\t́İΣσ漢字ﬁ😀à\x00_Ñ​½²٣"
AWKWARD = [(3, "It's <|endoftext|>5 o'clock\x1cÉß"), (1, None), (2, ""), (2, ""), (None, " \n "), (9, "tie"), (9, "tie")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_codes_against_the_library(library):
    codes, pick = WordCodes(PATH), random.Random(5)
    for _ in range(1500):
        text = "".join(pick.choice(CHARS) for _ in range(pick.randint(0, 14)))
        if pick.random() < 0.2:
            text = text[:5] + pick.choice(["<|endoftext|>", "<|startoftext|>"]) + text[5:]
        words = WORDS.findall(text)
        codes.learn(set(words))
        ids = codes.encode(words)
        want = library.encode(text, add_special_tokens=False).ids
        assert list(map(int, ids.split())) == want, text
        assert codes.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_shared_prefixes_are_worked_out_once(monkeypatch):
    bpe, calls = TrieBpe(PATH), []
    step = TrieBpe._last
    monkeypatch.setattr(TrieBpe, "_last", lambda self, w, n, *a: calls.append((w, n)) or step(self, w, n, *a))
    list(bpe.encode({"international", "internationale", "internationally"}))
    assert len(calls) <= 19  # 15 letters at most, and the ends; far below 13 + 14 + 15


def test_operator_against_the_library(documents, library, sentence):
    rows = [*AWKWARD, (50, sentence("long", 20000)), *((100 + i, sentence(i, 20, "fr")) for i in range(30))]
    got = sorted(str(tuple(r)) for r in encode(documents(rows)).collect())
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        shown = " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
        want.append(str((doc, len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in shown))))
    assert got == sorted(want)
    assert encode(documents([])).collect() == []


def test_ids_column(documents, library):
    row = encode(documents([(1, "Hello there, world")]), with_ids=True).first()
    assert row.ids == library.encode("Hello there, world", add_special_tokens=False).ids
    assert row.decoded == library.decode(row.ids, skip_special_tokens=False)


def test_segments_round_trip():
    random_ = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 1000):
        for top in (1, 50, 49408, 2**32):
            ids = random_.integers(0, top, n).astype(np.uint32)
            ids[random_.random(n) < 0.05] = top - 1
            segment = Segment(write_segment([7, None], [n // 3, n - n // 3], ids))
            assert (segment.ids() == ids).all() and segment.doc_ids == [7, None]
            assert (segment.document(1) == ids[n // 3 :]).all()
            assert (segment.ids(n // 4, n // 2) == ids[n // 4 : n // 2]).all()


def test_outliers_become_exceptions():
    ids = np.full(128, 5, dtype=np.uint32)
    ids[::40] = 40000
    assert len(write_segment([1], [128], ids)) < 120  # four exceptions, no bits for the others


def test_files_against_the_library(llm, documents, library, sentence):
    rows = [*AWKWARD, *((100 + 7 * i % 50, sentence(i, 30)) for i in range(40)), (60, sentence("long", 5000))]
    folder = scratch_path(llm, "tokens")
    write_token_files(documents(rows), folder, segment_ids=300)
    got = [tuple(r) for r in read_token_files(llm, folder).collect()]
    start, want = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(str, ((d, n, c) for d, _, n, c in got))) == sorted(map(str, want))
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == [w[0] for w in want]
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    assert sum(r[2] for r in got) == start


def test_no_documents(llm, documents):
    folder = scratch_path(llm, "tokens")
    write_token_files(documents([]), folder)
    assert read_token_files(llm, folder).collect() == []


def test_only_tokens_that_may_end_there_are_looked_up():
    path = public_tokenizers.path("word_bpe_49k.json")
    bpe = TrieBpe(path)
    words = ["".join(random.Random(i).choice("etaoinqx") for _ in range(30)) for i in range(40)]
    expected = dict(bpe.encode(words))

    class Counted(dict):
        asked = 0

        def __contains__(self, token):
            Counted.asked += 1
            return super().__contains__(token)

    bpe.vocab = Counted(bpe.vocab)
    assert dict(bpe.encode(words)) == expected
    letters = sum(map(len, words))
    # a look-up for each length up to the longest token's would be many more
    assert 0 < Counted.asked < 2 * letters, Counted.asked / letters


def test_texts_cut_together_against_the_library(library):
    words, pick = LibraryWords(PATH), random.Random(8)
    simple = "abelmrstvZÀéßÿ19!.-'''  \n\x1c\x00\x7f"
    bits = ["'s", "'re", "''ll", "x'vest", "'m'd", "<|endoftext|>", "<|", "×", "÷", "Σ", "\x85", "ﬁ", "\x1f'T"]
    for _ in range(150):
        texts = ["".join(pick.choice(simple) for _ in range(pick.randint(0, 25))) for _ in range(pick.randint(1, 12))]
        texts = [text[:9] + pick.choice(bits) + text[9:] if pick.random() < 0.4 else text for text in texts]
        want = [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
        assert words.encode([text.encode() for text in texts]) == want, texts
    assert words.encode([]) == [] and words.encode([b""]) == [b""]


def test_pieces_are_forgotten_beyond_the_bound(library, monkeypatch):
    monkeypatch.setattr("corpuscope.llm.token_files.REMEMBERED", 5)
    words = LibraryWords(PATH)
    for text in ("one two three four", "five two six", "one two three four five six seven", "Σ one two", "six Σ ﬁ"):
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert words.encode([text.encode()]) == [want]


def test_simple_texts_are_cut_together_not_word_by_word(sentence, monkeypatch):
    words = LibraryWords(PATH)
    asked = []
    monkeypatch.setattr(words._cut, "pieces", lambda word: asked.append(word) or [])
    monkeypatch.setattr("corpuscope.llm.token_files.library_words", lambda path: words)
    texts = [sentence(i, 50, "fr") for i in range(20)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(20), pa.int64()), pa.array(texts), pa.array([0] * 20, pa.int32())], names=["doc_id", "text", "part"]
    )
    (segment,) = _segments(PATH, b"\1\0\0\0", 1 << 18)(iter([batch]))
    assert segment.column(3)[0].as_py() > 1000 and not asked


def test_distinct_pieces_are_walked_once_and_words_not_at_all(library, sentence, monkeypatch):
    codes = WordCodes(PATH)
    asked, walked = [], []
    monkeypatch.setattr(codes._cut, "pieces", lambda word: asked.append(word) or [])
    step = codes._bpe.encode
    monkeypatch.setattr(codes._bpe, "encode", lambda words: step(walked.extend(words) or words))
    monkeypatch.setattr("corpuscope.llm.bpe.word_codes", lambda path: codes)
    texts = [sentence(i, 50, "fr") + ", It's 2 o'clock." for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = pa.Table.from_batches(_encoded(PATH, True)(iter([batch, batch])))
    want = [library.encode(text, add_special_tokens=False).ids for text in texts]
    assert out.column("ids").to_pylist() == want * 2
    assert out.column("decoded").to_pylist() == [library.decode(ids, skip_special_tokens=False) for ids in want] * 2
    assert not asked and len(walked) == len(set(walked)) > 50


@pytest.mark.parametrize("remembered", [5, 400_000])
def test_ids_of_texts_taken_together(library, monkeypatch, remembered):
    monkeypatch.setattr("corpuscope.llm.bpe.REMEMBERED", remembered)
    codes, pick = WordCodes(PATH), random.Random(9)
    for _ in range(100):
        texts = ["".join(pick.choice(CHARS) for _ in range(pick.randint(0, 14))) for _ in range(pick.randint(0, 6))]
        texts += [pick.choice(["", " ", "It's 10", "été <|endoftext|>x", "one two one"])]
        want = [library.encode(text, add_special_tokens=False).ids for text in texts]
        ids, bounds = codes.encode_texts([text.encode() for text in texts])
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == want, texts
        assert [bytes(s).decode() for s in codes.decimals(ids, bounds)] == [" ".join(map(str, w)) for w in want]
        assert [bytes(s).decode() for s in codes.tokens(ids, bounds)] == [library.decode(w, skip_special_tokens=False) for w in want]
    assert codes.encode_texts([])[1].tolist() == [0]


def test_memory_is_handed_back_when_words_are_left(monkeypatch):
    codes, released = WordCodes(PATH), []
    codes.learn({"one"})
    codes.encode_texts([b"two three"])
    monkeypatch.setattr(pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: released.append(True)))
    codes.forget()
    assert released and not codes.id_text and not codes._simple_ids
