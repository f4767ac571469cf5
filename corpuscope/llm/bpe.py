"""BPE encoding and decoding over a trie of distinct words."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpuscope.llm.pretokens import WORDS, pretokenizer
from corpuscope.llm.registry import query, table
from corpuscope.llm.textbytes import flat, row_groups

#: Words, and pieces of simple texts, that a task remembers; beyond, it starts anew.
REMEMBERED = 400_000
_REMEMBERED_PAIRS = 200_000
_NEVER = 1 << 60


@dataclass
class _Trace:
    """Ranks of a token's merges (closed by one that never comes), its outer symbols at each step, and if one symbol is left."""

    ranks: list[int]
    firsts: list[str]
    lasts: list[str]
    whole: bool


class TrieBpe:
    """Byte-pair encoding by last tokens.

    The encoding of a prefix is that of a shorter prefix and one last token, and a
    last token fits if merging the two neighbours alone gives back just these two.
    So each node of a trie of words needs its last token only, found from the nodes
    above it, and words that share a prefix share its nodes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self._fits: dict[tuple[str, str], bool] = {}
        self._traces: dict[str, _Trace] = {}
        self._reach = {suffix: self._reaches(suffix) for suffix in ("", self.end)}

    def _reaches(self, suffix: str) -> dict[str, int]:
        """For the last three characters of tokens ahead of the suffix: the longest token that ends so."""
        reach: dict[str, int] = {}
        for token in self.vocab:
            size = len(token) - len(suffix)
            if size > 2 and token.endswith(suffix):
                tail = token[size - 3 : size]
                reach[tail] = max(reach.get(tail, 0), size)
        return reach

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            letters = token[: -len(self.end)]
            return [*letters[:-1], letters[-1] + self.end] if letters else [token]
        return list(token)

    def _trace(self, token: str) -> _Trace:
        """The merges that make a token out of its symbols, and its outer symbols after each of them."""
        known = self._traces.get(token)
        if known is None:
            symbols = self._symbols(token)
            known = _Trace([], [symbols[0]], [symbols[-1]], False)
            while len(symbols) > 1:
                ranked = ((self._ranks.get((a, b), _NEVER), i) for i, (a, b) in enumerate(itertools.pairwise(symbols)))
                rank, i = min(ranked)
                if rank == _NEVER:
                    break
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                known.ranks.append(rank)
                known.firsts.append(symbols[0])
                known.lasts.append(symbols[-1])
            known.whole = len(symbols) == 1
            known.ranks.append(_NEVER)
            self._traces[token] = known
        return known

    def _fit(self, left: str, right: str) -> bool:
        """Whether two tokens that stand next to each other stay as they are ('' stands for no token).

        The merges inside both are played in order of rank, the left one first if they
        tie; no merge across the border may come before the next of them.
        """
        b = self._trace(right)
        if not left or not b.whole:
            return b.whole
        a = self._trace(left)
        if not a.whole:
            return False
        i = j = 0
        while True:
            across = self._ranks.get((a.lasts[i], b.firsts[j]), _NEVER)
            of_a, of_b = a.ranks[i], b.ranks[j]
            if of_a <= of_b:
                if across < of_a:
                    return False
                if of_a == _NEVER:
                    return True
                i += 1
            else:
                if across <= of_b:
                    return False
                j += 1

    def _last(self, word: str, length: int, lasts: list[str], suffix: str) -> str:
        """The last token of the word's prefix of this length; ``lasts`` has those of all shorter prefixes."""
        vocab, fits = self.vocab, self._fits
        # no token that ends here is longer; those of one or two characters are looked up in any case
        longest = self._reach[suffix].get(word[max(0, length - 3) : length], 2)
        for start in range(max(0, length - longest), length):
            token = word[start:length] + suffix
            if token in vocab:
                pair = (lasts[start], token)
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) > _REMEMBERED_PAIRS:
                        fits.clear()
                    fit = fits[pair] = self._fit(*pair)
                if fit:
                    return token
        raise ValueError(f"no token fits the end of {word[:length]!r}")

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """The ids of distinct words, by one depth-first walk through their trie.

        In sorted order a word shares with the one before it the path down to their
        common prefix, so a stack of last tokens is all of the trie that has to stand
        at a time.
        """
        vocab, end = self.vocab, self.end
        before, lasts = "", [""]
        for word in sorted(words):
            size = len(word)
            shared, most = 0, min(len(before) - 1, size - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del lasts[shared + 1 :]
            for length in range(len(lasts), size):  # nodes above the word's end
                lasts.append(self._last(word, length, lasts, ""))
            token = self._last(word, size, lasts, end)
            ids = [vocab[token]]
            at = size - (len(token) - len(end))
            while at:
                token = lasts[at]
                ids.append(vocab[token])
                at -= len(token)
            ids.reverse()
            yield word, ids
            before = word


class WordCodes:
    """Ids of words and of pieces of words, remembered up to a bound."""

    def __init__(self, path: str):
        self._cut = pretokenizer(path)
        self._bpe = TrieBpe(path)
        shown = {number: token for token, number in self._bpe.vocab.items()}
        shown |= {number: content for content, number in self._cut.special.items()}
        self._texts = {str(number): token for number, token in shown.items()}
        # each id in decimal, and its token, with the space that stands behind it
        numbers = range(max(shown, default=-1) + 1)
        self._decimals = pa.array([f"{number} ".encode() for number in numbers], pa.large_binary())
        self._tokens = pa.array([f"{shown.get(number, '')} ".encode() for number in numbers], pa.large_binary())
        self.id_text: dict[str, str] = {}
        self._piece_ids: dict[str, str] = {}
        self._simple_ids: dict[bytes, bytes] = {}

    def learn(self, words: set[str]) -> None:
        """Have the ids of all these words at hand: decimal, a space between."""
        new = [word for word in words if word not in self.id_text]
        if len(self.id_text) + len(new) > REMEMBERED:
            self.id_text, self._piece_ids, new = {}, {}, list(words)
        known = self._piece_ids
        cut = {word: self._cut.pieces(word) for word in new}
        pieces_of_new = (piece for pieces in cut.values() for piece in pieces if isinstance(piece, str))
        missing = {piece for piece in pieces_of_new if piece not in known}
        for piece, ids in self._bpe.encode(missing):
            known[piece] = " ".join(map(str, ids))
        for word, pieces in cut.items():
            if len(pieces) == 1 and pieces[0] in known:
                self.id_text[word] = known[pieces[0]]
            else:
                self.id_text[word] = " ".join([known[p] if isinstance(p, str) else str(p) for p in pieces])

    def forget(self) -> None:
        """Leave the words and hand free memory back; the worker may go on with other work."""
        self.id_text, self._piece_ids, self._simple_ids = {}, {}, {}
        pa.default_memory_pool().release_unused()

    def encode(self, words: list[str]) -> str:
        """The ids of words that were learned."""
        return " ".join(filter(None, map(self.id_text.__getitem__, words)))

    def decode(self, ids: str) -> str:
        """Token texts with a space between; the tokenizer names no other way to join them."""
        return " ".join(map(self._texts.__getitem__, ids.split(" "))) if ids else ""

    def _simple(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces of simple texts, as little-endian bytes; new ones share one trie."""
        known = self._simple_ids
        new = [piece for piece in pieces if piece not in known]
        if len(known) + len(new) > REMEMBERED:
            self._simple_ids = known = {}
            new = pieces
        spelled = {self._cut.spelled_bytes(piece): piece for piece in new}
        for spelling, ids in self._bpe.encode(spelled):
            known[spelled[spelling]] = pack(f"<{len(ids)}i", *ids)
        return list(map(known.__getitem__, pieces))

    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and the bounds of each text's; a distinct piece is worked out once for all of them."""
        pieces, bounds, left_out = self._cut.simple_pieces(texts)
        coded = pieces.dictionary_encode()
        found = self._simple(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ends = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4, out=ends[1:])
        lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
        lists = lists.take(coded.indices)
        ids, ends = lists.flatten().to_numpy(), np.asarray(lists.offsets)
        bounds = (ends - ends[0])[bounds[: len(texts) + 1]]
        if not len(left_out):
            return ids, bounds
        words = {row: WORDS.findall(texts[row].decode()) for row in left_out.tolist()}
        self.learn({word for found in words.values() for word in found})
        parts = [ids[a:b] for a, b in itertools.pairwise(bounds)]
        for row, found in words.items():
            parts[row] = np.array(self.encode(found).split(), np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(list(map(len, parts)))])

    def decimals(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """The ids of each text in decimal, a space between."""
        return _joined(self._decimals, ids, bounds)

    def tokens(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """What :meth:`decode` gives for each text, in UTF-8."""
        return _joined(self._tokens, ids, bounds)


def _joined(spaced: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
    """The entries that the ids of each text stand for, without the last space."""
    taken = spaced.take(pa.array(ids))
    data = memoryview(taken.buffers()[2] or b"")
    ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(ids) + 1][bounds].tolist()
    return [data[a : max(a, b - 1)] for a, b in itertools.pairwise(ends)]


@lru_cache(maxsize=2)
def word_codes(path: str) -> WordCodes:
    """One for each file and Python worker."""
    return WordCodes(path)


#: Bytes of text that are encoded together; a larger text stands alone.
_GROUP = 1 << 20


def _encoded(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = word_codes(path)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for first, last in row_groups(offsets, _GROUP):
                texts = [data[a:b].tobytes() for a, b in itertools.pairwise(offsets[first : last + 1])]
                ids, bounds = codes.encode_texts(texts)
                shown, decoded = codes.decimals(ids, bounds), codes.tokens(ids, bounds)
                columns = {
                    "doc_id": batch.column(0).slice(first, last - first),
                    "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(text).hexdigest() for text in shown], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(text).hexdigest() for text in decoded], pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                    columns["decoded"] = pa.array([str(text, "utf-8") for text in decoded], pa.string())
                yield pa.RecordBatch.from_pydict(columns)
        codes.forget()

    return run


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode every whole text with the tokenizer file at ``path`` and decode it again.

    ``path`` is a BPE file of the tokenizers library whose pre-tokenizer drops white
    space, and must be readable on the executors. Some texts at a time are cut into pieces together, and the distinct
    ones are encoded over one trie, so shared prefixes are worked out once; texts are put together from their
    pieces (those with other than ASCII and Latin-1 letters word by word). A null text counts as empty: 0 tokens. Special tokens in a text are encoded
    as such. Rows are independent: no shuffle, and repeated rows or null ids are rows like any other.

    Columns: ``doc_id``, ``n_tokens``, ``ids_sha256`` (ids in decimal, a space
    between), ``decoded_sha256``; with ``with_ids`` also ``ids`` and ``decoded``.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(_encoded(path, with_ids), schema)


@query("op10_bpe_trie")
def op10_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and decoded texts of all documents."""
    return encode(table(spark, sf_dir, "documents"))
