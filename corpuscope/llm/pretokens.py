"""Words of a text cut as a word-level byte BPE tokenizer cuts them, without passing whole texts through the library.

White space separates tokens and is dropped, and neither normalising nor cutting looks across it, so a
text's ids are those of its words in turn. Distinct words are worked out once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import AddedToken, Tokenizer

WORDS = re.compile(r"[^ \t-\r]+")
# ASCII and the letters of Latin-1: one char each when lower-cased, untouched by NFC
_SIMPLE = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]+")
_SIMPLE_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-zß-öø-ÿ0-9]+")

_SPACE, _LETTER, _DIGIT, _OTHER, _AWKWARD = range(5)


def _byte_kinds() -> np.ndarray:
    """The kind of each UTF-8 byte; of the bytes above ASCII only those of Latin-1 letters are letters."""
    kinds = np.full(256, _AWKWARD, dtype=np.uint8)
    kinds[:128] = _OTHER
    kinds[[*range(9, 14), 32]] = _SPACE
    kinds[48:58] = _DIGIT
    kinds[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = _LETTER
    return kinds


_KINDS = _byte_kinds()
_LOWER = np.arange(256, dtype=np.uint8) + np.where((np.arange(256) >= 65) & (np.arange(256) < 91), 32, 0).astype(np.uint8)


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level tokenizers write for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in printable}
    others = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + i) for i, b in enumerate(others)}


class Pretokenizer:
    """Cuts words into the pieces that merging works on, each a string of the byte alphabet, or the id of a special token."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added: dict[int, AddedToken] = self.tokenizer.get_added_tokens_decoder()
        self.special = {token.content: number for number, token in added.items()}
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._special_starts = tuple({content[:2] for content in self.special})
        self._bytes = byte_alphabet()

    def _spelled(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isalpha() else "".join(map(self._bytes.__getitem__, piece.encode()))

    def pieces(self, word: str) -> list[str | int]:
        """The pieces of a word without white space."""
        if _SIMPLE.fullmatch(word) and not any(start in word for start in self._special_starts):
            if word.isascii() and word.isalpha():
                return [word.lower()]
            return list(map(self._spelled, _SIMPLE_PIECES.findall(word.lower())))
        found: list[str | int] = []
        for part in self._specials.split(word) if self.special else [word]:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part)
                found += [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return found

    def spelled_bytes(self, piece: bytes) -> str:
        """A piece of :meth:`simple_pieces` in the byte alphabet."""
        return piece.decode() if piece.isalpha() else "".join(map(self._bytes.__getitem__, piece))

    def simple_pieces(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The pieces of all texts in turn as bytes, the bounds of each text's in them, and the numbers of the texts left out.

        These are the pieces that :meth:`pieces` gives for the words of a text of ASCII and Latin-1 letters, cut from
        all texts at once. Texts with other characters, or what may be a special token, are left out: no pieces.
        """
        joined = b" ".join([*texts, b"   "])  # no piece goes across, and none looks beyond the end
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        data = _LOWER[np.frombuffer(joined, np.uint8)]
        kinds = _KINDS[data]
        lead = np.flatnonzero(data == 0xC3)
        follow = data[lead + 1]
        data[lead[follow <= 0x9E] + 1] += 32
        signs = lead[(follow == 0x97) | (follow == 0xB7)]  # times and divided by are no letters
        special = [m.start() for s in self._special_starts for m in re.finditer(re.escape(s.encode()), joined)]
        awkward = np.concatenate([np.flatnonzero(kinds == _AWKWARD), signs, np.array(special, dtype=np.int64)])
        left_out = np.unique(np.searchsorted(begins, awkward, side="right") - 1)
        for row in left_out:
            kinds[begins[row] : begins[row] + lengths[row]] = _SPACE
        solid = kinds != _SPACE
        starts = kinds == _DIGIT
        starts[1:] |= kinds[1:] != kinds[:-1]
        starts[0] = True
        starts &= solid
        # 's 't 'm 'd 're 've 'll are pieces where a piece starts with them
        quotes = np.flatnonzero((data == ord("'")) & starts)
        one, two = data[quotes + 1], data[quotes + 2]
        short = np.isin(one, list(b"stmd"))
        long = (np.isin(one, list(b"rv")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        starts[quotes[short | long] + 1] = False
        behind = np.concatenate([quotes[short] + 2, quotes[long] + 3])
        starts[behind[kinds[behind] == _LETTER]] = True
        bounds = np.searchsorted(np.flatnonzero(starts), begins)
        offsets = np.append(np.flatnonzero(starts[solid]), np.count_nonzero(solid))
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers), bounds, left_out


@lru_cache(maxsize=4)
def pretokenizer(path: str) -> Pretokenizer:
    """One for each file and Python worker."""
    return Pretokenizer(path)
