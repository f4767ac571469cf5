"""Words of texts as hashes: maximal runs without a space or a byte from tab to carriage return."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from corpuscope.llm.textbytes import CHUNK, Stretches

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, *range(9, 14)]] = True
#: A-Z in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Bytes from which a word's hash is a cryptographic one.
LONG_WORD = 128


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and row of each word of consecutive texts in one byte array.

    Bytes are hashed in stretches of bounded size, which a word that lies across a
    border joins whole. Sums of powers modulo 2^64 agree for certain strings of a thousand bytes and more, so long words get a
    cryptographic hash.
    """
    word = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # where a text begins a word cannot go on
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    hashes = np.zeros(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK, side="right")))
        low = starts[first]
        stretches = Stretches(data[low : ends[last - 1]])
        hashes[first:last] = stretches.hashes(starts[first:last] - low, ends[first:last] - low)
        first = last
    for number in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        digest = blake2b(data[starts[number] : ends[number]].tobytes(), digest_size=8).digest()
        hashes[number] = int.from_bytes(digest, "little")
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return hashes, starts, ends, rows
