"""A run-length index: the run-compressed Burrows-Wheeler transform of a set of strings with sampled run ends.

Between two neighbouring suffixes of the sorted order that are preceded by the same byte, the
length of the common prefix follows from that of the suffixes one byte earlier. So the
common prefixes at the ends of the runs of the transform are all that has to be kept: read in text
order, each position either is a sample or has its left neighbour's value less one.
Repetitive strings have few runs, and so few samples.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from corpuscope.llm.textbytes import Stretches

_PIECE_BITS = 20


@dataclass
class RunIndex:
    """Runs of the transform with their samples, in text order.

    ``heads`` and ``tails`` are the text positions of the first and last suffix of each
    run, ``head_lcp`` and ``tail_lcp`` the bytes they share with the suffix before and
    behind the run.
    """

    length: int
    run_bytes: np.ndarray
    run_lengths: np.ndarray
    heads: np.ndarray
    head_lcp: np.ndarray
    tails: np.ndarray
    tail_lcp: np.ndarray


def _suffix_order(
    text: np.ndarray, piece: np.ndarray, is_end: np.ndarray, room: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in sorted order, by prefix doubling, and the least and most bytes that each shares with the one before it.

    The end of each piece is a symbol of its own; ``room`` has the bytes ahead of it. What two neighbours share is
    narrowed by the round that tells them apart; those that the first symbols tell apart are known exactly.
    """
    n = len(text)
    alphabet = np.zeros(256, dtype=np.int64)
    used = np.flatnonzero(np.bincount(text[~is_end], minlength=256))
    alphabet[used] = np.arange(1, len(used) + 1)
    symbols = np.where(is_end, 0, alphabet[text])
    bits = int(len(used)).bit_length() or 1
    width = min(n, max(1, (62 - _PIECE_BITS) // bits))
    key = symbols.copy()
    for step in range(1, width):
        key <<= bits
        key[: n - step] |= symbols[step:]
    # nothing counts behind the end, and there the piece tells ends apart
    heads = np.array([((1 << bits * r) - 1) << bits * (width - r) for r in range(width + 1)], dtype=np.int64)
    key &= heads[np.minimum(room, width)]
    key = (key << _PIECE_BITS) | np.where(room < width, piece, 0)
    order = np.argsort(key)
    ordered = key[order]
    apart = (ordered[1:] ^ ordered[:-1]) >> _PIECE_BITS
    same = width - 1 - (np.frexp(apart.astype(np.float64))[1] - 1) // bits  # symbols ahead of the first that differs
    least = np.concatenate([[0], np.where(apart == 0, room[order[1:]], same)])
    most = least.copy()
    span = width
    # a rank is the first slot of the suffixes that are alike so far; only these are sorted on
    slots, fresh = np.arange(n), np.concatenate([[True], ordered[1:] != ordered[:-1]])
    ranks = np.empty(n, dtype=np.int64)
    while True:
        ranks[order[slots]] = np.maximum.accumulate(np.where(fresh, slots, 0))
        tied = ~(fresh & np.concatenate([fresh[1:], [True]]))
        slots, first = slots[tied], fresh[tied]
        if not len(slots):
            return order, least, most
        open_ones = order[slots]
        ahead = open_ones + span
        behind = np.where(ahead < n, ranks[np.minimum(ahead, n - 1)] + 1, 0)
        key = ranks[open_ones] * (n + 1) + behind
        turn = np.argsort(key)
        order[slots] = open_ones[turn]
        key = key[turn]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        told = slots[fresh & ~first]
        least[told], most[told] = span, 2 * span - 1
        span *= 2


def _common(stretches: Stretches, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b share, from low to high of them, by bisection on hashes."""
    found = low.copy()
    left = np.flatnonzero(low < high)
    a, b, low, high = a[left], b[left], low[left], high[left]
    while len(left):
        middle = (low + high + 1) // 2
        same = stretches.same(a, b, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        found[left] = low
        more = np.flatnonzero(low < high)
        left, a, b, low, high = left[more], a[more], b[more], low[more], high[more]
    return found


def build(pieces: list[bytes]) -> tuple[RunIndex, np.ndarray]:
    """The index of the pieces, each closed by an end of its own, and the offset of each piece."""
    lengths = np.array([len(p) + 1 for p in pieces], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    text = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
    n = len(text)
    is_end = np.zeros(n, dtype=bool)
    is_end[starts[1:] - 1] = True
    piece = np.repeat(np.arange(len(pieces), dtype=np.int64), lengths)
    room = np.repeat(starts[1:] - 1, lengths) - np.arange(n)  # bytes up to the end of the piece
    order, least, most = _suffix_order(text, piece, is_end, room)
    # the byte before the first suffix is the last end
    bwt = np.where(is_end, 256 + piece, text)[order - 1]
    new_run = np.concatenate([[True], bwt[1:] != bwt[:-1]])
    first = np.flatnonzero(new_run)
    last = np.concatenate([first[1:] - 1, [n - 1]])
    a, b = order[first], order[first - 1]
    most = np.minimum(most[first], np.minimum(room[a], room[b]))
    most[0] = 0  # nothing stands before the first suffix
    shared = _common(Stretches(text), a, b, np.minimum(least[first], most), most)
    index = RunIndex(
        length=n,
        run_bytes=bwt[first],
        run_lengths=last - first + 1,
        heads=order[first],
        head_lcp=shared,
        tails=order[last],
        tail_lcp=np.append(shared[1:], 0),  # the suffix behind a run is the head of the next one
    )
    return index, starts


def matching_statistics(index: RunIndex) -> np.ndarray:
    """For each position, the bytes from there that also start at some other position.

    One sweep in text order over the samples: the longest match of a suffix is with a
    neighbour in sorted order, and a position that is no sample has its left
    neighbour's value less one.
    """
    best = np.zeros(index.length, dtype=np.int64)
    for places, values in ((index.heads, index.head_lcp), (index.tails, index.tail_lcp)):
        reach = np.full(index.length, -1, dtype=np.int64)
        reach[places] = places
        source = np.maximum.accumulate(reach)
        at = np.zeros(index.length, dtype=np.int64)
        at[places] = values
        known = source >= 0
        value = np.where(known, at[source] - (np.arange(index.length) - source), 0)
        np.maximum(best, value, out=best)
    return best
