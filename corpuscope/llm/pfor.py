"""Patched frame-of-reference segments: token ids of documents as packed blocks.

A segment is laid out, all numbers little-endian, as

    magic 8 bytes | documents u4 | ids u8 | blocks u4
    document ids i8 each | null marks u1 each | lengths in ids u4 each
    block starts u8 each, and the end, counted from the first block
    blocks

and a block of up to 128 ids as

    least id u4 | width u1 | exceptions u1 | 128 differences packed at width bits
    places of the exceptions u1 each | their differences u4 each

The width holds the given share of the block's differences from its least id; larger ones are
exceptions. The last block is filled up with its last id. Block starts let a reader go to any id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MAGIC = b"PFORSEG1"
BLOCK = 128
#: Share of a block's differences that its width must hold.
SHARE = 0.9
_HEAD = 6


def _widths(differences: np.ndarray, share: float) -> np.ndarray:
    rank = min(BLOCK, max(1, int(np.ceil(BLOCK * share)))) - 1
    held = np.partition(differences, rank, axis=1)[:, rank]
    return np.frexp(held.astype(np.float64))[1].astype(np.int64)  # bit length


def _place(out: np.ndarray, at: np.ndarray, values: np.ndarray, kind: str) -> None:
    raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1)
    out[at[:, None] + np.arange(raw.shape[1])] = raw


def pack_blocks(ids: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all blocks and the start of each, with the end behind them."""
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    values = np.full(blocks * BLOCK, ids[-1], dtype=np.uint32)
    values[: len(ids)] = ids
    values = values.reshape(blocks, BLOCK)
    least = values.min(axis=1)
    differences = values - least[:, None]
    widths = _widths(differences, share)
    beyond = (differences.astype(np.uint64) >> widths[:, None].astype(np.uint64)) > 0
    exceptions = beyond.sum(axis=1)
    sizes = _HEAD + widths * (BLOCK // 8) + exceptions * 5
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(starts[-1], dtype=np.uint8)
    _place(out, starts[:-1], least, "<u4")
    out[starts[:-1] + 4] = widths
    out[starts[:-1] + 5] = exceptions
    for width in np.unique(widths[widths > 0]):
        rows = np.flatnonzero(widths == width)
        bits = (differences[rows][:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        packed = np.packbits(bits.astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
        out[(starts[rows] + _HEAD)[:, None] + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(beyond)
    if len(row):
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(exceptions)])[row]
        lists = starts[row] + _HEAD + widths[row] * (BLOCK // 8)
        out[lists + nth] = place
        _place(out, lists + exceptions[row] + 4 * nth, differences[row, place], "<u4")
    return out, starts


def unpack_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of whole blocks at the given starts, 128 each."""
    blocks = len(starts)
    least = data[starts[:, None] + np.arange(4)].copy().view("<u4").reshape(blocks).astype(np.uint32)
    widths = data[starts + 4].astype(np.int64)
    exceptions = data[starts + 5].astype(np.int64)
    differences = np.zeros((blocks, BLOCK), dtype=np.uint32)
    for width in np.unique(widths[widths > 0]):
        rows = np.flatnonzero(widths == width)
        packed = data[(starts[rows] + _HEAD)[:, None] + np.arange(width * (BLOCK // 8))]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, width)
        values = np.zeros((len(rows), BLOCK), dtype=np.uint32)
        for bit in range(width):
            values |= bits[:, :, bit].astype(np.uint32) << np.uint32(bit)
        differences[rows] = values
    if exceptions.sum():
        row = np.repeat(np.arange(blocks), exceptions)
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(exceptions)])[row]
        lists = starts[row] + _HEAD + widths[row] * (BLOCK // 8)
        at = lists + exceptions[row] + 4 * nth
        differences[row, data[lists + nth]] = data[at[:, None] + np.arange(4)].copy().view("<u4").reshape(len(row))
    return (differences + least[:, None]).reshape(-1)


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, share: float = SHARE) -> bytes:
    """A segment of documents with the ids of all of them in turn."""
    blocks, starts = pack_blocks(ids, share)
    return b"".join(
        [
            MAGIC,
            np.array([len(doc_ids)], "<u4").tobytes(),
            np.array([len(ids)], "<u8").tobytes(),
            np.array([len(starts) - 1], "<u4").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            np.array(lengths, "<u4").tobytes(),
            starts.astype("<u8").tobytes(),
            blocks.tobytes(),
        ]
    )


@dataclass
class Segment:
    """A segment opened for reading; ids are unpacked on demand."""

    payload: bytes

    def __post_init__(self) -> None:
        if self.payload[:8] != MAGIC:
            raise ValueError("not a segment")
        at = 8

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            values = np.frombuffer(self.payload, kind, count, at)
            at += values.nbytes
            return values

        documents = int(take("<u4", 1)[0])
        self.size = int(take("<u8", 1)[0])
        blocks = int(take("<u4", 1)[0])
        numbers, nulls = take("<i8", documents), take("u1", documents)
        self.doc_ids = [None if null else int(d) for d, null in zip(numbers, nulls, strict=True)]
        self.bounds = np.concatenate([[0], np.cumsum(take("<u4", documents).astype(np.int64))])
        self._starts = take("<u8", blocks + 1).astype(np.int64)
        self._data = np.frombuffer(self.payload, np.uint8, offset=at)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from one place up to another, from the blocks that hold them."""
        last = self.size if last is None else last
        if first >= last:
            return np.zeros(0, dtype=np.uint32)
        low, high = first // BLOCK, -(-last // BLOCK)
        return unpack_blocks(self._data, self._starts[low:high])[first - low * BLOCK : last - low * BLOCK]

    def document(self, number: int) -> np.ndarray:
        """The ids of one document by its place in the segment."""
        return self.ids(int(self.bounds[number]), int(self.bounds[number + 1]))
