"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.registry import query, table
from corpuscope.llm.textbytes import BYTE_VALUES, CHUNK, Stretches, mixed
from corpuscope.session import shuffle_partitions

#: Cells of a fingerprint, in three tables of equal size.
CELLS = 24
#: Times the cells that a failed comparison is tried again with.
GROWTH = 3
#: A cut within a paragraph stands at the least hash so many bytes around.
REACH = 8
#: Bytes after which a paragraph piece is cut in any case.
LONGEST = 1024

_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], dtype=np.uint64)
_CHECK = np.uint64(0x082EFA98EC4E6C89)


def _cuts(data: np.ndarray) -> np.ndarray:
    """True behind whose byte a paragraph piece ends: line ends, and least hashes of four bytes within reach.

    Where a paragraph is cut depends on the bytes around the place alone, so an
    edit moves no cut further away.
    """
    out = np.zeros(len(data), dtype=bool)
    margin = REACH + 4
    for at in range(0, len(data), CHUNK):
        low, high = max(0, at - margin), min(len(data), at + CHUNK + margin)
        part = data[low:high]
        values = BYTE_VALUES[part] >> np.uint64(32)
        hashes = np.full(len(part), 0xFFFFFFFF, dtype=np.uint64)
        if len(part) >= 4:
            rolled = values[3:] + values[2:-1] * np.uint64(5) + values[1:-2] * np.uint64(25) + values[:-3] * np.uint64(125)
            hashes[3:] = (rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        padded = np.concatenate([np.full(REACH, 0xFFFFFFFF, np.uint64), hashes, np.full(REACH, 0xFFFFFFFF, np.uint64)])
        left = padded
        span = 1
        while span < REACH:
            left = np.minimum(left[:-span], left[span:])
            span *= 2
        # left[i] covers REACH places from i on, in padded numbering
        here = hashes
        cut = (here < left[: len(here)]) & (here <= left[REACH + 1 : REACH + 1 + len(here)])
        cut |= part == 10
        out[at : min(len(data), at + CHUNK)] = cut[at - low : at - low + CHUNK]
    return out


def spaced(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array with gaps between, so that none is cut by what its neighbours say; starts and ends."""
    gap = bytes(REACH + 3)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths + len(gap)) - lengths
    return np.frombuffer(gap + gap.join(texts) + gap, dtype=np.uint8), starts, starts + lengths


def paragraph_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the paragraph pieces of texts, and the row of each.

    A piece that stands in a text again gets another digest for each time, so a text
    has a set of them.
    """
    data, text_starts, text_ends = spaced(texts)
    cuts = np.flatnonzero(_cuts(data)) + 1
    rows = np.searchsorted(text_starts, cuts - 1, side="right") - 1
    inside = (rows >= 0) & (cuts < text_ends[rows])
    ends = np.union1d(cuts[inside], text_ends[text_ends > text_starts])
    if not len(ends):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    rows = np.searchsorted(text_starts, ends - 1, side="right") - 1
    first = np.concatenate([[True], rows[1:] != rows[:-1]])
    starts = np.where(first, text_starts[rows], np.concatenate([[0], ends[:-1]]))
    pieces = -(-(ends - starts) // LONGEST)  # more than one for very long pieces
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(starts, pieces) + nth * LONGEST
    ends = np.minimum(np.repeat(ends, pieces), starts + LONGEST)
    digests = np.zeros(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK, side="right")))
        low = starts[first]
        stretches = Stretches(data[low : ends[last - 1]])
        digests[first:last] = stretches.hashes(starts[first:last] - low, ends[first:last] - low)
        first = last
    rows = np.searchsorted(text_starts, starts, side="right") - 1
    order = np.lexsort((digests, rows))
    digests, rows = digests[order], rows[order]
    new = np.concatenate([[True], (digests[1:] != digests[:-1]) | (rows[1:] != rows[:-1])])
    again = np.arange(len(digests)) - np.maximum.accumulate(np.where(new, np.arange(len(digests)), 0))
    return mixed(digests + again.astype(np.uint64) * np.uint64(0x452821E638D01377)), rows


@dataclass
class Sketches:
    """Cells of some documents: how many digests fell into each, their sum, and the sum of their checks (modulo 2^64)."""

    counts: np.ndarray
    keys: np.ndarray
    checks: np.ndarray

    def __sub__(self, other: Sketches) -> Sketches:
        return Sketches(self.counts - other.counts, self.keys - other.keys, self.checks - other.checks)

    def take(self, rows: np.ndarray) -> Sketches:
        return Sketches(self.counts[rows], self.keys[rows], self.checks[rows])

    def texts(self, sizes: np.ndarray) -> list[str]:
        """Each sketch as text: its number of digests, then the cells."""
        width = self.counts.shape[1]
        raw = np.zeros((len(sizes), 4 + 16 * width), dtype=np.uint8)
        raw[:, :4] = sizes.astype("<u4").view(np.uint8).reshape(-1, 4)
        raw[:, 4 : 4 + 4 * width] = self.counts.astype("<i4").view(np.uint8).reshape(len(sizes), -1)
        raw[:, 4 + 4 * width : 4 + 12 * width] = self.keys.astype("<u8").view(np.uint8).reshape(len(sizes), -1)
        short = (self.checks & np.uint64(0xFFFFFFFF)).astype("<u4")
        raw[:, 4 + 12 * width :] = short.view(np.uint8).reshape(len(sizes), -1)
        return [base64.b64encode(row.tobytes()).decode() for row in raw]


def _places(digests: np.ndarray, cells: int, round_: int) -> np.ndarray:
    """The cell of each digest in each of the three tables."""
    part = np.uint64(cells // 3)
    turns = [mixed(digests ^ (seed + np.uint64(round_))) % part + np.uint64(i) * part for i, seed in enumerate(_SEEDS)]
    return np.stack(turns).astype(np.int64)


def sketch(digests: np.ndarray, rows: np.ndarray, documents: int, cells: int, round_: int = 0) -> Sketches:
    """The sketches of some documents."""
    at = (_places(digests, cells, round_) + rows * cells).reshape(-1)
    counts = np.bincount(at, minlength=documents * cells)
    keys = np.zeros(documents * cells, dtype=np.uint64)
    np.add.at(keys, at, np.tile(digests, 3))
    checks = np.zeros(documents * cells, dtype=np.uint64)
    np.add.at(checks, at, np.tile(mixed(digests ^ _CHECK), 3))
    shape = (documents, cells)
    return Sketches(counts.reshape(shape), keys.reshape(shape), checks.reshape(shape))


def peel(difference: Sketches, round_: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Take digests out of cells that hold one, until none is left.

    Returns row, digest and sign of all that came out (1: the left document's), and which
    rows came out whole.
    """
    documents, cells = difference.counts.shape
    counts, keys, checks = (a.copy().reshape(-1) for a in (difference.counts, difference.keys, difference.checks))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.flatnonzero(np.abs(counts) == 1)
    while len(look):
        sign = counts[look]
        one = np.abs(sign) == 1
        look, sign = look[one], sign[one]
        digest = np.where(sign > 0, keys[look], np.uint64(0) - keys[look])
        check = np.where(sign > 0, checks[look], np.uint64(0) - checks[look])
        pure = check == mixed(digest ^ _CHECK)
        row, digest, sign = look[pure] // cells, digest[pure], sign[pure]
        _, kept = np.unique(digest ^ mixed(row.astype(np.uint64)), return_index=True)
        row, digest, sign = row[kept], digest[kept], sign[kept]
        if not len(row):
            break
        found.append((row, digest, sign))
        at = (_places(digest, cells, round_) + row * cells).reshape(-1)
        signs = np.tile(sign, 3)
        np.subtract.at(counts, at, signs)
        wide = np.where(sign > 0, digest, np.uint64(0) - digest)
        np.subtract.at(keys, at, np.tile(wide, 3))
        check = mixed(digest ^ _CHECK)
        np.subtract.at(checks, at, np.tile(np.where(sign > 0, check, np.uint64(0) - check), 3))
        look = np.unique(at)
    whole = ~((counts != 0) | (keys != 0) | (checks != 0)).reshape(documents, cells).any(axis=1)
    rows, digests, signs = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    return rows, digests, signs, whole


def differing(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], first: Sketches
) -> np.ndarray:
    """How many digests stand in one document of each pair alone.

    ``first`` is the difference of the pairs' fingerprints. Pairs that it does not peel
    whole are sketched anew with more cells, until they are.
    """
    documents, cells = first.counts.shape
    result = np.zeros(documents, dtype=np.int64)
    open_ = np.arange(documents)
    difference, round_ = first, 0
    while True:
        rows, _, _, whole = peel(difference, round_)
        sizes = np.bincount(rows, minlength=len(open_))
        result[open_[whole]] = sizes[whole]
        open_ = open_[~whole]
        if not len(open_):
            return result
        cells *= GROWTH
        round_ += 1  # other cells too, so that no two digests meet for good
        number = np.full(documents, -1)
        number[open_] = np.arange(len(open_))
        parts = []
        for digests, owners in (left, right):
            kept = number[owners] >= 0
            parts.append(sketch(digests[kept], number[owners[kept]], len(open_), cells, round_))
        difference = parts[0] - parts[1]


def likeness(difference: np.ndarray, left_sizes: np.ndarray, right_sizes: np.ndarray) -> np.ndarray:
    """1 less the share of digests that stand in one document alone; two empty documents are alike."""
    total = left_sizes + right_sizes
    return np.where(total > 0, 1 - difference / np.maximum(total, 1), 1.0)


def _compare(cells: int):
    def compared(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows of all documents but the last, each with the one behind it."""
        count = len(texts) - 1
        edited = []
        for text, following in zip(texts[:-1], texts[1:], strict=True):
            quarter = len(text) // 4
            edited.append((text[: len(text) - quarter] + following[:quarter]).encode())
        own, own_rows = paragraph_digests([t.encode() for t in texts])
        new, new_rows = paragraph_digests(edited)
        own_sizes = np.bincount(own_rows, minlength=count + 1)
        new_sizes = np.bincount(new_rows, minlength=count)
        prints = sketch(own, own_rows, count + 1, cells)
        edited_prints = sketch(new, new_rows, count, cells)
        here = prints.take(np.arange(count))
        left = (own[own_rows < count], own_rows[own_rows < count])
        behind = (own[own_rows > 0], own_rows[own_rows > 0] - 1)
        to_edited = differing(left, (new, new_rows), here - edited_prints)
        to_next = differing(left, behind, here - prints.take(np.arange(1, count + 1)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:-1], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
                pa.array(here.texts(own_sizes[:-1]), pa.string()),
                pa.array(edited_prints.texts(new_sizes), pa.string()),
                pa.array(likeness(to_edited, own_sizes[:-1], new_sizes)),
                pa.array(likeness(to_next, own_sizes[:-1], own_sizes[1:])),
            ],
            names=[c.split(" ")[0] for c in _RESULT.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            halo = batch.column(2).to_pylist()
            for doc_id, value, extra in zip(batch.column(0).to_pylist(), batch.column(1), halo, strict=True):
                if extra and ids and ids[-1] is _DONE:
                    continue  # a repeated row at the border; one is enough
                ids.append(_DONE if extra else doc_id)
                texts.append(value.as_py() or "")
                size += len(texts[-1])
                if size >= CHUNK // 2 and len(ids) > 1:
                    yield compared(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if len(ids) > 1:
            yield compared(ids, texts)

    return run


_DONE = object()
_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _range_number(doc_id: Column, df: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """Number the ranges of an id, null in the first; as many numbers at most."""
    shares = [i / ranges for i in range(1, ranges)]
    bounds = df.select(F.percentile_approx(doc_id.cast("double"), F.array(*map(F.lit, shares)), 20 * ranges)).first()[0]
    if not bounds:  # one range, or no id at all
        return df.withColumn("_range", F.lit(0)), 1
    splits = [-float("inf"), *sorted(set(bounds)), float("inf")]
    numbered = df.withColumn("_id", F.coalesce(doc_id.cast("double"), F.lit(-float("inf"))))
    numbered = Bucketizer(splits=splits, inputCol="_id", outputCol="_range").transform(numbered)
    return numbered.withColumn("_range", F.col("_range").cast("int")).drop("_id"), len(splits) - 1


def compare_versions(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Fingerprint every whole text and an edited version, and compare each with that and with the next document.

    The edited version ends, in place of its last quarter of code points, with as many
    from the start of the next document in ascending id (after the last: the first).
    A fingerprint is a sketch of the digests of a text's paragraphs; long paragraphs are cut
    where their own bytes say so. Sketches are subtracted and peeled, which recovers
    the digests that stand on one side alone; where that fails, both sides are sketched
    again with three times the cells. Likeness is 1 less the share of such digests.

    The documents are dealt into ranges of their id, and the first document of a range
    is also given to the range before it; one row per range is all that is gathered.
    Null texts count as empty, and two empty texts are alike. Null ids stand first;
    rows that share an id stand in order of a hash of their text. A lone document is
    its own next one; an empty table gives no rows. Extra columns are left aside.
    """
    ranges = shuffle_partitions(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbered, ranges = _range_number(F.col("doc_id"), plain, ranges)
    numbered = numbered.withColumn("_hash", F.xxhash64("text"))
    place = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("i"), F.col("_hash").alias("h"))
    firsts = sorted(numbered.groupBy("_range").agg(F.min(place).alias("p")).collect())  # one row per range
    before = [(*firsts[k].p, firsts[k - 1]._range) for k in range(len(firsts))]
    borders = docs.sparkSession.createDataFrame(before, "_i long, _h long, _before int")
    given = numbered.join(
        F.broadcast(borders), (F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))) == F.col("_i")) & (F.col("_hash") == F.col("_h")), "left"
    )
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("extra"))
    extra = F.struct(F.col("_before").alias("range"), F.lit(True).alias("extra"))
    dealt = given.select(
        "doc_id", "text", "_hash", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, extra))).alias("_to")
    )
    ordered = dealt.repartitionById(ranges, F.col("_to.range")).sortWithinPartitions("_to.extra", "doc_id", "_hash")
    return ordered.select("doc_id", "text", F.col("_to.extra").alias("extra")).mapInArrow(_compare(cells), _RESULT)


@query("op1_paragraph_sketches")
def op1_paragraph_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited versions, with the likeness to those and to the next."""
    return compare_versions(table(spark, sf_dir, "documents"))
