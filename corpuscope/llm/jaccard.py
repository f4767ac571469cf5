"""N-gram Jaccard join: index lists skipped by blocks of positions, answers derived from similar sets.

Every text is the set of its word shingles. Shingles stand in one global order, rare first, and two sets
that are similar enough share one of the first shingles of both; lists of the sets by such a shingle are
the index. Sets that are close to a leading set are represented by it: what the leader shares
with another set bounds what they can share with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.components import components
from corpuscope.llm.registry import query, table
from corpuscope.llm.textbytes import flat, mixed, row_groups
from corpuscope.llm.words import LOWER, word_hashes
from corpuscope.session import passing_tables, shuffle_partitions, stored

#: Cells in which the frequency of shingles is counted, as bits of a hash; their number bounds what is gathered.
CELL_BITS = 20
#: Cells that travel together.
CELL_BLOCK = 1 << 12
#: Entries of a list from which it is cut into blocks, and positions and entries per block.
LONG_LIST = 256
BAND = 16
#: Bits of the filter that keeps texts which are not asked for from being shuffled.
FILTER_BITS = 1 << 23
FILTER_BLOCK = 1 << 16

_SHIFT = np.uint64(64 - CELL_BITS)
_LOW = np.uint64((1 << (64 - CELL_BITS)) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


@dataclass(frozen=True)
class Join:
    """Words of a shingle, and the least similarity as a fraction."""

    words: int = 4
    over: int = 85
    under: int = 100

    def overlap(self, sizes: Column) -> Column:
        """The least overlap of two similar sets, by the sum of their sizes."""
        return F.floor((sizes * self.over + (self.over + self.under - 1)) / (self.over + self.under)).cast("long")

    def rest(self, size: Column) -> Column:
        """Shingles of a set that its prefix leaves out."""
        return F.floor((size * self.over + (self.under - 1)) / self.under).cast("long") - 1

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return (F.least(a, b) * self.under) >= (F.greatest(a, b) * self.over)

    def shared_prefix(self, sizes: Column, a: Column, b: Column) -> Column:
        """The least number of shingles that the prefixes of two similar sets share; a, b: their largest sizes."""
        return F.greatest(self.overlap(sizes) - F.greatest(self.rest(a), self.rest(b)), F.lit(1))


def _shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of consecutive texts, and the row of each; a shorter text is one shingle."""
    hashes, _, _, rows = word_hashes(LOWER[data], offsets)
    if not len(hashes):
        return hashes, rows
    count = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    within = np.arange(len(rows)) - first[rows]
    left = count[rows] - within
    use = (left >= words) | (within == 0)
    at = np.flatnonzero(use)
    length = np.minimum(left[at], words)
    total = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for step in range(words):
        inside = length > step
        total[inside] += hashes[at[inside] + step] * np.uint64(pow(int(_STEP), step, 1 << 64))
    return mixed(total), rows[at]


def _sets(data: np.ndarray, offsets: np.ndarray, words: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each text in the global order, each once, and the bounds of the texts."""
    tokens, rows = _shingles(data, offsets, words)
    tokens = (places[(tokens >> _SHIFT).astype(np.int64)].astype(np.uint64) << _SHIFT) | (tokens & _LOW)
    order = np.lexsort((tokens, rows))
    tokens, rows = tokens[order], rows[order]
    if len(tokens):
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1])])
        tokens, rows = tokens[new], rows[new]
    return tokens, np.searchsorted(rows, np.arange(len(offsets)))


def _cell_counts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for first, last in row_groups(offsets):
                begin = offsets[first]
                tokens, _ = _shingles(data[begin : offsets[last]], offsets[first : last + 1] - begin, words)
                counts += np.bincount((tokens >> _SHIFT).astype(np.int64), minlength=1 << CELL_BITS)
        yield _cell_blocks(dict(enumerate(counts.reshape(-1, CELL_BLOCK))))

    return run


def _cell_blocks(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Blocks of counts in which something was seen, packed."""
    used = [number for number, counts in blocks.items() if counts.any()]
    packed = [zlib.compress(blocks[number].astype("<i8").tobytes(), 1) for number in used]
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=["block", "seen"]
    )


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), "<i8")


def _added_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[block] = sums.get(block, 0) + _unpacked(packed)
    yield _cell_blocks(sums)


def _global_order(texts: DataFrame, words: int) -> Broadcast:
    """The place of each cell, the one with the fewest shingles first, as a broadcast of 4 MB.

    A block of cells from each task is added up before all of them, some megabytes,
    are gathered.
    """
    parts = min(shuffle_partitions(texts.sparkSession), (1 << CELL_BITS) // CELL_BLOCK)
    schema = "block int, seen binary"
    counted = texts.mapInArrow(_cell_counts(words), schema).repartition(parts, "block").mapInArrow(_added_blocks, schema)
    seen = np.zeros((1 << CELL_BITS) // CELL_BLOCK * CELL_BLOCK, dtype=np.int64).reshape(-1, CELL_BLOCK)
    for row in counted.collect():  # one job; an iterator would run one for each partition
        seen[row.block] = _unpacked(row.seen)
    places = np.empty(1 << CELL_BITS, dtype=np.uint32)
    places[np.argsort(seen.reshape(-1), kind="stable")] = np.arange(1 << CELL_BITS, dtype=np.uint32)
    return texts.sparkSession.sparkContext.broadcast(places)


def _prefixes(join: Join, places: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for first, last in row_groups(offsets):
                begin = offsets[first]
                tokens, bounds = _sets(
                    data[begin : offsets[last]], offsets[first : last + 1] - begin, join.words, places.value
                )
                sizes = np.diff(bounds)
                sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
                np.cumsum(mixed(tokens ^ _STEP), out=sums[1:])
                prints = mixed(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(np.uint64))
                np.cumsum(mixed(tokens * _STEP + np.uint64(1)), out=sums[1:])
                more = mixed(sums[bounds[1:]] - sums[bounds[:-1]])
                keep = np.where(sizes > 0, sizes + (-(sizes * join.over) // join.under) + 1, 0)
                ends = np.concatenate([[0], np.cumsum(keep)])
                at = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], keep)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(sizes),
                        pa.array(prints.view(np.int64)),
                        pa.array(more.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens[at].view(np.int64))),
                    ],
                    names=["doc_id", "n", "print", "more", "prefix"],
                )

    return run


def _asked_sets(words: int, places: Broadcast, bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.asarray(batch.column(2))
            asked = np.flatnonzero((bits[slots >> 3] >> (slots & 7)) & 1)
            if not len(asked):
                continue
            batch = batch.take(pa.array(asked))
            data, offsets = flat(batch.column(1))
            for first, last in row_groups(offsets):
                begin = offsets[first]
                tokens, bounds = _sets(data[begin : offsets[last]], offsets[first : last + 1] - begin, words, places.value)
                bodies = [tokens[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(bodies, pa.binary())], names=["doc_id", "body"]
                )

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes_a, sizes_b, shared = [], [], []
        for left, right in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
            sizes_a.append(len(a))
            sizes_b.append(len(b))
            shared.append(len(np.intersect1d(a, b, assume_unique=True)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (sizes_a, sizes_b, shared))],
            names=["a", "b", "size_a", "size_b", "shared"],
        )


def _extras(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the second set of each pair has and the first lacks."""
    for batch in batches:
        sizes, extras = [], []
        for left, right in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
            sizes.append((len(a), len(b)))
            extras.append(np.setdiff1d(b, a, assume_unique=True).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                *(pa.array([s[i] for s in sizes], pa.int64()) for i in (0, 1)),
                pa.array([s[1] - len(e) for s, e in zip(sizes, extras, strict=True)], pa.int64()),
                pa.array(extras, pa.list_(pa.int64())),
            ],
            names=["a", "b", "size_a", "size_b", "shared", "extras"],
        )


def _list_pairs(join: Join):
    """Pairs of a tile whose first shared shingle may be that of the list.

    Similar sets x and y share at least ``overlap`` shingles, so the first one that they share stands
    no further back in x than at the size of x less that, and likewise in y. In all other lists the pair need not be put
    out again.
    """
    fields = ("lead", "comp", "low", "high", "first", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                left, right = batch.column(0)[k].values, batch.column(1)[k].values
                a = {name: np.asarray(left.field(name))[:, None] for name in fields}
                b = {name: np.asarray(right.field(name))[None] for name in fields}
                keep = (a["comp"] != b["comp"]) & (a["low"] * join.over <= b["high"] * join.under)
                keep &= b["low"] * join.over <= a["high"] * join.under
                # what stands between the two positions is in one of the sets alone
                gap = np.maximum(np.maximum(a["first"] - b["last"], b["first"] - a["last"]), 0)
                overlap = -(-(a["low"] + b["low"]) * join.over // (join.over + join.under))
                keep &= np.maximum(a["high"], b["high"]) - gap >= overlap
                keep &= (a["first"] <= a["high"] - overlap) & (b["first"] <= b["high"] - overlap)
                if batch.column(2)[k].as_py():  # a block with itself
                    keep &= a["lead"] < b["lead"]
                i, j = np.nonzero(keep)
                x, y = a["lead"][i, 0], b["lead"][0, j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def _filter_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the filter that a task's slots set, in blocks."""
    bits: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, slots in _by_block(np.asarray(batch.column(0))):
            bits.setdefault(block, np.zeros(FILTER_BLOCK // 8, dtype=np.uint8))
            np.bitwise_or.at(bits[block], slots >> 3, np.uint8(1) << (slots & 7).astype(np.uint8))
    yield _packed_blocks(bits)


def _by_block(slots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for block in np.unique(slots // FILTER_BLOCK).tolist():
        yield block, slots[slots // FILTER_BLOCK == block] % FILTER_BLOCK


def _joined_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
            bits[block] = bits[block] | own if block in bits else own
    yield _packed_blocks(bits)


def _packed_blocks(bits: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(bits), pa.int32()), pa.array([zlib.compress(b.tobytes(), 1) for b in bits.values()], pa.binary())],
        names=["block", "bits"],
    )


class _Texts:
    """The sets of some documents, worked out from their texts when they are asked for."""

    def __init__(self, docs: DataFrame, join: Join, places: Broadcast):
        self._docs, self._join, self._places = docs, join, places

    def _asked(self, ids: DataFrame) -> DataFrame:
        """``doc_id``, ``body`` for the ids; a bit filter of fixed size holds back most other texts before the shuffle."""
        slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
        blocks = FILTER_BITS // FILTER_BLOCK
        parts = min(shuffle_partitions(ids.sparkSession), blocks)
        schema = "block int, bits binary"
        packed = ids.select(slot.alias("s")).mapInArrow(_filter_blocks, schema).repartition(parts, "block")
        bits = np.zeros((blocks, FILTER_BLOCK // 8), dtype=np.uint8)
        for row in packed.mapInArrow(_joined_blocks, schema).collect():  # one row per block, in one job
            bits[row.block] = np.frombuffer(zlib.decompress(row.bits), dtype=np.uint8)
        found = self._docs.select(
            "doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("slot")
        ).mapInArrow(_asked_sets(self._join.words, self._places, bits.reshape(-1)), "doc_id long, body binary")
        return found.join(ids, F.col("doc_id") == F.col("id"), "left_semi")

    def compared(self, pairs: DataFrame, extras: bool = False) -> DataFrame:
        """``a``, ``b``, ``size_a``, ``size_b``, ``shared`` for pairs ``a``, ``b`` of ids; and what b has beyond a."""
        pairs = stored(pairs.select("a", "b").distinct(), "pairs")
        ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
        bodies = stored(self._asked(ids), "sets")
        full = (
            pairs.join(bodies.select(F.col("doc_id").alias("a"), F.col("body").alias("body_a")), "a")
            .join(bodies.select(F.col("doc_id").alias("b"), F.col("body").alias("body_b")), "b")
            .select("a", "b", "body_a", "body_b")
        )
        schema = "a long, b long, size_a long, size_b long, shared long"
        if extras:
            return stored(full.mapInArrow(_extras, f"{schema}, extras array<long>"), "extras")
        return stored(full.mapInArrow(_overlaps, schema), "overlaps")


def _leaders(lists: DataFrame, join: Join) -> DataFrame:
    """For each set the leader that it shares most prefix shingles with, if these are enough: ``a``, ``b``.

    The leader of a list is the set whose own lists are longest in all: among near copies, the
    one that the others were made from.
    """
    weight = lists.groupBy("cid").agg(F.sum("seen").alias("weight"))
    weighted = lists.join(weight, "cid")
    first = weighted.groupBy("token").agg(F.max(F.struct("weight", (-F.col("cid")).alias("c"), "n")).alias("lead"))
    first = first.select("token", (-F.col("lead.c")).alias("lead"), F.col("lead.n").alias("lead_n"))
    chosen = weighted.join(first, "token").filter((F.col("cid") != F.col("lead")) & join.sizes_fit(F.col("n"), F.col("lead_n")))
    counted = chosen.groupBy("cid", "lead", "n", "lead_n").agg(F.count(F.lit(1)).alias("shared"))
    enough = counted.filter(F.col("shared") >= join.shared_prefix(F.col("n") + F.col("lead_n"), F.col("n"), F.col("lead_n")))
    best = enough.groupBy("cid").agg(F.max(F.struct("shared", (-F.col("lead")).alias("l"))).alias("best"))
    return best.select(F.col("cid").alias("a"), (-F.col("best.l")).alias("b"))


def _similar(compared: DataFrame, join: Join) -> DataFrame:
    union = F.col("size_a") + F.col("size_b") - F.col("shared")
    return compared.filter((F.col("shared") * join.under >= union * join.over) & (F.col("shared") > 0))


def _list_tiles(entries: DataFrame, join: Join) -> DataFrame:
    """Pairs of blocks of each list that may hold similar sets of different components.

    A long list is cut by position, and by a hash where many sets share positions, so that
    no task gets more than some hundred entries of a list at a time. Blocks whose positions or sizes
    lie too far apart are skipped whole.
    """
    crowd = F.ceil(F.col("k") / LONG_LIST).cast("int")
    band = F.when(crowd > 1, F.floor(F.col("first") / BAND)).otherwise(0).cast("long")
    salt = F.pmod(F.xxhash64("lead"), crowd)
    blocks = (
        entries.withColumns({"band": band, "salt": salt})
        .groupBy("token", "band", "salt")
        .agg(
            F.collect_list(F.struct("lead", "comp", "low", "high", "first", "last")).alias("sets"),
            *(F.min(c).alias(f"min_{c}") for c in ("comp", "low", "first")),
            *(F.max(c).alias(f"max_{c}") for c in ("comp", "high", "last")),
        )
    )
    blocks = stored(blocks, "blocks")
    other = blocks.select("token", *(F.col(c).alias(f"o_{c}") for c in blocks.columns if c != "token"))
    place, o_place = F.struct("band", "salt"), F.struct("o_band", "o_salt")
    gap = F.greatest(F.col("min_first") - F.col("o_max_last"), F.col("o_min_first") - F.col("max_last"), F.lit(0))
    least = (F.col("min_low") + F.col("o_min_low")) * join.over / (join.over + join.under)
    possible = (
        (place <= o_place)
        & ((F.least("min_comp", "o_min_comp") != F.greatest("max_comp", "o_max_comp")))
        & (F.col("min_low") * join.over <= F.col("o_max_high") * join.under)
        & (F.col("o_min_low") * join.over <= F.col("max_high") * join.under)
        & (F.greatest("max_high", "o_max_high") - gap >= least)
        & (F.col("min_first") <= F.col("max_high") - least)
        & (F.col("o_min_first") <= F.col("o_max_high") - least)
    )
    tiles = blocks.join(other, "token").filter(possible)
    return tiles.select("sets", F.col("o_sets"), (place == o_place).alias("same"))


def _derived(apart: DataFrame, members: DataFrame, groups: DataFrame, texts: _Texts, join: Join) -> DataFrame:
    """Similar pairs of followers, or of a leader and a follower, of leaders that are not similar: ``a``, ``b``.

    Followers x of a and y of b share at most what a and b share, and what a and b lack of
    them; pairs of leaders are kept if this bound allows any. Followers that a leader lacks
    nothing of are smaller than it, so they may be similar where the leaders are not; only two leaders
    without any follower are left aside. Of the two let a be the one whose
    followers are further away. Each y is compared with a. A follower x of a then shares
    with y at most what a shares, and those of its own shingles that a lacks and y has. So x and y are compared
    themselves only if what a shares is enough for the size of x, or if x and y have
    enough shingles in common that a lacks, which short lists of these few tell.
    """

    def of(side: str) -> DataFrame:
        return groups.select(F.col("lead").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("low", "lack", "sets")))

    near = apart.select("a", "b", "shared").join(of("a"), "a").join(of("b"), "b")
    reach = F.col("shared") + F.col("lack_a") + F.col("lack_b")
    low = join.overlap(F.col("low_a") + F.col("low_b"))
    near = near.filter(((F.col("sets_a") > 1) | (F.col("sets_b") > 1)) & (reach >= low))
    turn = F.col("lack_a") < F.col("lack_b")
    near = near.select(
        F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("lead")
    )
    near = stored(near, "near")
    crossed = near.join(members.select("lead", "cid"), "lead").select("a", F.col("cid").alias("b"))
    met = texts.compared(crossed, extras=True)  # leader a, and y with its extras
    direct = _similar(met, join).select("a", "b")

    far = met.join(direct, ["a", "b"], "left_anti").select(
        "a", F.col("b").alias("y"), F.col("size_b").alias("n_y"), F.col("shared").alias("common"), "extras"
    )
    far = stored(far, "far")
    own = members.join(near.select(F.col("a").alias("lead")).distinct(), "lead", "left_semi").filter("cid <> lead")
    own = stored(own.select(F.col("lead").alias("a"), F.col("cid").alias("b")), "own")
    x = texts.compared(own, extras=True).select(
        "a", F.col("b").alias("x"), F.col("size_b").alias("n_x"), F.col("extras").alias("own")
    )
    x = stored(x, "followers")
    least = join.overlap(F.col("n_x") + F.col("n_y"))
    fit = join.sizes_fit(F.col("n_x"), F.col("n_y"))
    enough = x.select("a", "x", "n_x").join(far.select("a", "y", "n_y", "common"), "a").filter((F.col("common") >= least) & fit)
    few = x.select("a", "x", "n_x", F.explode("own").alias("token"))
    theirs = far.select("a", "y", "n_y", "common", F.explode("extras").alias("token"))
    gained = few.join(theirs, ["a", "token"]).groupBy("a", "x", "y", "n_x", "n_y", "common").agg(
        F.count(F.lit(1)).alias("gain")
    )
    gained = gained.filter((F.col("common") + F.col("gain") >= least) & fit)
    pairs = enough.select("x", "y").union(gained.select("x", "y")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return direct.union(_similar(texts.compared(pairs), join).select("a", "b"))


def similar_sets(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """Components of documents whose sets of word shingles are similar: ``doc_id``, ``n_shingles``, ``component_id``.

    A word is a run without white space, A-Z in lower case; a text with fewer words than
    a shingle is one shingle as a whole. Documents without words (null, empty, white
    space) have an empty set and link with nothing. Documents are linked if over /
    under of the union is shared, counted in whole numbers; ``component_id`` is the
    least id reachable. Rows that share an id are one document; a row with a null id links
    with nothing and has a null component. Extra columns are left aside.

    1. Shingles are counted in a million cells, which gives the global order.
    2. Equal sets are one class, so copies cost one set. The prefix of a class goes to the lists of its shingles;
       lists of one class are dropped.
    3. Each class is compared with its leader, the list head it shares most with.
       Those similar to a leader follow it, at the known distance of what it lacks.
    4. In every list, pairs of leaders of different components are candidates if sizes,
       positions allow it, and if this list may be the first that they share; whole blocks are
       skipped by these. They are compared with each other in full.
    5. Followers of leaders that are not similar: see :func:`_derived`.
    """
    with passing_tables(docs.sparkSession) as keep:
        plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        places = _global_order(plain.select("text"), join.words)

        sets = stored(plain.mapInArrow(_prefixes(join, places), "doc_id long, n long, print long, more long, prefix array<long>"), "sets")
        known = sets.filter("n > 0 and doc_id is not null")
        classes = known.groupBy("print", "more", "n").agg(F.min("doc_id").alias("cid"))
        classes = stored(classes, "classes")
        own = known.join(classes.select(F.col("cid").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["print", "more", "n"])
        postings = stored(own.select(F.col("doc_id").alias("cid"), "n", F.posexplode("prefix").alias("pos", "token")), "postings")
        common = postings.groupBy("token").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1")
        lists = stored(postings.join(common, "token"), "lists")

        texts = _Texts(plain, join, places)
        close = _similar(texts.compared(_leaders(lists, join)), join)
        follows = close.join(close.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
        follows = stored(
            follows.groupBy("a").agg(F.min(F.struct((F.col("size_a") - F.col("shared")).alias("lack"), "b")).alias("to"))
            .select(F.col("a").alias("cid"), F.col("to.b").alias("lead"), F.col("to.lack").alias("lack")),
            "follows",
        )
        reached = stored(components(close.select("a", "b")), "reached")

        members = (
            lists.select("cid", "n").distinct()
            .join(follows, "cid", "left")
            .join(reached, F.col("cid") == F.col("id"), "left")
            .select(
                "cid", "n", F.coalesce("lead", "cid").alias("lead"), F.coalesce("lack", F.lit(0)).alias("lack"),
                F.coalesce("component_id", "cid").alias("comp"),
            )
        )
        members = stored(members, "members")
        groups = members.groupBy("lead").agg(
            F.min("comp").alias("comp"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("lack").alias("lack"),
            F.count(F.lit(1)).alias("sets"),
        )
        groups = stored(groups, "groups")
        entries = (
            lists.join(members.select("cid", "lead"), "cid")
            .groupBy("token", "lead")
            .agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
            .join(groups.drop("lack", "sets"), "lead")
        )
        entries = stored(entries, "entries")
        several = entries.groupBy("token").agg(
            F.count(F.lit(1)).alias("k"), F.min("comp").alias("_least"), F.max("comp").alias("_most")
        )
        several = several.filter(F.col("_least") != F.col("_most")).select("token", "k")
        tiles = _list_tiles(entries.join(several, "token"), join)
        compared = texts.compared(tiles.mapInArrow(_list_pairs(join), "a long, b long"))
        linked = _similar(compared, join)
        apart = compared.join(linked.select("a", "b"), ["a", "b"], "left_anti")
        derived = _derived(apart, members, groups, texts, join)

        edges = close.select("a", "b").union(linked.select("a", "b")).union(derived.select("a", "b"))
        reached = components(edges)
        of_class = classes.join(reached, F.col("cid") == F.col("id"), "left").select(
            "print", "more", "n", F.coalesce("component_id", "cid").alias("component_id")
        )
        whole = sets.join(of_class, ["print", "more", "n"], "left").select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        # three numbers a row; all else that was written on the way can go
        whole = stored(whole, "joined")
        keep(whole)
    return whole


@query(
    "op9_shingle_join",
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
        FROM words, unnest(range(1, greatest(len(w) - 2, 2))) AS t(i) WHERE len(w) > 0
    ), sizes AS (
        SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
    ), shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s)
        WHERE a.doc_id <> b.doc_id GROUP BY ALL
    ), links AS (
        SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
        WHERE 100 * c >= 85 * (x.n + y.n - c)
    ), reach AS (
        SELECT doc_id AS id, doc_id AS other FROM documents
        UNION
        SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a
    )
    SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
    FROM documents LEFT JOIN sizes USING (doc_id)
        JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) ON documents.doc_id = id
    """,
)
def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 percent of their shingles of four words."""
    return similar_sets(table(spark, sf_dir, "documents"), Join(4, 85, 100))
