"""Removal of long repeated byte strings with run-length indexes over repeated passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.registry import query, table
from corpuscope.llm.runindex import build, matching_statistics
from corpuscope.llm.textbytes import CHUNK, Stretches, flat, row_groups
from corpuscope.session import shuffle_partitions, stored

#: Length of a repeated string, in bytes.
MIN_BYTES = 200
#: Bytes that each anchor hashes, out of the window that chooses it.
ANCHOR_BYTES = 80
#: Distinct passages around one anchor that go into one index; an anchor with more is decided window by window.
MOST_PASSAGES = 1024
#: Bytes of passages per index.
INDEX_BYTES = 1 << 18

_ANCHORS = "doc_id long, text_hash long, start int, length int, anchor long, passage long"
_PASSAGES = "anchor long, passage long, copies long, body binary, window int, window_hash long, window_check long"
_MARKS = "anchor long, passage long, starts array<int>, ends array<int>"


def _anchor_runs(data: np.ndarray, ends: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Window starts from, window starts to (inclusive) and hashes of anchors and passages of one stretch of bytes.

    ``ends`` has, for each window start, the end of its document; windows that reach
    beyond it do not count. Each window is assigned to the smallest hash of ``anchor``
    bytes in it (the first of equals), so equal windows have equal anchors at equal places.
    """
    count = len(data) - window + 1
    if count <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    stretches = Stretches(data)
    hashes = stretches.rolling(anchor)
    mask = np.uint64((1 << 20) - 1)
    least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    span, width = 1, window - anchor + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    chosen = (least & mask).astype(np.int64)
    valid = np.arange(count) + window <= ends[:count]
    chosen = np.where(valid, chosen, -1)
    new = np.concatenate([[True], chosen[1:] != chosen[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [count - 1]])
    kept = chosen[first] >= 0
    first, last = first[kept], last[kept]
    return first, last, hashes[chosen[first]], stretches.hashes(first, last + window)


def _anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for first_row, last_row in row_groups(offsets):
                begin, end = int(offsets[first_row]), int(offsets[last_row])
                lengths = np.diff(offsets[first_row : last_row + 1])
                row_ends = np.repeat(offsets[first_row + 1 : last_row + 1] - begin, lengths)
                rows = np.repeat(np.arange(first_row, last_row), lengths)
                # a document beyond the chunk size is taken in pieces that overlap by a window less one
                for at in range(0, max(1, end - begin - window + 1), CHUNK):
                    to = min(end - begin, at + CHUNK + window - 1)
                    starts, lasts, anchors, passages = _anchor_runs(
                        data[begin + at : begin + to], row_ends[at:to] - at, window, anchor
                    )
                    row = rows[at + starts] if len(starts) else np.zeros(0, dtype=np.int64)
                    taken = batch.select([0, 1]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [
                            taken.column(0),
                            taken.column(1),
                            pa.array((starts + at - (offsets[row] - begin)).astype(np.int32)),
                            pa.array((lasts - starts + window).astype(np.int32)),
                            pa.array(anchors.view(np.int64)),
                            pa.array(passages.view(np.int64)),
                        ],
                        names=["doc_id", "text_hash", "start", "length", "anchor", "passage"],
                    )

    return run


def _cut_passages(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("anchor", pa.int64()), ("passage", pa.int64()), ("copies", pa.int64()), ("body", pa.binary()),
             ("window", pa.int32()), ("window_hash", pa.int64()), ("window_check", pa.int64())]
        )
        for batch in batches:
            data, offsets = flat(batch.column(0))
            asked = batch.column(1)
            items = asked.flatten()
            rows = np.repeat(np.arange(len(batch)), np.asarray(asked.value_lengths()))
            starts = offsets[rows] + np.asarray(items.field("start"))
            ends = starts + np.asarray(items.field("length"))
            crowded = np.asarray(items.field("crowded"))
            whole = np.flatnonzero(~crowded)
            for part in np.array_split(whole, max(1, len(whole) // 4096)):
                yield pa.RecordBatch.from_arrays(
                    [items.field(name).take(pa.array(part)) for name in ("anchor", "passage", "copies")]
                    + [pa.array([data[starts[k] : ends[k]].tobytes() for k in part], pa.binary())]
                    + [pa.nulls(len(part), kind) for kind in (pa.int32(), pa.int64(), pa.int64())],
                    schema=schema,
                )
            for k in np.flatnonzero(crowded):
                body = data[starts[k] : ends[k]]
                hashes = Stretches(body).rolling(window)
                checks = Stretches(body[::-1]).rolling(window)[::-1]
                one = items.slice(k, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one.field(name)[0].as_py()] * len(hashes), pa.int64())
                     for name in ("anchor", "passage", "copies")]
                    + [pa.nulls(len(hashes), pa.binary()), pa.array(np.arange(len(hashes), dtype=np.int32)),
                       pa.array(hashes.view(np.int64)), pa.array(checks.view(np.int64).copy())],
                    schema=schema,
                )

    return run


def _index_marks(window: int):
    def marks(keys: list[tuple[int, int, int]], bodies: list[bytes]) -> pa.RecordBatch:
        index, offsets = build(bodies)
        found = matching_statistics(index) >= window
        anchors, passages, copies = (np.array(column, dtype=np.int64) for column in zip(*keys, strict=True))
        # copies of a passage match it to the end; one of them is enough for the others
        sizes = np.diff(offsets)
        room = np.repeat(offsets[1:] - 1, sizes) - np.arange(len(found))
        found |= np.repeat(copies > 1, sizes) & (room >= window)
        # a passage's end matches nothing, so no run of marks goes across it
        edges = np.flatnonzero(np.diff(np.concatenate([[False], found, [False]]).astype(np.int8)))
        starts, ends = edges[0::2], edges[1::2]
        owner = np.searchsorted(offsets, starts, side="right") - 1
        rows, bounds = np.unique(owner, return_index=True)
        bounds = pa.array(np.append(bounds, len(owner)).astype(np.int32))
        starts, ends = starts - offsets[owner], ends - offsets[owner] + window - 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(anchors[rows]),
                pa.array(passages[rows]),
                pa.ListArray.from_arrays(bounds, pa.array(starts.astype(np.int32))),
                pa.ListArray.from_arrays(bounds, pa.array(ends.astype(np.int32))),
            ],
            names=["anchor", "passage", "starts", "ends"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int, int]] = []
        bodies: list[bytes] = []
        size = 0
        for batch in batches:  # sorted by anchor and passage
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for anchor, passage, copies, body in zip(*columns, strict=True):
                if keys and keys[-1][:2] == (anchor, passage):
                    continue  # cut from a row that repeats
                if size >= INDEX_BYTES and anchor != keys[-1][0]:
                    yield marks(keys, bodies)
                    keys, bodies, size = [], [], 0
                keys.append((anchor, passage, copies))
                bodies.append(body)
                size += len(body)
        if keys:
            yield marks(keys, bodies)

    return run


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            asked = batch.column(2)
            items = asked.flatten()
            bounds = np.concatenate([[0], np.cumsum(np.asarray(asked.value_lengths().fill_null(0)))])
            at = np.asarray(items.field("start")).astype(np.int64)
            starts, ends = items.field("starts"), items.field("ends")
            per = np.asarray(starts.value_lengths())
            inner = np.concatenate([[0], np.cumsum(per)])
            shift = np.repeat(at, per)
            starts, ends = np.asarray(starts.flatten()) + shift, np.asarray(ends.flatten()) + shift
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for row in range(len(batch)):
                text = data[offsets[row] : offsets[row + 1]]
                low, high = inner[bounds[row]], inner[bounds[row + 1]]
                order = np.argsort(starts[low:high], kind="stable")
                begin, end = starts[low:high][order], np.maximum.accumulate(ends[low:high][order])
                new = np.concatenate([[True], begin[1:] > end[:-1]]) if len(begin) else np.zeros(0, dtype=bool)
                first = np.flatnonzero(new)
                span_from = begin[first]
                span_to = end[np.concatenate([first[1:] - 1, [len(begin) - 1]])] if len(first) else first
                keep_from = np.concatenate([[0], span_to])
                keep_to = np.concatenate([span_from, [len(text)]])
                kept = b"".join(text[a:b].tobytes() for a, b in zip(keep_from, keep_to, strict=True))
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(kept))
                out["n_spans"].append(len(first))
                # characters that the cuts leave incomplete go from the text
                out["kept"].append(kept.decode("utf-8", "ignore") if with_text else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(out[name], pa.int64()) for name in ("n_bytes", "n_removed", "n_spans")),
                    pa.array(out["kept"], pa.string()),
                    *(batch.column(i) for i in range(3, batch.num_columns)),
                ],
                names=["doc_id", *out, *batch.schema.names[3:]],
            )

    return run


def repeated_bytes(
    docs: DataFrame,
    min_bytes: int = MIN_BYTES,
    anchor_bytes: int = ANCHOR_BYTES,
    most_passages: int = MOST_PASSAGES,
    with_text: bool = False,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Cut every byte that is covered by a string of ``min_bytes`` bytes which also starts anywhere else.

    Matches never cross documents; the same document counts; overlaps count; what
    repeats is judged on the input. A null text counts as empty; repeated rows are
    documents of their own and so copies of each other; a null id is an id; documents below
    ``min_bytes`` keep everything. ``extra`` columns are passed on, others left aside.

    1. Every window of ``min_bytes`` bytes is assigned to an anchor: its smallest hash
       of ``anchor_bytes`` bytes. Equal windows have equal anchors. Neighbouring
       windows of one anchor form a passage. Only hashes and places are written.
    2. Anchors seen once cannot hold a repeated window. The passages of the others,
       one of each content with its number of copies, are cut from the texts.
    3. All passages of an anchor meet in one task, which builds run-length indexes
       over them and marks windows whose matching statistics reach ``min_bytes``. An
       anchor with more than ``most_passages`` distinct passages (a common sentence before many
       continuations) is not gathered: its windows are counted by a 128-bit hash.
    4. Marks go back to all copies of a passage and are cut from the texts.

    Columns: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs) and ``kept_sha256`` of the remaining bytes, or with ``with_text`` the
    remaining ``text`` without characters that a cut left incomplete; then ``extra``.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", *extra)
    key = [F.col("doc_id"), F.col("text_hash")]
    anchors = stored(keyed.select(*key, "text").mapInArrow(_anchors(min_bytes, anchor_bytes), _ANCHORS), "anchors")
    seen = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("_seen")).filter("_seen > 1")
    # written, so that the join deals both sides anew and a hot anchor's partition can be split
    seen = stored(seen.select("anchor"), "seen")
    places = stored(anchors.join(seen, "anchor", "left_semi"), "places")

    passages = places.groupBy("anchor", "passage").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_hash", "start", "length")).alias("at")
    )
    passages = stored(passages.select("anchor", "passage", "copies", "at.*"), "passages")
    crowds = passages.groupBy(F.col("anchor").alias("_anchor")).agg(F.count(F.lit(1)).alias("_passages"))
    asked = (
        passages.join(crowds.filter(F.col("_passages") > most_passages), F.col("anchor") == F.col("_anchor"), "left")
        .withColumn("crowded", F.col("_passages").isNotNull())
        .groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"))
        .agg(F.collect_list(F.struct("start", "length", "anchor", "passage", "copies", "crowded")).alias("_asked"))
    )
    same_doc = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
    once = keyed.select(*key, "text").join(asked, same_doc)
    bodies = stored(once.select("text", "_asked").mapInArrow(_cut_passages(min_bytes), _PASSAGES), "bodies")
    whole = bodies.filter("body is not null").select("anchor", "passage", "copies", "body")
    whole = whole.repartition(parts, "anchor").sortWithinPartitions("anchor", "passage")
    marks = whole.mapInArrow(_index_marks(min_bytes), _MARKS)

    windows = bodies.filter("window is not null").select(
        "anchor", "passage", "copies", "window", "window_hash", "window_check"
    ).distinct()
    window_key = ["window_hash", "window_check"]
    repeated = windows.groupBy(*window_key).agg(F.sum("copies").alias("_copies")).filter("_copies > 1")
    window_marks = (
        windows.join(repeated, window_key, "left_semi")
        .groupBy("anchor", "passage")
        .agg(F.collect_list("window").alias("starts"))
        .withColumn("ends", F.transform("starts", lambda s: (s + F.lit(min_bytes)).cast("int")))
    )
    found = (
        places.join(marks.unionByName(window_marks), ["anchor", "passage"])
        .groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"))
        .agg(F.collect_list(F.struct("start", "starts", "ends")).alias("_found"))
    )
    marked = keyed.join(found, same_doc, "left").select("doc_id", "text", "_found", *extra)
    result = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept string"
    schema = ", ".join([result, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)])
    return marked.mapInArrow(_apply(with_text), schema).withColumnRenamed("kept", "text" if with_text else "kept_sha256")


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that stand anywhere else too."""
    return repeated_bytes(table(spark, sf_dir, "documents"))
