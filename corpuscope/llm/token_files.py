"""Token ids of documents, written as patched frame-of-reference segments in order of id and read back."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.llm.pfor import Segment, write_segment
from corpuscope.llm.pretokens import WORDS, pretokenizer
from corpuscope.llm.registry import query, table
from corpuscope.llm.textbytes import flat, row_groups
from corpuscope.session import scratch_path, shuffle_partitions

#: Ids after which a segment is closed; a document is never split.
SEGMENT_IDS = 1 << 18
#: The id behind each document.
END_ID = 1
#: Words, and pieces of simple texts, that a Python worker remembers; beyond, it starts anew.
REMEMBERED = 900_000

#: Bytes of text that are encoded together; a larger text stands alone.
_GROUP = 1 << 21

_SEGMENTS = "part int, segment int, before long, n_ids long, payload binary"


class LibraryWords:
    """Ids of words and pieces by the tokenizers library, as little-endian bytes, remembered up to a bound."""

    def __init__(self, path: str):
        self._cut = pretokenizer(path)
        self._model = self._cut.tokenizer.model
        self.ids: dict[str, bytes] = {}
        self._piece_ids: dict[str, bytes] = {}
        self._simple_ids: dict[bytes, bytes] = {}

    def _model_ids(self, spelled: str) -> bytes:
        ids = [token.id for token in self._model.tokenize(spelled)]
        return pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str | int) -> bytes:
        if not isinstance(piece, str):
            return np.array([piece], "<u4").tobytes()
        known = self._piece_ids.get(piece)
        if known is None:
            known = self._piece_ids[piece] = self._model_ids(piece)
        return known

    def learn(self, words: set[str]) -> None:
        """Have the ids of all these words at hand."""
        known = self.ids
        new = [word for word in words if word not in known]
        if len(known) + len(new) > REMEMBERED:
            self.ids, self._piece_ids, new = {}, {}, list(words)
        for word in new:
            self.ids[word] = b"".join(map(self._piece, self._cut.pieces(word)))

    def _simple(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces of simple texts."""
        found = list(map(self._simple_ids.get, pieces))
        new = [number for number, ids in enumerate(found) if ids is None]
        if len(self._simple_ids) + len(new) > REMEMBERED:
            self._simple_ids = {}
        for number in new:
            ids = self._model_ids(self._cut.spelled_bytes(pieces[number]))
            found[number] = self._simple_ids[pieces[number]] = ids
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; a piece that many texts hold is looked up once for all of them."""
        pieces, bounds, left_out = self._cut.simple_pieces(texts)
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()
        found = self._simple(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        counts = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], counts) + np.arange(ends[-1])
        out, row_ends = ids[at], ends[bounds]
        encoded = [out[a:b].tobytes() for a, b in itertools.pairwise(row_ends[: len(texts) + 1])]
        for row in left_out:
            words = WORDS.findall(texts[row].decode())
            self.learn(set(words))
            encoded[row] = b"".join(map(self.ids.__getitem__, words))
        return encoded


@lru_cache(maxsize=2)
def library_words(path: str) -> LibraryWords:
    """One for each file and Python worker."""
    return LibraryWords(path)


def _encoded(words: LibraryWords, column: pa.Array) -> Iterator[bytes]:
    """The ids of each text of a column, some texts at a time; null is empty."""
    data, offsets = flat(column)
    for first, last in row_groups(offsets, _GROUP):
        yield from words.encode([data[a:b].tobytes() for a, b in itertools.pairwise(offsets[first : last + 1])])


def _segments(path: str, end: bytes, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = library_words(path)
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        parts: list[bytes] = []
        size = before = number = 0

        def closed(part: int) -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            payload = write_segment(doc_ids, lengths, ids)
            columns = [[part], [number], [before], [len(ids)], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["part", "segment", "before", "n_ids", "payload"],
            )

        part = 0
        for batch in batches:
            part = batch.column(2)[0].as_py() if len(batch) else part
            for doc_id, ids in zip(batch.column(0).to_pylist(), _encoded(words, batch.column(1)), strict=True):
                ids += end
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                size += len(ids) // 4
                if size >= segment_ids:
                    yield closed(part)
                    before, number, size = before + size, number + 1, 0
                    doc_ids, lengths, parts = [], [], []
        if doc_ids:
            yield closed(part)

    return run


def write_token_files(
    docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS
) -> None:
    """Encode every whole text and write the ids, in ascending document id, as segments below ``folder``.

    Documents are dealt into ranges of their id and encoded in order; a range is cut
    into segments (``corpuscope.llm.pfor``) of about ``segment_ids`` ids, never within
    a document. Spark commits the files, so a lost executor leaves none half written:
    each is a Parquet container with a row per segment (``part``, ``segment``, ids
    ahead in the part, ids, payload). ``end_id`` follows each document. A null text
    counts as empty and has the end id alone; null ids come first; rows that share an
    id stand in order of a hash of their text; an empty table gives no segment.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    parts = shuffle_partitions(docs.sparkSession)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    end = np.array([end_id], "<u4").tobytes()
    ordered.mapInArrow(_segments(path, end, segment_ids), _SEGMENTS).write.parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ahead, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            segment = Segment(payload.as_py())
            ids = segment.ids().astype("<u4")
            bounds = segment.bounds
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(segment.doc_ids, pa.int64()),
                    pa.array(bounds[:-1] + ahead),
                    pa.array(np.diff(bounds)),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """What the segments hold, per document: ``doc_id``, ``start`` (ids ahead of it), ``n_tokens``, ``ids_crc32``."""
    segments = spark.read.schema(_SEGMENTS).parquet(folder)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("_ids").over(ahead), F.lit(0)).alias("_ahead"))
    # one row per range: the number of ranges bounds what is broadcast
    placed = segments.join(F.broadcast(starts), "part")
    return placed.select((F.col("_ahead") + F.col("before")).alias("ahead"), "payload").mapInArrow(
        _documents, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


@query("op5_token_segments")
def op5_token_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, written as segments and read back."""
    folder = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder)
