"""Ranked lexical search: bit-sliced Bloom signatures give upper bounds, what they cannot exclude is scored exactly.

Documents stand in blocks. A block has one bitmap (slice) for each bit of a Bloom filter, with one
bit for each document. A term of a document sets its bits once for every power of two that its
occurrences reach, so the slices overestimate both which documents hold a term and how often.
Weighted sums over the slices of a query's terms bound the score of all documents of a block at once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.llm.registry import query, table
from corpuscope.llm.textbytes import mixed
from corpuscope.session import stored

#: Documents returned for each query.
TOP = 20
#: Bits of a document's filter for each of its keys at least (a power of two at most twice as large), and bits set per key.
BITS_PER_KEY = 8
HASHES = 3
#: Powers of two that occurrences are told apart by; the last one is bounded by the document's length.
LEVELS = 12
#: Documents and bits of a block at most; a document of more bits is a block of its own.
BLOCK = 512
BLOCK_BITS = 1 << 23
#: Keys that a task holds until it cuts them into blocks.
HELD_KEYS = 1 << 20
#: Queries that are asked together, and the bytes of their texts (one query of more is asked alone).
ASKED = 1000
ASKED_BYTES = 4 << 20

#: Bytes of a term: ASCII letters and digits, and all of a character beyond ASCII.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes of a text that are split at a time.
_PIECE = 1 << 20

_INDEX = "width int, keys binary, sizes binary, slices binary"


def term_counts(text: bytes) -> Counter[bytes]:
    """How often each term stands in a text: runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    if len(text) <= _PIECE:
        return Counter(_TERM.findall(text.lower()))
    counts: Counter[bytes] = Counter()
    at = 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        if end < len(text) and _TERM.match(text, end - 1):  # the piece ends within a term, which it takes whole
            end = _TERM.match(text, end - 1).end()
        counts.update(_TERM.findall(text[at:end].lower()))
        at = end
    return counts


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def _places(hashes: np.ndarray, levels: np.ndarray, width: int) -> list[np.ndarray]:
    """The bits of keys (a term's hash and a level) in a filter of ``width`` bits, a power of two."""
    base = mixed(hashes.astype(np.uint64) + (levels.astype(np.uint64) << np.uint64(32)))
    step = mixed(base + np.uint64(1)) | np.uint64(1)
    return [((base + np.uint64(i) * step) & np.uint64(width - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class _Signed:
    """One document: its row key, number of terms, and the keys that its filter holds."""

    key: int
    size: int
    hashes: np.ndarray
    levels: np.ndarray

    @property
    def width(self) -> int:
        return 1 << max(6, (len(self.hashes) * BITS_PER_KEY - 1).bit_length())


def _signed(key: int, text: bytes) -> _Signed | None:
    counts = term_counts(text)
    if not counts:
        return None
    hashes = np.fromiter(map(crc32, counts), dtype=np.uint32, count=len(counts))
    often = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    top = np.minimum(np.frexp(often)[1], LEVELS)  # the highest l with 2^(l-1) <= often
    levels = np.concatenate([np.full(int((top >= level).sum()), level) for level in range(1, int(top.max()) + 1)])
    hashes = np.concatenate([hashes[top >= level] for level in range(1, int(top.max()) + 1)])
    return _Signed(key, int(often.sum()), hashes, levels)


def _blocks(held: list[_Signed]) -> Iterator[pa.RecordBatch]:
    """Documents with filters of one width, cut into blocks of sliced bitmaps."""
    held = sorted(held, key=lambda d: d.width)
    first = 0
    while first < len(held):
        width = held[first].width
        most = min(BLOCK, max(1, BLOCK_BITS // width))
        last = first
        while last < len(held) and last - first < most and held[last].width == width:
            last += 1
        members = held[first:last]
        bits = np.zeros((width, -(-len(members) // 8)), dtype=np.uint8)
        for number, doc in enumerate(members):
            mark = np.uint8(128 >> (number & 7))
            for place in _places(doc.hashes, doc.levels, width):
                bits[place, number >> 3] |= mark  # repeated places set the same bit
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([width], pa.int32()),
                pa.array([np.array([d.key for d in members], "<i8").tobytes()], pa.binary()),
                pa.array([np.array([d.size for d in members], "<i8").tobytes()], pa.binary()),
                pa.array([bits.tobytes()], pa.binary()),
            ],
            names=["width", "keys", "sizes", "slices"],
        )
        first = last


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[_Signed] = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
            doc = _signed(key, text)
            if doc is None:
                continue
            held.append(doc)
            size += len(doc.hashes)
            if size >= HELD_KEYS:
                yield from _blocks(held)
                held, size = [], 0
    yield from _blocks(held)


def row_key() -> F.Column:
    """What a row is found again by: equal rows share it, and rows that share it by chance are all scored."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")


def build_index(docs: DataFrame) -> DataFrame:
    """Blocks of bit-sliced signatures of every document with a term: ``width``, ``keys``, ``sizes``, ``slices``.

    One scan without a shuffle. A filter has eight to sixteen bits for each of the document's keys, so long
    documents are not bounded worse than short ones; documents of one width share a block.
    """
    return docs.select(row_key().alias("key"), "text").mapInArrow(_indexed, _INDEX)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [np.frombuffer(s, "<i8") for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(s) for s in sizes], pa.int64()), pa.array([int(s.sum()) for s in sizes], pa.int64())],
            names=["docs", "terms"],
        )


@dataclass
class Queries:
    """Some queries: the terms of each with their numbers of repeats, and what the corpus says of the terms."""

    names: list[int]
    terms: list[Counter[bytes]]
    weights: dict[bytes, int]
    docs: int = 0
    length: int = 0

    def share(self, sizes: np.ndarray) -> np.ndarray:
        """The number m of documents with so many terms."""
        return 75 + (25 * sizes * self.docs) // max(self.length, 1)

    def score(self, counts: Counter[bytes], number: int) -> int:
        size = sum(counts.values())
        m = 75 + (25 * size * self.docs) // max(self.length, 1)
        score = 0
        for term, repeats in self.terms[number].items():
            often = counts.get(term, 0)
            if often:
                score += repeats * self.weights[term] * ((1_000_000_000 * often) // (1000 * often + 12 * m))
        return score


def _document_counts(vocabulary: dict[bytes, int]):
    """How many documents of a task hold each term of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(vocabulary), dtype=np.int64)
        known = vocabulary.keys()
        for batch in batches:
            for text in _texts(batch.column(0)):
                if len(text) <= _PIECE:
                    found = known & set(_TERM.findall(text.lower()))
                else:
                    found = known & term_counts(text).keys()
                counts[[vocabulary[term] for term in found]] += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], names=["term", "seen"])

    return run


class _Bounds:
    """Upper bounds of the scores that the documents of a block can have."""

    def __init__(self, queries: Queries):
        self._queries = queries
        terms = sorted(term for term, weight in queries.weights.items() if weight > 0)
        place = {term: i for i, term in enumerate(terms)}
        self._hashes = np.array([crc32(term) for term in terms], dtype=np.uint32)
        self._weights = np.array([queries.weights[term] for term in terms], dtype=np.int64)
        asked = [[(place[t], n) for t, n in terms_of.items() if t in place] for terms_of in queries.terms]
        self._asked = [(np.array([p for p, _ in a], dtype=np.int64), np.array([n for _, n in a], dtype=np.int64)) for a in asked]

    def of(self, width: int, sizes: np.ndarray, slices: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """For each query its number and the bounds of all documents."""
        bits = np.frombuffer(slices, dtype=np.uint8).reshape(width, -1)
        docs = len(sizes)
        level = np.zeros((len(self._hashes), docs), dtype=np.int8)
        open_terms = np.arange(len(self._hashes))
        held = None
        for number in range(1, LEVELS + 1):
            places = _places(self._hashes[open_terms], np.full(len(open_terms), number), width)
            here = reduce(np.bitwise_and, (bits[p] for p in places))
            if held is not None:
                here &= held
            some = here.any(axis=1)
            open_terms, held = open_terms[some], here[some]
            if not len(open_terms):
                break
            level[open_terms] += np.unpackbits(held, axis=1, count=docs).view(np.int8)
        m = self._queries.share(sizes)
        often = np.zeros((LEVELS + 1, docs), dtype=np.int64)
        for number in range(1, LEVELS + 1):
            often[number] = np.minimum((1 << number) - 1, sizes) if number < LEVELS else sizes
        gain = (1_000_000_000 * often) // (1000 * often + 12 * m)
        columns = np.arange(docs)[None]
        for query_number, (places, repeats) in enumerate(self._asked):
            if len(places):
                worth = (self._weights[places] * repeats)[:, None] * gain[level[places], columns]
                yield query_number, worth.sum(axis=0)


def _best_bounds(queries: Queries, top: int):
    """For each query the documents of a task with the highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _Bounds(queries)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width, keys, sizes, slices in _index_rows(batches):
            for number, bound in bounds.of(width, sizes, slices):
                use = np.argsort(-bound, kind="stable")[:top]
                use = use[bound[use] > 0]
                if number in best:
                    worth = np.concatenate([best[number][0], bound[use]])
                    named = np.concatenate([best[number][1], keys[use]])
                else:
                    worth, named = bound[use], keys[use]
                order = np.argsort(-worth, kind="stable")[:top]
                best[number] = worth[order], named[order]
        for number, (worth, named) in best.items():
            if len(worth):
                yield _numbered(number, named, worth)

    return run


def _within_reach(queries: Queries, least: dict[int, int]):
    """For each query all documents whose bound reaches the query's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _Bounds(queries)
        for width, keys, sizes, slices in _index_rows(batches):
            for number, bound in bounds.of(width, sizes, slices):
                use = np.flatnonzero(bound >= max(least.get(number, 1), 1))
                if len(use):
                    yield _numbered(number, keys[use], bound[use])

    return run


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
    for batch in batches:
        for k in range(len(batch)):
            width, keys, sizes, slices = (batch.column(i)[k] for i in range(4))
            yield width.as_py(), np.frombuffer(keys.as_py(), "<i8"), np.frombuffer(sizes.as_py(), "<i8"), slices.as_py()


def _numbered(number: int, keys: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(keys), number), pa.int32()), pa.array(keys), pa.array(bound)], names=["query", "key", "bound"]
    )


def _scored(queries: Queries):
    """Exact scores of a row for the queries that it is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, scores = [], [], []
            texts = _texts(batch.column(1))
            for doc_id, text, asked in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
                counts = term_counts(text)
                for number in asked:
                    ids.append(doc_id)
                    numbers.append(number)
                    scores.append(queries.score(counts, number))
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), pa.array(ids, batch.schema.field(0).type), pa.array(scores, pa.int64())],
                names=["query", "doc_id", "score"],
            )

    return run


def _exact(docs: DataFrame, wanted: DataFrame, queries: Queries) -> DataFrame:
    """``query``, ``doc_id``, ``score`` of every row whose key is asked for by some query."""
    asked = wanted.groupBy("key").agg(F.collect_set("query").alias("asked"))  # at most ASKED numbers
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", row_key().alias("_key")).join(asked, F.col("_key") == F.col("key"))
    return rows.select("doc_id", "text", "asked").mapInArrow(_scored(queries), f"query int, doc_id {kind}, score long")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """The rows of the highest scores for each query, equal ones by id (null first), with their rank."""
    place = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return scored.filter("score > 0").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)


def _asked_together(items: DataFrame) -> Iterator[list[tuple[int, Counter[bytes]]]]:
    """The queries in groups of bounded size; repeated ids are queries of their own."""
    group: list[tuple[int, Counter[bytes]]] = []
    size = 0
    for row in items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        text = (row.text or "").encode()
        if group and (len(group) >= ASKED or size + len(text) > ASKED_BYTES):
            yield group
            group, size = [], 0
        group.append((row.item_id, term_counts(text)))
        size += len(text)
    if group:
        yield group


def _weighed(docs: DataFrame, terms: Iterable[bytes], count: int) -> dict[bytes, int]:
    """The weight of each term: by the number of documents that hold it."""
    vocabulary = {term: i for i, term in enumerate(sorted(terms))}
    found = docs.select("text").mapInArrow(_document_counts(vocabulary), "term int, seen long")
    seen = {row.term: row.seen for row in found.groupBy("term").agg(F.sum("seen").alias("seen")).collect()}
    return {t: math.floor(1000 * math.log((2 * count + 2) / (2 * seen.get(i, 0) + 1))) for t, i in vocabulary.items()}


def search(docs: DataFrame, items: DataFrame, top: int = TOP, index: DataFrame | None = None) -> DataFrame:
    """The ``top`` documents of the highest score for each item: ``item_id``, ``rank``, ``doc_id``, ``score``.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; ``index`` is what
    :func:`build_index` made of the same documents, if it is at hand. All sums are 64-bit integers.

    1. The slices bound the score of every document for every item; for each item the
       documents of the ``top`` highest bounds are scored exactly, which gives a threshold that the ``top`` best reach.
    2. Every document whose bound reaches the threshold is scored exactly too. None is
       left aside but those whose bound proves that they cannot be among the best.

    Items are asked in groups of bounded size, so what a task and the driver hold of them does not grow
    with their number; what the driver holds of a group is its terms and a threshold for each item.

    Null and empty texts hold no term: as documents they are never returned and do not count, as
    items they have no rows. Rows that share an id, equal ones too, are documents of their own, and items
    likewise; ids may be null and stand first among equal scores. Extra columns are left aside.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    index = stored(build_index(docs), "signatures") if index is None else index
    totals = index.select("sizes").mapInArrow(_totals, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    count, length = totals[0] or 0, totals[1] or 0

    results = []
    for group in _asked_together(items):
        terms = {term for _, counts in group for term in counts}
        queries = Queries([n for n, _ in group], [c for _, c in group], _weighed(docs, terms, count), count, length)
        bounded = "query int, key long, bound long"
        seeds = index.mapInArrow(_best_bounds(queries, top), bounded)
        first = W.partitionBy("query").orderBy(F.col("bound").desc(), "key")
        seeds = seeds.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= top)
        best = _ranked(_exact(docs, stored(seeds.select("query", "key"), "seeds"), queries), top)
        # the score that enough documents reach; fewer with a score leave every document in reach
        reached = best.groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found"))
        least = {row.query: row.least for row in reached.filter(F.col("found") >= top).collect()}  # one row per item
        wanted = stored(index.mapInArrow(_within_reach(queries, least), bounded).select("query", "key"), "in_reach")
        names = spark.createDataFrame(
            pa.table({"query": pa.array(range(len(group)), pa.int32()), "item_id": pa.array(queries.names, pa.int64())})
        )
        ranked = _ranked(_exact(docs, wanted, queries), top)
        found = ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")
        results.append(stored(found, "ranked"))
    if not results:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id long, rank int, doc_id {kind}, score long")
    return reduce(DataFrame.unionByName, results)


@query(
    "op13_signature_search",
    r"""
    WITH terms AS (
        SELECT doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM documents
    ), counts AS (
        SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
    ), sizes AS (
        SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY ALL
    ), whole AS (
        SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM sizes
    ), weights AS (
        SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
        FROM (SELECT term, count(*) AS df FROM counts GROUP BY ALL), whole
    ), asked AS (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ), scores AS (
        SELECT item_id, doc_id,
            sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len))))::BIGINT AS score
        FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), whole
        GROUP BY ALL
    )
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
        FROM scores WHERE score > 0
    ) WHERE rank <= 20
    """,
)
def op13_signature_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
