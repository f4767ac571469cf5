"""Quality scores by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.learning import held_out, row_hash
from corpuscope.llm.registry import query, table
from corpuscope.llm.textbytes import flat, mixed, row_groups
from corpuscope.llm.words import word_hashes
from corpuscope.operators.ranking import ranked
from corpuscope.session import stored

#: Labelled documents that meet each other in pairs.
GROUP_ROWS = 512
#: Weight of the squared weights in the loss.
PENALTY = 1e-4
#: Steps of Newton's method at most.
PASSES = 12
#: The score at which a document counts as good.
CUT = 0.3

_KINDS = np.zeros(256, dtype=np.int64)  # 0: any other sign
_KINDS[97:123] = 1
_KINDS[65:91] = 2
_KINDS[48:58] = 3
_KINDS[[32, 9, 11, 12, 13]] = 4
_KINDS[10] = 5
_KINDS[128:] = 6
_KINDS[[ord(c) for c in ".,;:'\"-"]] = 7
_KINDS[[ord(c) for c in "!?"]] = 8
_KINDS[:9] = 9  # control signs
_N_KINDS = 10


def _features(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> np.ndarray:
    """One row of numbers for each text: shares of kinds of signs, sizes and repetition of words and lines."""
    begin, end = offsets[first], offsets[last]
    bounds = offsets[first : last + 1] - begin
    stretch = data[begin:end]
    rows = last - first
    lengths = np.diff(bounds)
    owner = np.repeat(np.arange(rows), lengths)
    kinds = np.bincount(owner * _N_KINDS + _KINDS[stretch], minlength=rows * _N_KINDS).reshape(rows, _N_KINDS)
    hashes, word_starts, word_ends, row = word_hashes(stretch, bounds)
    words = np.bincount(row, minlength=rows)
    size = np.bincount(row, weights=word_ends - word_starts, minlength=rows)
    per_row = mixed(row.astype(np.uint64) + np.uint64(1))
    _, kept = np.unique(hashes ^ per_row, return_index=True)
    distinct = np.bincount(row[kept], minlength=rows)
    again = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    echoes = np.bincount(row[1:][again], minlength=rows)
    lone = np.bincount(row[word_ends - word_starts == 1], minlength=rows)
    shares = kinds / np.maximum(lengths, 1)[:, None]
    many = np.maximum(words, 1)
    return np.column_stack(
        [
            np.sqrt(shares),
            echoes / many,
            np.log1p(distinct) / np.log1p(many),
            size / many / 10,
            lone / many,
            np.log1p(lengths) / 10,
            np.minimum(1, kinds[:, 5] / many),
        ]
    )


def _expanded(x: np.ndarray) -> np.ndarray:
    """The features with their squares, so that a middle value may be best."""
    return np.column_stack([x, x * x])


@dataclass
class QualityModel:
    """Centre, spread and weights of the features, and the raw score that the quantile cut lies at."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = ((_expanded(x) - self.centre) / self.spread) @ self.weights
        margin = (raw - self.cut) * self.slope + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column(1))
        for first, last in row_groups(offsets):
            rows = [row.tobytes() for row in _features(data, offsets, first, last)]
            here = (batch.column(i).slice(first, last - first) for i in (0, 2))
            yield pa.RecordBatch.from_arrays([*here, pa.array(rows, pa.binary())], names=["doc_id", "_hash", "features"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Expanded features, and whether they are of a good document, of so many rows at a time as meet in pairs."""
    for batch in batches:
        for first in range(0, batch.num_rows, GROUP_ROWS):
            part = batch.slice(first, GROUP_ROWS)
            x = np.stack([np.frombuffer(f, dtype=np.float64) for f in part.column("features").to_pylist()])
            yield _expanded(x), np.array(part.column("good").to_pylist(), dtype=bool)


def _summed(rows: DataFrame, parts: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of numbers of all groups; a task sends one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x, good in _groups(batches):
            found = parts(x, good)
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    sums = rows.select("good", "features").mapInArrow(run, "total binary").toArrow().column("total").to_pylist()
    # in an order of their own, so that reruns agree
    return np.sum([np.frombuffer(s, dtype=np.float64) for s in sorted(sums)], axis=0)


def _moments(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), x[good].sum(axis=0)])


def _pair_parts(weights: np.ndarray, x: np.ndarray, good: np.ndarray, means: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Pairs, loss, gradient and curvature of all pairs of a good and a bad document of a group.

    A group of one class meets the mean of the other, so that every document takes part.
    """
    winners, losers = (x[s] if s.any() else mean[None] for s, mean in zip((good, ~good), means, strict=True))
    margin = np.clip((winners @ weights)[:, None] - (losers @ weights)[None], -50, 50)
    surprise = 1 / (1 + np.exp(margin))
    bend = surprise * (1 - surprise)
    gradient = losers.T @ surprise.sum(axis=0) - winners.T @ surprise.sum(axis=1)
    across = winners.T @ bend @ losers
    curve = (winners.T * bend.sum(axis=1)) @ winners + (losers.T * bend.sum(axis=0)) @ losers - across - across.T
    return np.concatenate([[margin.size, np.logaddexp(0, -margin).sum()], gradient, curve.ravel()])


def _learned_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """good and features of every labelled document that is not held out, without its text; equal rows count once."""
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    given = docs.select("doc_id", "text", row_hash("doc_id", "text").alias("_hash"))
    given = given.filter(F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    featured = given.mapInArrow(_featured, f"doc_id {kind}, _hash double, features binary")
    known = known.withColumnRenamed("doc_id", "_doc_id")
    found = featured.join(known, F.col("doc_id") == F.col("_doc_id")).select("_hash", "label", "features")
    rows = stored(found.dropDuplicates(["_hash"]).sortWithinPartitions("_hash"), "labelled")
    best = rows.agg(F.max("label")).first()[0]
    return rows.select("features", (F.col("label") == F.lit(best)).alias("good"))


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel | None:
    """Learn scores from pairs of a good and a bad document, on all labelled rows.

    The chance that the good one wins is the logistic function of the score difference. Rows are
    dealt by a hash and meet in groups of ``GROUP_ROWS``, each good one with each bad one of its group; Newton's
    method adds up the groups, a pass over the stored features for each step. The cut is the exact
    quantile of all scores at the share of bad documents. Rows that are held out and null
    labels or texts are left aside; a document with several labels counts as good if one
    says so. None if one of the classes is missing.
    """
    rows = _learned_rows(docs, labels)
    n, n_good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0))).first()
    if n_good in (0, n):
        return None
    total, squares, of_good = np.split(_summed(rows, _moments), 3)
    centre = total / n
    spread = np.sqrt(np.maximum(squares / n - centre * centre, 0))
    spread[spread < 1e-6] = 1
    means = ((of_good / n_good - centre) / spread, ((total - of_good) / (n - n_good) - centre) / spread)
    size = len(centre)

    def at(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sums = _summed(rows, lambda x, good: _pair_parts(weights, (x - centre) / spread, good, means))
        loss, gradient, curve = (part / sums[0] for part in np.split(sums[1:], [1, 1 + size]))
        loss = float(loss[0]) + PENALTY / 2 * float(weights @ weights)
        return loss, gradient + PENALTY * weights, curve.reshape(size, size) + PENALTY * np.eye(size)

    weights = np.zeros(size)
    loss, gradient, curve = at(weights)
    for _ in range(PASSES):
        step = np.linalg.solve(curve, gradient)
        if float(gradient @ step) < 1e-8:
            break
        for share in (1, 0.5, 0.25, 0.125, 0.0625):
            tried = at(weights - share * step)
            if tried[0] < loss:
                break
        else:
            break
        weights, (loss, gradient, curve) = weights - share * step, tried

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in _groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(((x - centre) / spread) @ weights)], names=["raw"])

    placed = ranked(rows.select("good", "features").mapInArrow(raw, "raw double"), ["raw"])
    n_bad = n - n_good
    around, spread_raw = placed.agg(
        F.avg(F.when(F.col("rank").isin(n_bad, n_bad + 1), F.col("raw"))), F.stddev_pop("raw")
    ).first()
    return QualityModel(centre, spread, weights, around, 4 / max(spread_raw, 1e-9))


def _scored(model: QualityModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for first, last in row_groups(offsets):
                x = _features(data, offsets, first, last)
                scores = model.scores(x) if model else np.full(last - first, 0.5)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(scores),
                        pa.array((scores >= CUT).astype(np.int32)),
                    ],
                    names=["doc_id", "score", "predicted"],
                )

    return run


def score_quality(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """Score every whole text: ``doc_id``, ``score`` from 0 to 1, ``predicted`` (1 from 0.3 on).

    A score depends on the text alone. Null and empty texts have features of 0 and get a score from them;
    without a model every score is 0.5. Repeated rows, null ids and extra columns do no harm.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int"
    return docs.select("doc_id", "text").mapInArrow(_scored(model), schema)


@query("op3_quality_ranking")
def op3_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labels of those whose id is not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
