"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.session import stored

#: Edges that are contracted together within a task.
_TOGETHER = 200_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some edges and the least node that each can reach."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        following = label.copy()
        np.minimum.at(following, label[left], least)
        np.minimum.at(following, label[right], least)
        while (following != following[following]).any():
            following = following[following]
        if (following == label).all():
            return nodes, nodes[label]
        label = following


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def stars() -> pa.RecordBatch:
        nodes, least = least_labels(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        apart = nodes != least
        return pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(least[apart])], names=["u", "v"])

    for batch in batches:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        size += len(batch)
        if size >= _TOGETHER:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """The least node that each node can reach: ``id``, ``component_id``, for the nodes of some edge that are not least.

    ``edges`` has two columns of longs, in any order, repeated or not. Each task first
    turns its edges into stars; then large-star and small-star steps alternate, each
    written to the shared folder, until nothing changes: of the order of the logarithm
    of the longest path. Nodes with many edges are aggregated before the shuffle, and
    the joins that hand their minimum back can be split.
    """
    a, b = edges.columns
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    stars = stored(pairs.mapInArrow(_contracted, "u long, v long").distinct(), "stars")
    sums = F.struct(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long")))
    before = stars.agg(sums).first()[0]
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("least")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = stored(large.filter("u <> v").distinct(), "large")  # u > v from here on
        least = stored(large.groupBy("u").agg(F.min("v").alias("least")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        small = small.unionByName(least.select("u", F.col("least").alias("v"))).filter("u <> v")
        stars = stored(small.distinct(), "stars")
        after = stars.agg(sums).first()[0]
        if after == before:
            break
        before = after
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
