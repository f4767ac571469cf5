"""Near duplicates among embeddings: tiles of int8 products with error bounds, exact products where these leave doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.components import components, least_labels
from corpuscope.llm.registry import query, table
from corpuscope.llm.running import running_totals
from corpuscope.session import shuffle_partitions, stored

#: Cosine from which two vectors are linked.
THRESHOLD = 0.98
#: Vectors of a block; a tile is a pair of blocks.
BLOCK = 256
#: Directions whose projections tell blocks apart.
PIVOTS = 16

_CLASSES = "vec_id long, label string, dims int, body binary"
_BLOCKS = "label string, dims int, block long, ids binary, copies binary, body binary, low array<double>, high array<double>"
_FOUND = "id long, links long, other long"


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles, null for those that cannot be linked."""
    for batch in batches:
        dims: list[int | None] = []
        bodies: list[bytes | None] = []
        for label, vector in zip(batch.column(1), batch.column(2), strict=True):
            body = None
            if label.is_valid and vector.is_valid and not vector.values.null_count:
                values = np.asarray(vector.values, dtype=np.float64)
                if len(values) and np.isfinite(values).all() and values.any():
                    body = values.tobytes()
            bodies.append(body)
            dims.append(None if body is None else len(values))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(bodies, pa.binary())],
            names=["vec_id", "label", "dims", "body"],
        )


def _units(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _directions(dims: int, pivots: int) -> np.ndarray:
    """Orthogonal unit vectors (as many as there are dimensions at most), the same in every task."""
    square = np.random.default_rng(dims).standard_normal((dims, min(dims, pivots)))
    return np.linalg.qr(square)[0].T


def _projected(pivots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for dims, body in zip(batch.column(2).to_pylist(), batch.column(4), strict=True):
                unit = _units(np.frombuffer(body.as_py(), dtype=np.float64)[None])
                keys.append((_directions_of(dims, pivots) @ unit[0]).tolist())
            nearest = [max(range(len(k)), key=lambda i: abs(k[i])) for k in keys]
            signed = [(2 * i + (k[i] > 0), abs(k[i])) for i, k in zip(nearest, keys, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(5)),
                    pa.array([s[0] for s in signed], pa.int32()),
                    pa.array([s[1] for s in signed], pa.float64()),
                ],
                names=[*batch.schema.names, "side", "reach"],
            )

    return run


_known: dict[tuple[int, int], np.ndarray] = {}


def _directions_of(dims: int, pivots: int) -> np.ndarray:
    if (dims, pivots) not in _known:
        _known[dims, pivots] = _directions(dims, pivots)
    return _known[dims, pivots]


def _packed(pivots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("ids", "copies", "body", "low", "high")}
            for dims, members in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                items = members.values
                matrix = np.frombuffer(b"".join(items.field("body").to_pylist()), dtype=np.float64).reshape(-1, dims)
                shadow = _units(matrix) @ _directions_of(dims, pivots).T
                out["ids"].append(np.asarray(items.field("number")).astype("<i8").tobytes())
                out["copies"].append(np.asarray(items.field("copies")).astype("<i8").tobytes())
                out["body"].append(matrix.tobytes())
                out["low"].append(shadow.min(axis=0).tolist())
                out["high"].append(shadow.max(axis=0).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    *(pa.array(out[name], pa.binary()) for name in ("ids", "copies", "body")),
                    *(pa.array(out[name], pa.list_(pa.float64())) for name in ("low", "high")),
                ],
                names=["label", "dims", "block", *out],
            )

    return run


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 with one scale each, and how far each is from what its int8 stand for."""
    scale = np.abs(units).max(axis=1) / 127
    whole = np.rint(units / scale[:, None])
    error = np.sqrt(((units - whole * scale[:, None]) ** 2).sum(axis=1))
    return whole.astype(np.int8), scale, error


def linked_pairs(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of two matrices whose cosine reaches the threshold, and how many products were exact.

    x and y are their int8 stand-ins plus errors e and f, so x.y differs from the int8
    product by at most |e| + |f| + |e| |f|. Only pairs whose product comes within that
    of the threshold are multiplied again in doubles, which decide.
    """
    a, b = _units(left), _units(right)
    whole_a, scale_a, error_a = quantised(a)
    whole_b, scale_b, error_b = quantised(b)
    # sums of int8 products are whole and below 2^24 for up to 1,040 dimensions, so floats hold them
    kind = np.float32 if left.shape[1] <= 1040 else np.float64
    products = (whole_a.astype(kind) @ whole_b.astype(kind).T) * scale_a[:, None] * scale_b[None]
    bound = error_a[:, None] + error_b[None] + error_a[:, None] * error_b[None] + 1e-9
    row, column = np.nonzero(products >= threshold - bound)
    dots = (left[row] * right[column]).sum(axis=1)
    norms = np.sqrt((left * left).sum(axis=1))[row] * np.sqrt((right * right).sum(axis=1))[column]
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        cosine = dots / norms
    odd = ~np.isfinite(cosine) | (norms < 1e-290)  # squares out of range: by scaled vectors
    cosine[odd] = (a[row[odd]] * b[column[odd]]).sum(axis=1)
    linked = cosine >= threshold
    return row[linked], column[linked], len(row)


def _tiles(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for k in range(len(batch)):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(names)}
                ids, other_ids = (np.frombuffer(row[c], "<i8") for c in ("ids", "other_ids"))
                copies, other_copies = (np.frombuffer(row[c], "<i8") for c in ("copies", "other_copies"))
                left = np.frombuffer(row["body"]).reshape(-1, row["dims"])
                same = row["block"] == row["other_block"]
                right = left if same else np.frombuffer(row["other_body"]).reshape(-1, row["dims"])
                a, b, _ = linked_pairs(left, right, threshold)
                if same:
                    a, b = a[a < b], b[a < b]
                if not len(a):
                    continue
                # sums per vector and a spanning forest: as many rows as vectors, whatever the number of pairs
                links = np.bincount(a, weights=other_copies[b], minlength=len(ids)).astype(np.int64)
                back = np.bincount(b, weights=copies[a], minlength=len(other_ids)).astype(np.int64)
                nodes, least = least_labels(ids[a], other_ids[b])
                apart = nodes != least
                counted = np.concatenate([ids[links > 0], other_ids[back > 0]])
                counts = np.concatenate([links[links > 0], back[back > 0]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([counted, nodes[apart]])),
                        pa.array(np.concatenate([counts, np.zeros(apart.sum(), dtype=np.int64)])),
                        pa.array(
                            np.concatenate([np.zeros(len(counted), dtype=np.int64), least[apart]]),
                            mask=np.concatenate([np.ones(len(counted), bool), np.zeros(apart.sum(), bool)]),
                        ),
                    ],
                    names=["id", "links", "other"],
                )

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """Link vectors of one label whose cosine, in doubles, reaches the threshold (above 0).

    Equal vectors of a label are one class with a number of copies. Classes are put in
    order of label and of the direction they lie nearest to, and cut into blocks of
    ``block``; every pair of blocks of a label is a tile, but for those whose
    projections on some direction lie further apart than linked vectors can. A tile
    multiplies int8 vectors, whose errors are bounded, and computes only pairs in doubt
    in doubles. It returns a sum for each vector and a spanning forest of its links,
    never the pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and those
    with a null label, link with nothing; nor do vectors of different length. Rows that
    share an id are vectors of their own, whatever their labels, and so are rows without an id;
    an empty table gives no rows.

    Columns: ``vec_id``, ``n_links`` (other vectors linked directly), ``component_id``
    (least id reachable; null if all that are reachable have none), ``kept`` (whether that is its own,
    so a row without an id is kept if it reaches no row that has one).
    """
    parts = shuffle_partitions(vectors.sparkSession)
    plain = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    rows = stored(plain.mapInArrow(_bodies, _CLASSES), "vectors")
    bodies = rows.filter("body is not null")
    key = ["label", "dims", "body"]
    classes = bodies.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = classes.select("id", "label", "dims", "copies", "body")
    classes = classes.mapInArrow(
        _projected(pivots), "id long, label string, dims int, copies long, body binary, side int, reach double"
    )
    # the place of a class is its number; the digest leaves no ties, so it is the same wherever it is worked out
    order = [*map(F.col, ("label", "dims", "side", "reach", "id")), F.sha2("body", 256)]
    placed = running_totals(classes, order, []).withColumnRenamed("row_index", "number")
    starts = placed.groupBy("label", "dims").agg(F.min("number").alias("_start"))
    numbered = placed.join(starts, ["label", "dims"]).withColumn(
        "block", F.floor((F.col("number") - F.col("_start")) / block).cast("long")
    )
    members = numbered.groupBy("label", "dims", "block").agg(  # at most ``block`` rows each
        F.collect_list(F.struct("number", "copies", "body")).alias("members")
    )
    blocks = stored(members.select("label", "dims", "block", "members").mapInArrow(_packed(pivots), _BLOCKS), "blocks")

    # the projections of two unit vectors differ by no more than the vectors do
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    outline = blocks.select("label", "dims", "block", "low", "high")
    other = outline.select(
        "label", "dims", *(F.col(c).alias(f"other_{c}") for c in ("block", "low", "high"))
    )
    apart = F.exists(
        F.zip_with(
            F.arrays_zip("low", "high"),
            F.arrays_zip("other_low", "other_high"),
            lambda a, b: F.greatest(a["low"] - b["other_high"], b["other_low"] - a["high"]) > reach,
        ),
        lambda far: far,
    )
    tiles = outline.join(other, ["label", "dims"]).filter((F.col("block") <= F.col("other_block")) & ~apart)
    tiles = tiles.select("label", "dims", "block", "other_block").repartition(parts, "label", "dims", "block", "other_block")
    right = blocks.select(
        "label", "dims", *(F.col(c).alias(f"other_{c}") for c in ("block", "ids", "copies", "body"))
    )
    full = tiles.join(blocks.drop("low", "high"), ["label", "dims", "block"]).join(right, ["label", "dims", "other_block"])
    found = stored(
        full.select("dims", "block", "other_block", "ids", "copies", "body", "other_ids", "other_copies", "other_body")
        .mapInArrow(_tiles(threshold), _FOUND),
        "found",
    )

    links = found.groupBy("id").agg(F.sum("links").alias("_links")).withColumnRenamed("id", "number")
    reached = components(found.filter("other is not null").select("id", "other")).withColumnRenamed("id", "number")
    groups = placed.select("number", "id").join(reached, "number", "left")
    groups = stored(groups.select("number", "id", F.coalesce("component_id", "number").alias("_group")), "groups")
    # written, so that the join deals both sides anew and a large group can be split
    least = stored(groups.groupBy("_group").agg(F.min("id").alias("component_id")), "least")
    told = groups.join(least, "_group").select("number", "component_id")
    classes = (
        placed.select(*key, "number", F.col("copies").alias("_copies"))
        .join(links, "number", "left")
        .join(told, "number")
        .select(*key, "component_id", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).cast("long").alias("n_links"))
    )
    whole = bodies.join(classes, key).select("vec_id", "n_links", "component_id")
    alone = rows.filter("body is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return whole.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query(
    "op8_embedding_tiles",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.vec_id AS id, b.vec_id AS other FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_cosine_similarity(a.e, b.e) >= 0.98
    ), reach AS (
        SELECT vec_id AS id, vec_id AS other FROM embeddings
        UNION
        SELECT reach.id, links.other FROM reach JOIN links ON reach.other = links.id
    ), least AS (
        SELECT id, min(other) AS component_id FROM reach GROUP BY id
    ), counts AS (
        SELECT id, count(*) AS n FROM links GROUP BY id
    )
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN least ON vec_id = least.id LEFT JOIN counts ON vec_id = counts.id
    """,
)
def op8_embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
