"""What the classifiers share: the learning rows, a bounded sample of them, logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.llm.mixing import unit_hash
from corpuscope.session import stored


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for rows that nothing is learned from: crc32 of the id as text is a multiple of ``folds``; so is a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % folds == 0


def row_hash(*columns: str) -> Column:
    """A number in (0, 1) that depends on the values of a row alone; equal rows share it."""
    return unit_hash(F.concat_ws("\x00", *(F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in columns)))


def bounded_sample(rows: DataFrame, by: str, keys: tuple[str, ...], most: int, even: bool) -> DataFrame:
    """At most ``most`` rows (and one for each value of ``by``), those with the least hash of ``keys``; equal keys count once.

    With ``even`` each value of ``by`` gets the same number, else all rows have the
    same chance. Two scans, and a shuffle of little more than the sample: a hash bound thins the rows
    first, and equal ones are put together in each task.
    """
    hashed = rows.withColumn("_hash", row_hash(*keys))
    if not even:
        total = hashed.agg(F.approx_count_distinct("_hash", 0.02)).first()[0]
        thinned = hashed.filter(F.col("_hash") <= _chance(F.lit(most), F.lit(total)))
        return thinned.dropDuplicates(["_hash"]).orderBy("_hash").limit(most).drop("_hash")
    counts = stored(hashed.groupBy(by).agg(F.approx_count_distinct("_hash", 0.02).alias("_rows")), "classes")
    values = counts.count()
    quota = max(1, most // max(values, 1))
    shares = counts.select(F.col(by).alias("_by"), _chance(F.lit(quota), F.col("_rows")).alias("_chance"))
    thinned = hashed.join(shares, F.col(by) == F.col("_by")).filter(F.col("_hash") <= F.col("_chance"))
    first = W.partitionBy(by).orderBy("_hash")
    ranked = thinned.dropDuplicates([by, "_hash"]).withColumn("_rank", F.row_number().over(first))
    return ranked.filter(F.col("_rank") <= quota).select(*rows.columns)


def _chance(wanted: Column, given: Column) -> Column:
    """A bound of the hash that leaves more rows than wanted but for odds that do not matter."""
    return (wanted + 6 * F.sqrt(wanted.cast("double")) + 20) / (F.greatest(given, F.lit(1)) * 0.85)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    """Weights that minimise the mean logistic loss of ``x @ w`` against signs ``y`` (one column per task).

    Works in the precision of ``x``, which is never copied.
    """
    n, d = x.shape
    y = y.astype(x.dtype, copy=False)
    weights = np.zeros((d, y.shape[1]), dtype=x.dtype)
    speed = weights
    lipschitz = max(0.25 * float(np.einsum("ij,ij->", x, x, dtype=np.float64)) / n + penalty, 1e-9)
    for step in range(rounds):  # Nesterov's accelerated gradient
        margin = np.clip((x @ speed) * y, -50, 50)
        gradient = -(x.T @ (y / (1 + np.exp(margin)))) / n + penalty * speed
        following = speed - gradient / lipschitz
        speed = following + step / (step + 3) * (following - weights)
        weights = following
    return weights
