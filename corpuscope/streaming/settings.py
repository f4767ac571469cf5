"""The last assignment to each key of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscope.operators.lookups import env_overlay, last_wins
from corpuscope.streaming.batches import batch_path, finished_batches, start_batches


def stream_last_wins(
    assignments: DataFrame, keys: list[str], order: str, value: str, path: str, salts: int | None = None
) -> StreamingQuery:
    """Take the assignments of a stream that are there, keep the last of each key below ``path``, and stop.

    A batch writes the last of its own assignments to each key, in a folder of its own, and a batch that is run again
    replaces its own. :func:`current_settings` compares those of all batches, so the result does not depend on the order of
    arrival. Nothing has to be remembered from batch to batch: no state grows with the keys or has to be opened for each
    batch. Every task sends one row per key, so a key with a third of all rows needs no dealing; ``salts``, the parts that it
    was dealt to, changes nothing.
    """
    given = assignments.select(*keys, F.col(order).alias("_order"), F.col(value).alias("_value"))
    # an assignment without a place says that there is the key, not its value
    ranked = F.when(F.col("_order").isNotNull(), F.struct("_order", "_value"))

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*keys).agg(F.max(ranked).alias("_last")).select(*keys, "_last._order", "_last._value")
        last.write.mode("overwrite").parquet(batch_path(path, number))

    return start_batches(given, path, write)


def current_settings(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    """The last value of each key in all batches so far, as ``last_wins`` gives it."""
    done = finished_batches(spark, path)
    if not done:
        raise FileNotFoundError(f"no batch below {path}")
    updates = spark.read.parquet(*(batch_path(path, number) for number in done))
    return last_wins(updates, keys, "_order", "_value").withColumnRenamed("_value", value)


def current_overlay(env: DataFrame, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """The environment plus the streamed keys it does not have, as ``env_overlay`` gives it."""
    return env_overlay(env, current_settings(env.sparkSession, path, [key], value), key)
