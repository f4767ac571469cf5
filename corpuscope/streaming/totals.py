"""Totals and file types of a corpus that arrives as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscope.operators.corpus import add_averages, corpus_totals, file_type_counts
from corpuscope.streaming.batches import batch_path, drop_batch, finished_batches, start_batches

_SUMS = ("totalFiles", "totalSize", "totalLines", "totalWords")
_TYPES = "extension string, files bigint"
#: Written last: a batch that has it is whole.
_DONE = "types/_SUCCESS"


def stream_corpus_totals(records: DataFrame, path: str) -> StreamingQuery:
    """Add the records of a stream to the totals and file types below ``path``, batch by batch, and stop.

    A batch holds the sums of all batches up to it: those of the batch ahead of it, which stays until
    the next one is whole, and its own. So a batch that is run twice gives the same sums, one
    that broke off is made anew, and what is stored does not grow with the number of batches. Sums are whole
    numbers or doubles, as ``corpus_totals`` gives them; records are taken as they come, and one that the source
    gives twice counts twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        add_batch(batch, number, path)

    return start_batches(records, path, add)


def add_batch(batch: DataFrame, number: int, path: str) -> None:
    """The work of one batch; one that is there already is left as it is."""
    spark = batch.sparkSession
    done = finished_batches(spark, path, _DONE)
    if done and number <= done[-1]:
        return
    here = batch_path(path, number)
    kept = batch.persist()
    try:
        totals, types = corpus_totals(kept).select(*_SUMS), file_type_counts(kept)
        if done:
            before = batch_path(path, done[-1])
            earlier = spark.read.parquet(f"{before}/totals")
            totals = earlier.union(totals).agg(*(F.sum(name).alias(name) for name in _SUMS))
            types = spark.read.schema(_TYPES).parquet(f"{before}/types").union(types)
            types = types.groupBy("extension").agg(F.sum("files").alias("files"))
        totals.write.mode("overwrite").parquet(f"{here}/totals")
        types.write.mode("overwrite").parquet(f"{here}/types")
    finally:
        kept.unpersist()
    for old in done[:-1]:
        drop_batch(spark, path, old)


def _last(spark: SparkSession, path: str) -> str:
    done = finished_batches(spark, path, _DONE)
    if not done:
        raise FileNotFoundError(f"no batch below {path}")
    return batch_path(path, done[-1])


def current_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals and averages of all batches so far."""
    return add_averages(spark.read.parquet(f"{_last(spark, path)}/totals"))


def current_types(spark: SparkSession, path: str) -> DataFrame:
    """Records per extension in all batches so far."""
    return spark.read.schema(_TYPES).parquet(f"{_last(spark, path)}/types")
