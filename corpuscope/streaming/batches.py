"""Batches of a stream, each in a folder named after its number.

A stream that is started again may run its last batch once more. The batch then replaces its own folder, or leaves
it as it is, so nothing is counted twice. The stream's checkpoint lies in the same place as its batches: one
cannot be taken for the other's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpuscope.sources.sinks import _at, _files, remove

OnBatch = Callable[[DataFrame, int], None]


def batch_path(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/batches/batch={number}"


def finished_batches(spark: SparkSession, path: str, done: str = "_SUCCESS") -> list[int]:
    """The numbers of the batches that are there, in order; ``done`` is what a whole one holds."""
    root = f"{path.rstrip('/')}/batches"
    files = _files(spark, root)
    if not files.exists(_at(spark, root)):
        return []
    names = [s.getPath().getName() for s in files.listStatus(_at(spark, root)) if s.isDirectory()]
    numbers = sorted(int(name.removeprefix("batch=")) for name in names if name.startswith("batch="))
    return [n for n in numbers if files.exists(_at(spark, f"{batch_path(path, n)}/{done}"))]


def drop_batch(spark: SparkSession, path: str, number: int) -> None:
    remove(spark, batch_path(path, number))


def start_batches(stream: DataFrame, path: str, on_batch: OnBatch, mode: str = "append") -> StreamingQuery:
    """Run ``on_batch`` on what is there, batch after batch, and stop. Started again it goes on where it ended."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path.rstrip('/')}/_checkpoint")
    return writer.foreachBatch(on_batch).trigger(availableNow=True).start()
