"""Whole files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpuscope.sources.files import FILE_TYPE, as_text


def stream_text_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Each new file once: path, filename, content; ``max_files`` per batch."""
    reader = spark.readStream.format("binaryFile").schema(FILE_TYPE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return as_text(reader.load(path))


def append_json(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stateless stream as JSON lines, take what is there, and stop."""
    writer = df.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)
