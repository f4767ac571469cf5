"""File listings and whole-file readers.

Both use the binary file source: its paths agree between a listing and a read,
contents are read only where a column needs them, and a compressed file is not
unpacked because of its name. Spark's file sources leave empty files out; where
those matter, start from a manifest DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.jsontext import json_error, with_json
from corpuscope.functions.paths import base_name
from corpuscope.functions.text import char_count, count_words
from corpuscope.operators.ranking import ranked

FILE_TYPE = "path string, modificationTime timestamp, length bigint, content binary"

#: Names of files that Spark's line reader unpacks.
PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst)$"


def scan_files(
    spark: SparkSession,
    path: str | list[str],
    recursive: bool = False,
    extensions: list[str] | None = None,
    sort: str | None = None,
) -> DataFrame:
    """List files: path, name, length, modificationTime.

    Only names with one of the extensions are listed; ``sort`` names a column. For the
    order as a column see :func:`sort_listing`.
    """
    reader = _reader(spark, recursive)
    if extensions:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(extensions) + "}")
    listing = reader.load(path).select("path", base_name(F.col("path")).alias("name"), "length", "modificationTime")
    # the path breaks ties, so files of one name need not end up in one task
    return listing.orderBy(sort, "path") if sort else listing


def sort_listing(listing: DataFrame, sort: str = "name", rank: str = "rank") -> DataFrame:
    """A listing, or any manifest with ``path``, and the place of each entry (from 1) in order of ``sort`` and path."""
    return ranked(listing, [sort, "path"], rank)


def _reader(spark: SparkSession, recursive: bool):
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())


def as_text(files: DataFrame) -> DataFrame:
    """path, filename and content of binary files."""
    return files.select("path", base_name(F.col("path")).alias("filename"), F.col("content").cast("string"))


def read_text_files(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """One row per file: path, filename, content."""
    return as_text(_reader(spark, recursive).load(path))


def text_file_stats(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """Size, lines and words of each text file, of any size: path, size, lines, wordCount.

    The files are read line by line, a large one in several tasks, and counted before
    the shuffle; no row holds a file. Only ``\\n`` ends a line, a last newline is followed by an
    empty line. Whether a file ends in one, and whether the reader has dropped a byte order mark of three
    bytes, is told by the file's length. A file that Spark unpacks because of its
    name has no such length; it is expected to end in a newline.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n")
    lines = reader.text(path).select(
        F.input_file_name().alias("path"), "value", F.col("_metadata.file_size").alias("length")
    )
    counted = lines.groupBy("path").agg(
        F.sum(char_count(F.col("value")) + 1).alias("size"),
        (F.count(F.lit(1)) + 1).alias("lines"),
        F.sum(count_words(F.col("value"))).alias("wordCount"),
        (F.sum(F.octet_length("value") + F.lit(1).cast("long")) - F.max("length")).alias("_over"),
    )
    packed = F.col("path").rlike(PACKED)
    unended = F.when(~packed & F.col("_over").isin(1, -2), 1).otherwise(0)
    mark = F.when(~packed & F.col("_over").isin(-2, -3), 1).otherwise(0)
    return counted.select(
        "path", (F.col("size") - unended + mark).alias("size"), (F.col("lines") - unended).alias("lines"), "wordCount"
    )


def parse_files(files: DataFrame) -> DataFrame:
    """Replace ``content`` by ``jsonData``, or ``parseError`` where it is not valid JSON."""
    parsed = with_json(files, "jsonData", F.col("content"))
    return parsed.withColumn("parseError", json_error(F.col("jsonData"), F.col("content"))).drop("content")


def read_json_files(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """One row per file, parsed; a file that does not parse keeps its row."""
    return parse_files(read_text_files(spark, path, recursive))
