"""KEY=VALUE configuration files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.text import WS, trim_ws
from corpuscope.operators.lookups import last_wins
from corpuscope.sources.ranges import PLACE, read_pieces

# Behind white space something that is neither a comment nor a '=', and then a '='.
SETTING = rf"^{WS}*+[^#=][^=]*="


def parse_config_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Replace each line by ``key`` and ``value``; other columns stay.

    Blank lines, comments, and lines without a '=' behind at least one character
    are dropped. One pair of matching quotes around the value is removed.
    """
    trimmed = trim_ws(F.col(line))
    split_at = F.instr("_line", "=")
    value = F.col("_value")
    first, last = F.substring(value, 1, 1), F.substring(value, -1, 1)
    quoted = (F.length(value) >= 2) & (first == last) & first.isin('"', "'")
    return (
        lines.where(F.col(line).rlike(SETTING))
        .withColumn("_line", trimmed)
        .withColumn("key", trim_ws(F.col("_line").substr(F.lit(1), split_at - 1)))
        .withColumn("_value", trim_ws(F.col("_line").substr(split_at + 1, F.length("_line"))))
        .withColumn("value", F.when(quoted, value.substr(F.lit(2), F.length(value) - 2)).otherwise(value))
        .drop("_line", "_value", line)
    )


def read_config_lines(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """Settings of each file: path, key, value; a later line wins over an earlier one.

    A file may be of any size: it is read in byte ranges by several tasks, each sends one row
    for a key, and the place of a line tells which one is later.
    """
    lines = read_pieces(spark, path, recursive=recursive).select("path", F.struct(*PLACE).alias("_place"), "piece")
    return last_wins(parse_config_lines(lines, "piece"), ["path", "key"], "_place", "value")
