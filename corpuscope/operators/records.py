"""Result envelopes, tool output and log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.jsontext import STRING, kind, stringify

# Log levels in ascending order.
LOG_LEVELS = ["debug", "info", "warning", "error"]

METADATA_TYPE = (
    "struct<operation:string,path:string,success:boolean,code:string,error:string,"
    "exitCode:bigint,stdout:variant,stderr:variant>"
)
ENVELOPE_TYPE = (
    f"struct<text:string,success:boolean,error:string,message:string,code:string,metadata:{METADATA_TYPE}>"
)


def to_envelope(df: DataFrame, data: str, metadata: str, with_success: bool = True) -> DataFrame:
    """Add ``envelope``: JSON text with the data printed into ``text``.

    ``with_success=False`` is the form without a top-level ``success``.
    """
    text = stringify(F.col(data), df.schema[data].dataType).alias("text")
    parts = [text, F.lit(True).alias("success"), F.col(metadata).alias("metadata")]
    return df.withColumn("envelope", _json(F.struct(*(parts if with_success else parts[::2]))))


def to_error_envelope(df: DataFrame, message: str, with_success: bool = True) -> DataFrame:
    """Add ``envelope`` for an error message; the other form puts ``success`` into the metadata."""
    error = F.col(message).alias("error")
    failed = F.lit(False).alias("success")
    text = F.col(message).alias("text")
    if with_success:
        envelope = F.struct(text, failed, F.struct(error).alias("metadata"))
    else:
        envelope = F.struct(text, F.struct(failed, error).alias("metadata"))
    return df.withColumn("envelope", _json(envelope))


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def read_envelope(df: DataFrame, envelope: str = "envelope") -> DataFrame:
    """Replace envelope JSON by its fields.

    ``success`` comes from the top level, else the metadata; a result with an
    error at the top level and no flag has failed.
    """
    parsed = df.withColumn("_e", F.from_json(envelope, ENVELOPE_TYPE)).drop(envelope)
    error = F.col("_e.error")
    failed = F.when(~error.isin("", "false"), F.lit(False))
    return parsed.select(
        *(c for c in parsed.columns if c != "_e"),
        F.col("_e.text").alias("text"),
        F.coalesce("_e.success", "_e.metadata.success", failed).alias("success"),
        F.col("_e.metadata.operation").alias("operation"),
        F.col("_e.metadata.path").alias("path"),
        F.coalesce("_e.metadata.code", "_e.code").alias("code"),
        F.col("_e.metadata.exitCode").alias("exitCode"),
        F.coalesce("_e.metadata.error", "_e.message", F.when(failed.isNotNull(), error)).alias("error"),
        _output_lines(F.col("_e.metadata.stdout")).alias("stdout"),
        _output_lines(F.col("_e.metadata.stderr")).alias("stderr"),
    )


def _output_lines(output: Column) -> Column:
    """Output comes as an array of lines, or as one text where a handler joined them."""
    text = F.when(kind(output) == STRING, F.try_variant_get(output, "$", "string"))
    joined = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))
    return F.coalesce(joined, F.try_variant_get(output, "$", "array<string>"))


def output_text(prefix: Column, stdout: Column, stderr: Column) -> Column:
    """Prefix line, output lines, and a block of error lines if there are any."""
    lines = F.coalesce(F.array_join(stdout, "\n", ""), F.lit(""))
    errors = F.concat(F.lit("\nErrors and Warnings:\n"), F.array_join(stderr, "\n", ""))
    block = F.when(F.size(stderr) > 0, errors).otherwise("")
    return F.concat(prefix, F.lit("\n"), lines, block)


def result_counts(results: DataFrame) -> DataFrame:
    """Successes and failures per operation, from the rows of :func:`read_envelope`.

    A result without any success flag counts as neither.
    """
    success = F.col("success")
    return results.groupBy("operation").agg(
        F.count("*").alias("total"),
        F.count_if(success).alias("succeeded"),
        F.count_if(~success).alias("failed"),
    )


def level_rank(level: Column) -> Column:
    """Position of a log level, NULL for an unknown one."""
    position = F.array_position(F.array(*map(F.lit, LOG_LEVELS)), F.lower(level))
    return F.nullif(position, F.lit(0)) - 1


def log_filter(logs: DataFrame, min_level: str) -> DataFrame:
    """Log rows of at least the given level."""
    names = LOG_LEVELS[LOG_LEVELS.index(min_level.lower()):]
    return logs.where(F.lower("level").isin(*names))


def log_counts(logs: DataFrame) -> DataFrame:
    """Rows per level, with the level's rank."""
    level = F.lower("level").alias("level")
    counts = logs.groupBy(level).agg(F.count("*").alias("records"))
    return counts.withColumn("rank", level_rank(F.col("level")))
