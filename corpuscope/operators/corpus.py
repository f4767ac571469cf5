"""File corpus: extract, transform, aggregate.

A corpus is a DataFrame with ``filename`` and ``content``. The records keep the
member names that rule sets refer to: filename, size, lines, extractedAt,
jsonData, parseError, wordCount, preview.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.jsontext import PARSE_ERROR, TOO_LARGE, json_error, with_json
from corpuscope.functions.numbers import round_half_up
from corpuscope.functions.paths import base_name, file_extension, has_extension, parent_path
from corpuscope.functions.text import char_count, count_lines, count_words, preview_chars, preview_lines
from corpuscope.operators.ranking import ranked
from corpuscope.operators.rules import Rules, rules_json, typed_number

JSON_SUFFIX = ".json"
# Suffixes of stage files, and messages for files that cannot be read.
EXTRACTED_SUFFIX = ".extracted.json"
TRANSFORMED_SUFFIX = ".transformed.json"
NO_INPUT = "Input file not found: "
NO_CONTENT = "Failed to read file"
NO_PATH = "filePath parameter is required"
NO_FILE = "File not found: "
UNREADABLE = "Failed to read file: "


def non_empty(df: DataFrame, content: str = "content") -> DataFrame:
    """Drop rows whose content is NULL or empty."""
    return df.where(F.col(content) != "")


def extract_stage(
    files: DataFrame, run_ts: str | None = None, keep: tuple[str, ...] = (), preview: int = 100
) -> DataFrame:
    """One record per non-empty file.

    JSON files get ``jsonData`` or ``parseError`` and no word count; the others
    get ``wordCount`` and ``preview``, their first characters. Columns named in
    ``keep`` pass through. JSON beyond what a variant holds has an error of its own.
    """
    content = F.col("content")
    is_json = has_extension(F.col("filename"), [JSON_SUFFIX])
    rows = with_json(non_empty(files), "jsonData", content, is_json)
    return rows.select(
        *keep,
        "filename",
        char_count(content).alias("size"),
        count_lines(content).alias("lines"),
        run_time(run_ts).alias("extractedAt"),
        "jsonData",
        F.when(is_json, json_error(F.col("jsonData"), content)).alias("parseError"),
        F.when(~is_json, count_words(content)).alias("wordCount"),
        F.when(~is_json, preview_chars(content, preview)).alias("preview"),
    )


def extract_single(files: DataFrame, run_ts: str | None = None) -> DataFrame:
    """The per-file form: ``path`` and ``content`` in, a word count for every file.

    A row whose file is missing (NULL content) or empty has an ``error`` and no counts.
    """
    content, path = F.col("content"), F.col("path")
    missing = F.concat(F.lit(NO_INPUT), F.coalesce(path, F.lit("undefined")))
    error = F.when((F.coalesce(path, F.lit("")) == "") | content.isNull(), missing).when(content == "", NO_CONTENT)
    return _described(
        files,
        {
            "filename": base_name(path),
            "size": char_count(content),
            "lines": count_lines(content),
            "wordCount": count_words(content),
            "extractedAt": run_time(run_ts),
        },
        error,
    )


def preview_files(files: DataFrame, lines: int = 10) -> DataFrame:
    """Line, word and character counts of each file, and its first lines.

    A row without a path, or whose file is missing (NULL content) or empty, has an
    ``error`` and no counts.
    """
    content, path = F.col("content"), F.col("path")
    error = (
        F.when(F.coalesce(path, F.lit("")) == "", NO_PATH)
        .when(content.isNull(), F.concat(F.lit(NO_FILE), path))
        .when(content == "", F.concat(F.lit(UNREADABLE), path))
    )
    counted = _described(
        files,
        {
            "lineCount": count_lines(content),
            "wordCount": count_words(content),
            "charCount": char_count(content),
            "preview": preview_lines(content, lines),
        },
        error,
        keep=(path.alias("filePath"),),
    )
    return counted


def _described(files: DataFrame, columns: dict[str, Column], error: Column, keep: tuple[Column, ...] = ()) -> DataFrame:
    """The columns of files without an error, and the error."""
    usable = error.isNull()
    return files.select(
        *keep, *(F.when(usable, value).alias(name) for name, value in columns.items()), error.alias("error")
    )


def run_time(run_ts: str | None) -> Column:
    return F.lit(run_ts).cast("timestamp") if run_ts else F.current_timestamp()


def transform_stage(files: DataFrame, rules: Rules) -> DataFrame:
    """Apply the rules to JSON files, one status row per file.

    Takes ``filename`` and ``content``. Files of other types and empty files are
    passed over; a file that does not parse gives an error row.
    """
    record = F.col("_record")
    json_files = non_empty(files).where(has_extension(F.col("filename"), [JSON_SUFFIX]))
    parsed = with_json(json_files, "_record", F.col("content"))
    # a JSON null has no members: without rules it passes, with rules it fails
    usable = record.isNotNull() & (F.lit(not rules) | ~F.is_variant_null(record))
    first = F.instr(F.col("filename"), EXTRACTED_SUFFIX)
    renamed = F.when(
        first > 0,
        F.overlay("filename", F.lit(TRANSFORMED_SUFFIX), first, F.lit(len(EXTRACTED_SUFFIX))),
    ).otherwise(F.col("filename"))
    return parsed.select(
        "filename",
        F.when(usable, "success").otherwise("error").alias("status"),
        F.when(~usable, F.coalesce(json_error(record, F.col("content")), F.lit(PARSE_ERROR))).alias("error"),
        F.when(usable, renamed).alias("outputName"),
        F.when(usable, rules_json(record, rules)).alias("result"),
    )


def transform_outcomes(results: DataFrame) -> DataFrame:
    """Files per status; ``filesProcessed`` is the sum over both."""
    return results.groupBy("status").agg(F.count("*").alias("files"))


def _member_or_zero(df: DataFrame, name: str) -> Column:
    """Whole numbers stay whole; a member that rules made text or fractional counts as a double."""
    type_name = dict(df.dtypes).get(name)
    if type_name is None:
        return F.lit(0)
    whole = type_name in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col(name) if whole else typed_number(F.col(name), type_name), F.lit(0))


def corpus_totals(records: DataFrame) -> DataFrame:
    """Counts and sums over all records; a missing member counts 0."""
    return records.agg(
        F.count("*").alias("totalFiles"),
        *(
            F.coalesce(F.sum(_member_or_zero(records, member)), F.lit(0)).alias(total)
            for member, total in (("size", "totalSize"), ("lines", "totalLines"), ("wordCount", "totalWords"))
        ),
    )


def add_averages(totals: DataFrame) -> DataFrame:
    """Rounded means beside the totals, NULL for an empty corpus."""
    files = F.nullif(F.col("totalFiles"), F.lit(0))
    return totals.select(
        "*",
        *(
            round_half_up(F.col(total) / files).cast("bigint").alias(average)
            for total, average in (
                ("totalSize", "averageSize"),
                ("totalLines", "averageLines"),
                ("totalWords", "averageWords"),
            )
        ),
    )


def corpus_averages(records: DataFrame) -> DataFrame:
    """Rounded mean size, lines and words."""
    return add_averages(corpus_totals(records)).select("averageSize", "averageLines", "averageWords")


def file_type_counts(records: DataFrame) -> DataFrame:
    """Records per extension, 'unknown' for a missing file name.

    Rows, not one map: a name without a dot is its own extension, so the number
    of entries can grow with the corpus.
    """
    name = F.nullif(F.col("filename"), F.lit("")) if "filename" in records.columns else F.lit(None).cast("string")
    extension = F.coalesce(file_extension(name), F.lit("unknown"))
    return records.groupBy(extension.alias("extension")).agg(F.count("*").alias("files"))


def collect_documents(
    records: DataFrame, order_by: tuple[str, ...] = ("filename", "path"), rank: str | None = None
) -> DataFrame:
    """All records in listing order: by file name, and by path where names repeat.

    Columns of ``order_by`` that the records do not have are passed over. Records that tie
    stand in order of their other columns. With ``rank`` the place of each record (from 1) is a column of
    that name, which survives a write or a join as the order of rows does not.

    The rows stand for one ordered array, which would not fit one task. The sort
    is range-partitioned; rows of one name may end up in several partitions. It
    reads its input twice, once to find the ranges, so sort a stage table rather
    than records still to be computed.
    """
    first = [c for c in order_by if c in records.columns]
    others = [n for n, kind in records.dtypes if n not in first and not kind.startswith(("variant", "map"))]
    return ranked(records, [*first, *others], rank) if rank else records.orderBy(*first, *others)


def merge_sources(files: DataFrame) -> DataFrame:
    """The parsed sources as rows: path, data and error; sources that are not JSON are dropped.

    A source that is JSON, but more than a variant holds, keeps its row, with an error
    in place of its data.
    """
    parsed = with_json(non_empty(files), "data", F.col("content"))
    error = F.nullif(json_error(F.col("data"), F.col("content")), F.lit(PARSE_ERROR))
    # a plain filter on the parsed value would be pushed below it and parse twice;
    # the output of a generator stays where it is
    entry = F.struct("data", error.alias("error"))
    single = parsed.select("path", F.explode_outer(F.array(entry)).alias("_entry")).select("path", "_entry.*")
    return single.where(F.col("data").isNotNull() | F.col("error").isNotNull())


def merge_summary(files: DataFrame) -> DataFrame:
    """Number of sources given, of sources that parse, and of those that are JSON beyond a variant."""
    parsed = with_json(files, "_data", F.col("content"))
    large = json_error(F.col("_data"), F.col("content")) == TOO_LARGE
    return parsed.agg(
        F.count("*").alias("sources"), F.count("_data").alias("merged"), F.count_if(large).alias("tooLarge")
    )


def all_passed(df: DataFrame, run: str, flags: list[str]) -> DataFrame:
    """Per run whether no flag of any row is false; a missing flag passes."""
    row_passed = F.lit(True)
    for flag in flags:
        row_passed = row_passed & F.coalesce(F.col(flag), F.lit(True))
    return df.groupBy(run).agg(F.bool_and(row_passed).alias("allPassed"))


def directory_summary(files: DataFrame) -> DataFrame:
    """Items and bytes per directory, from ``path`` and ``length``.

    Takes the listing of :func:`corpuscope.sources.files.scan_files` or any
    manifest; Spark's file sources leave empty files out, a manifest need not.
    """
    return files.groupBy(parent_path(F.col("path")).alias("directory")).agg(
        F.count("*").alias("totalItems"), F.sum("length").alias("totalSize")
    )
