"""Files of any size, read in byte ranges by several tasks.

Spark's line reader cuts a file into ranges of ``spark.sql.files.maxPartitionBytes``; with another separator than a
line end it cuts any text. What a range needs to know of those ahead of it (line numbers, whether a quote is
open, how deep brackets are nested) comes from totals of the ranges, one row for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.functions.jsontext import NO_LIMITS, PARSE_ERROR, TOO_LARGE, json_error, valid_json, with_json
from corpuscope.functions.paths import base_name, has_extension
from corpuscope.functions.text import char_count, count_words, preview_chars
from corpuscope.operators.corpus import JSON_SUFFIX, run_time
from corpuscope.session import stored
from corpuscope.sources.files import PACKED

#: What tells the order of the pieces of a file.
PLACE = ("range_start", "place")
#: Bytes of small ranges that one task reads.
_TASK_BYTES = 128 << 20


@contextmanager
def range_size(spark: SparkSession, size: int | None) -> Iterator[None]:
    """Ranges of so many bytes for what is read within; by default the session's."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    if size is not None:
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")  # else small files would not be cut
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def read_pieces(
    spark: SparkSession, path: str | list[str], separator: str = "\n", recursive: bool = False, names: str = "*"
) -> DataFrame:
    """The pieces between separators: path, range_start, place, length (of the file), piece.

    Pieces of one file stand in order of ``range_start`` and ``place``, which grows by one within a range. A piece
    belongs to the range it begins in. The reader drops a byte order mark, and empty files have no pieces. ``names`` is a
    pattern that the names of the files match.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", separator)
    reader = reader.option("pathGlobFilter", names)
    return reader.text(path).select(
        file_path().alias("path"),
        F.col("_metadata.file_block_start").alias("range_start"),
        F.monotonically_increasing_id().alias("place"),
        F.col("_metadata.file_size").alias("length"),
        F.col("value").alias("piece"),
    )


def _packed(pieces: DataFrame, range_bytes: int | None) -> DataFrame:
    """Small ranges, several to a task: a task and a file for each cost more than its bytes do.

    Ranges and places stay as they are. A task reads its ranges one after another, 128 MB of them at most; tables of
    less are still read by a few tasks on each core.
    """
    if range_bytes is None:
        return pieces
    ranges = pieces.rdd.getNumPartitions()
    tasks = max(4 * pieces.sparkSession.sparkContext.defaultParallelism, -(-ranges * range_bytes // _TASK_BYTES))
    return pieces.coalesce(tasks) if ranges > tasks else pieces


def file_path() -> Column:
    """The path of a row's file, in the form of the listing."""
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "file:/")


def read_lines(
    spark: SparkSession, path: str | list[str], recursive: bool = False, range_bytes: int | None = None
) -> DataFrame:
    """The lines of text files of any size: path, line_no (from 0), line.

    A file is read in several tasks; line numbers come from the numbers of lines in the ranges ahead.
    Only ``\\n`` ends a line. What stands behind the last newline is a line too, but an empty one has no row; empty files
    have none. The lines are written once to the shared folder, so that ranges stay as they are.
    """
    with range_size(spark, range_bytes):
        lines = stored(_packed(read_pieces(spark, path, recursive=recursive), range_bytes), "lines")
    return number_lines(lines)


def number_lines(pieces: DataFrame) -> DataFrame:
    """path, line_no, line of stored pieces. One row per range is all that is shuffled and sorted."""
    ranges = pieces.groupBy("path", "range_start").agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    ahead = W.partitionBy("path").orderBy("range_start").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select("path", "range_start", "_first", F.coalesce(F.sum("_lines").over(ahead), F.lit(0)).alias("_ahead"))
    return pieces.join(starts, ["path", "range_start"]).select(
        "path", (F.col("_ahead") + F.col("place") - F.col("_first")).alias("line_no"), F.col("piece").alias("line")
    )


def extract_ranges(
    spark: SparkSession,
    path: str | list[str],
    run_ts: str | None = None,
    preview: int = 100,
    recursive: bool = False,
    range_bytes: int | None = None,
) -> DataFrame:
    """The records of :func:`corpuscope.operators.corpus.extract_stage` for files of any size, in several tasks each.

    Columns: path, filename, size, lines, extractedAt, parseError, wordCount, preview. JSON files have no ``jsonData``
    column, which one value could not hold: :func:`read_json_members` has it member by member; their
    ``parseError`` is told by the same reading. A byte order mark counts as a character of the file.
    """
    with range_size(spark, range_bytes):
        pieces = stored(_packed(read_pieces(spark, path, recursive=recursive), range_bytes), "lines")
    lines = number_lines(pieces)
    counted = pieces.groupBy("path").agg(
        F.sum(char_count(F.col("piece")) + 1).alias("size"),
        (F.count(F.lit(1)) + 1).alias("lines"),
        F.sum(count_words(F.col("piece"))).alias("words"),
        (F.sum(F.octet_length("piece") + F.lit(1).cast("long")) - F.max("length")).alias("_over"),
    )
    packed = F.col("path").rlike(PACKED)
    unended = F.when(~packed & F.col("_over").isin(1, -2), 1).otherwise(0)
    mark = F.when(~packed & F.col("_over").isin(-2, -3), 1).otherwise(0)
    # every line has a sign, its end, so no more lines than signs are asked for
    head = lines.filter(F.col("line_no") <= preview).withColumn("line", F.substring("line", 1, preview))
    heads = head.groupBy("path").agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY line_no)").alias("_head"))
    is_json = has_extension(F.col("filename"), [JSON_SUFFIX])
    begun = F.concat(F.when(F.col("_mark") == 1, "﻿").otherwise(""), F.col("_head"), F.lit("\n"))
    records = counted.withColumns({"_mark": mark, "_unended": unended}).join(heads, "path").select(
        "path",
        base_name(F.col("path")).alias("filename"),
        (F.col("size") - F.col("_unended") + F.col("_mark")).alias("size"),
        (F.col("lines") - F.col("_unended")).alias("lines"),
        run_time(run_ts).alias("extractedAt"),
        "words",
        # the last line's end is there only if the file has one
        F.substring(begun, F.lit(1), F.least(F.lit(preview).cast("long"), F.col("size") - F.col("_unended") + F.col("_mark")).cast("int")).alias("_begun"),
    )
    broken = _json_files(spark, path, recursive, range_bytes)
    return records.join(broken, "path", "left").select(
        "path", "filename", "size", "lines", "extractedAt",
        F.when(is_json, F.col("_error")).alias("parseError"),
        F.when(~is_json, F.col("words")).alias("wordCount"),
        F.when(~is_json, preview_chars(F.col("_begun"), preview)).alias("preview"),
    )


def _json_files(spark: SparkSession, path: str | list[str], recursive: bool, range_bytes: int | None) -> DataFrame:
    """path and _error of the JSON files among those of a folder; no other file is opened."""
    found = _members(spark, path, recursive, range_bytes, f"*{JSON_SUFFIX}")
    return found.groupBy("path").agg(F.min("error").alias("_error"))


# ---- JSON

_BLANKS = r"[ \t\n\r]*"


def _outside(piece: Column, quoted: bool) -> Column:
    """What stands outside strings, for a piece that begins outside or inside one; escapes are gone already."""
    return F.regexp_replace(F.concat(F.lit('"'), piece) if quoted else piece, r'(?s)"[^"]*+("|$)', "")


def _depth(outside: Column) -> Column:
    """Brackets that a text opens beyond those it closes."""
    opened = F.length(outside) - F.length(F.translate(outside, "[{", ""))
    return (opened - (F.length(outside) - F.length(F.translate(outside, "]}", "")))).cast("long")


def _running(pieces: DataFrame, value: str, name: str) -> DataFrame:
    """Add the sum of a value over all pieces of the file up to and with each piece."""
    here = W.partitionBy("path", "range_start").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("path").orderBy("range_start").rowsBetween(W.unboundedPreceding, -1)
    totals = pieces.groupBy("path", "range_start").agg(F.sum(value).alias("_total"))
    starts = totals.select("path", "range_start", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_start"))
    within = pieces.withColumn(name, F.sum(value).over(here))
    return within.join(starts, ["path", "range_start"]).withColumn(name, F.col(name) + F.col("_start")).drop("_start")


def _members(
    spark: SparkSession, path: str | list[str], recursive: bool, range_bytes: int | None, names: str = "*"
) -> DataFrame:
    """path, kind, position, text, name, value, error: every member of every file, checked by itself."""
    with range_size(spark, range_bytes):
        pieces = _packed(read_pieces(spark, path, ",", recursive, names), range_bytes)
        # an escape cannot lie across a comma, as no comma can be escaped
        plain = F.regexp_replace("piece", r"(?s)\\.", "")
        pieces = pieces.withColumn("_plain", plain).withColumns(
            {
                "_quotes": (F.length("_plain") - F.length(F.translate("_plain", '"', ""))).cast("long"),
                "_free": _depth(_outside(F.col("_plain"), False)),
                "_held": _depth(_outside(F.col("_plain"), True)),
            }
        )
        pieces = stored(pieces.drop("_plain"), "pieces")
    quoted = _running(pieces, "_quotes", "_closed")
    begun_inside = (F.col("_closed") - F.col("_quotes")) % 2 == 1
    nested = quoted.withColumn("_delta", F.when(begun_inside, F.col("_held")).otherwise(F.col("_free")))
    nested = nested.withColumn("_open", F.col("_closed") % 2 == 1).drop("_quotes", "_free", "_held", "_closed")
    nested = _running(stored(nested, "nested"), "_delta", "_level")
    # the comma behind a piece divides two members if no string is open and one bracket is
    split = F.when(~F.col("_open") & (F.col("_level") == 1), 1).otherwise(0).cast("long")
    divided = stored(nested.withColumn("_split", split), "levels")
    counted = _running(divided, "_split", "_splits").withColumn("position", F.col("_splits") - F.col("_split"))

    order = F.struct(*PLACE)
    ends = divided.groupBy("path").agg(
        F.min_by("piece", order).alias("_begin"), F.max_by("piece", order).alias("_end"),
        F.max_by(F.struct("_open", "_level"), order).alias("_last"), F.max("length").alias("_length"),
        F.sum(F.octet_length("piece") + F.lit(1).cast("long")).alias("_bytes"), F.sum("_split").alias("_last_position"),
    )
    first_sign = F.regexp_extract("_begin", f"^{_BLANKS}([\\[{{])", 1)
    last_sign = F.regexp_extract("_end", f"([\\]}}]){_BLANKS}$", 1)
    kind = F.when(first_sign == "[", "array").when(first_sign == "{", "object").otherwise("value")
    # the reader drops a byte order mark and has no piece behind a last comma; JSON allows neither
    more = ~F.col("path").rlike(PACKED) & (F.col("_bytes") != F.col("_length") + 1)
    whole = ~F.col("_last._open") & (F.col("_last._level") == 0) & ~more
    closed = F.when(kind == "array", last_sign == "]").when(kind == "object", last_sign == "}").otherwise(True)
    ends = ends.select("path", kind.alias("kind"), (whole & closed).alias("_sound"), "_last_position")

    texts = counted.groupBy("path", "position").agg(F.expr("listagg(piece, ',') WITHIN GROUP (ORDER BY range_start, place)").alias("text"))
    texts = texts.join(ends, "path")
    lists = F.col("kind") != "value"
    head = F.when(lists & (F.col("position") == 0), F.regexp_replace("text", f"^{_BLANKS}[\\[{{]", "")).otherwise(F.col("text"))
    texts = texts.withColumn("text", head)
    tail = F.when(lists & (F.col("position") == F.col("_last_position")), F.regexp_replace("text", f"[\\]}}]{_BLANKS}$", ""))
    texts = texts.withColumn("text", F.coalesce(tail, F.col("text")))
    # brackets around nothing hold no member
    empty = lists & (F.col("_last_position") == 0) & F.col("text").rlike(f"^{_BLANKS}$")
    texts = texts.withColumn("_empty", empty)

    pair = F.concat(F.lit("{"), F.col("text"), F.lit("}"))
    is_pair = F.col("kind") == "object"
    entry = F.when(is_pair, F.from_json(pair, "map<string,variant>", NO_LIMITS))
    read = with_json(texts.withColumn("_entry", entry), "_value", F.col("text"), ~is_pair)
    entries = F.map_entries("_entry")
    sole = F.get(entries, F.lit(0))
    value = F.when(is_pair, sole["value"]).otherwise(F.col("_value"))
    named = F.when(~valid_json(pair), PARSE_ERROR).when(F.col("_entry").isNull(), TOO_LARGE).when(F.size("_entry") != 1, PARSE_ERROR)
    error = (
        F.when(~F.col("_sound"), PARSE_ERROR)
        .when(~F.col("_empty"), F.when(is_pair, named).otherwise(json_error(F.col("_value"), F.col("text"))))
    )
    return stored(
        read.select("path", "kind", F.when(~F.col("_empty"), F.col("position")).alias("position"), "text", sole["key"].alias("name"), value.alias("value"), error.alias("error")),
        "members",
    )


def read_json_members(
    spark: SparkSession, path: str | list[str], recursive: bool = False, range_bytes: int | None = None
) -> DataFrame:
    """JSON files of any size, a row for each member of the top-level array or object: path, filename, kind, position,
    name, value, text, parseError.

    ``kind`` is array, object or value (a file that is one plain value). Members count from 0; those of an object have a
    name. A name given twice keeps its first place and its last value. A file that is not JSON as a whole has one row with a
    ``parseError`` and nothing else; an empty array or object has one row without position and value. A member that is
    more than a variant holds (128 MB) has no value and an error of its own, but its text.

    A file that Spark unpacks because of its name may end in a comma, or begin with a byte order mark, unseen.

    The text is cut at every comma, wherever byte ranges end. Open quotes and open brackets at each piece come
    from running sums, so a file is read by as many tasks as it has ranges; the commas at the outer level divide the
    members, and only what belongs to one member meets in one row (2 GB).
    """
    found = _members(spark, path, recursive, range_bytes)
    broken = found.filter(F.col("error") == PARSE_ERROR).select("path").distinct()
    sound = found.join(broken, "path", "left_anti")
    objects = sound.filter("kind = 'object' and name is not null").groupBy("path", "kind", "name").agg(
        F.min("position").alias("position"),
        F.max_by(F.struct("text", "value", "error"), F.col("position")).alias("_latest"),
    )
    columns = ("path", "kind", "position", "name", "text", "value", "error")
    objects = objects.select("path", "kind", "position", "name", "_latest.text", "_latest.value", "_latest.error").select(*columns)
    others = sound.filter("kind <> 'object' or name is null").select(*columns)
    lost = broken.select("path", *(F.lit(None).cast(t).alias(n) for n, t in _KINDS), F.lit(PARSE_ERROR).alias("error"))
    return (
        objects.union(others)
        .union(lost.select(*columns))
        .select("path", base_name(F.col("path")).alias("filename"), "kind", "position", "name", "value", "text", F.col("error").alias("parseError"))
    )


_KINDS = (("kind", "string"), ("position", "bigint"), ("name", "string"), ("text", "string"), ("value", "variant"))
