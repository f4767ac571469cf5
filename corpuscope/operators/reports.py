"""Text reports as rows of numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.binding import once
from corpuscope.functions.jsontext import (
    NO_LIMITS,
    NULL,
    NUMBERS,
    OBJECT,
    TOO_LARGE,
    json_error,
    kind,
    stringify,
    valid_json,
    value_json,
    value_text,
    with_json,
)
from corpuscope.functions.numbers import finite_text
from corpuscope.functions.text import char_count
from corpuscope.operators.ranking import ranked
from corpuscope.session import configure

# Titles and labels of the reports.
RULE = "=" * 40
DATA_TITLE = "Data Processing Report"
JOB_TITLE = "Pipeline Execution Report"
ERRORS_TITLE = "--- Errors ---"


def _text_lines(*lines: str | Column) -> Column:
    return F.array(*(F.lit(line) for line in lines))


# Names that are whole numbers come first, in ascending order, as a script engine lists them.
WHOLE_NAME = r"^(0|[1-9][0-9]{0,9})$"


def _in_order(entries: Column) -> Column:
    """Entries (a struct with ``key``) with whole numbers first."""

    def sorted_entries(given: Column) -> Column:
        def place(entry: Column, i: Column) -> Column:
            number = F.when(entry["key"].rlike(WHOLE_NAME), entry["key"].cast("bigint"))
            return F.struct(number.isNull().alias("named"), F.coalesce(number, F.lit(0)).alias("number"), i.alias("i"))

        places = F.array_sort(F.transform(given, place))
        return F.transform(places, lambda at: F.get(given, at["i"]))

    def in_order(given: Column) -> Column:
        whole = F.exists(given, lambda entry: entry["key"].rlike(WHOLE_NAME))
        return F.when(whole, sorted_entries(given)).otherwise(given)

    return once(entries, in_order)


def _members(text: Column, raw: bool) -> Column:
    """Members of the object in a JSON text: key, value (VARIANT) and, if asked for, the raw text of each.

    Both readings list the members in the text's order, so an entry carries all of its
    member. A name given twice keeps its first place and its last value.
    """

    def read(values: Column) -> Column:
        joined = F.map_entries(values)
        if raw:
            texts = F.map_values(F.from_json(text, "map<string,string>", NO_LIMITS))
            joined = F.zip_with(
                joined, texts, lambda e, r: F.struct(e["key"].alias("key"), e["value"].alias("value"), r.alias("raw"))
            )
        names = F.map_keys(values)
        last = F.transform(
            F.array_distinct(names),
            lambda name: F.element_at(F.filter(joined, lambda e: e["key"] == name), -1),
        )
        return F.when(F.size(F.array_distinct(names)) < F.size(names), last).otherwise(joined)

    return once(F.from_json(text, "map<string,variant>", NO_LIMITS), read)


def _items(values: Column, texts: Column | None) -> Column:
    """Items of an array as entries, their places as keys."""
    texts = F.transform(values, lambda _: F.lit(None).cast("string")) if texts is None else texts
    pairs = F.zip_with(values, texts, lambda v, t: F.struct(v.alias("value"), t.alias("raw")))
    return F.transform(
        pairs, lambda e, i: F.struct(i.cast("string").alias("key"), e["value"].alias("value"), e["raw"].alias("raw"))
    )


def _entries(text: Column) -> Column:
    """What a report has a block or line for: members of an object, items of an array, characters of a string."""
    start = F.substring(F.ltrim(text), 1, 1)
    items = once(
        F.from_json(text, "array<variant>", NO_LIMITS),
        lambda values: _items(values, F.from_json(text, "array<string>", NO_LIMITS)),
    )
    letters = F.to_variant_object(F.filter(F.split(F.get_json_object(text, "$"), ""), lambda c: c != ""))
    return (
        F.when(start == "{", _in_order(_members(text, raw=True)))
        .when(start == "[", items)
        .when(start == '"', _items(F.try_variant_get(letters, "$", "array<variant>"), None))
    )


def _nested_lines(name: Column, raw: Column) -> Column:
    """Lines of a nested object; ``raw`` is its JSON text, which has the members in their order."""
    rows = F.transform(
        _in_order(_members(raw, raw=False)), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), value_text(e["value"]))
    )
    return F.concat(F.array(F.lit(""), F.concat(name, F.lit(":"))), F.coalesce(rows, F.array().cast("array<string>")))


def report_lines(df: DataFrame, key: str, json_col: str, run_ts: str, output: str = "text") -> DataFrame:
    """Report of each JSON text as rows: key, seq, line_no, line; in that order it reads from top to bottom.

    ``seq`` 0 is the head, then every member of an object (whole-number names first,
    the others in the text's order), item of an array or character of a string, nested
    objects one level down, then the foot. ``output="json"`` prints the value instead.
    Texts that are not JSON have no report.

    The text is checked in one pass and read once for the values and once for the raw texts
    of the members; each row then carries its own member, so the work grows with the
    number of members.
    """
    text = F.col(json_col)
    if output == "json":
        parsed = with_json(df, "_value", text)
        large = F.when(json_error(F.col("_value"), text) == TOO_LARGE, text)
        line = F.coalesce(value_json(F.col("_value")), large)
        rows = parsed.select(key, F.lit(0).alias("seq"), F.lit(0).alias("line_no"), line.alias("line"))
        return rows.where(F.col("line").isNotNull())
    configure(df.sparkSession)
    entry = "array<struct<key:string,value:variant,raw:string>>"
    none = F.array(F.lit(None).cast("struct<key:string,value:variant,raw:string>"))
    listed = F.coalesce(_entries(text), F.array().cast(entry))
    # missing entries stand for head and foot; none at all where the text is no JSON
    prepared = df.select(key, F.when(valid_json(text), F.concat(none, listed, none)).alias("_entries"))
    # the output of a generator stays where it is: a filter below it would read the text again
    members = prepared.select(key, F.posexplode_outer("_entries").alias("seq", "_entry")).where(F.col("seq").isNotNull())
    return _lines_of(members.select(key, "seq", F.col("_entry.key").alias("_name"), F.col("_entry.value").alias("_item"),
                                    F.col("_entry.raw").alias("_raw")), key, run_ts)


def _lines_of(members: DataFrame, key: str, run_ts: str) -> DataFrame:
    """The lines of head (``seq`` 0), members and foot (no ``_name``)."""
    # one step each, so that no expression is copied into the next
    members = members.withColumn("_kind", kind(F.col("_item")))
    name, item = F.col("_name"), F.col("_item")
    number = F.coalesce(finite_text(F.try_variant_get(item, "$", "double")), F.lit("null"))
    printed = F.when(F.col("_kind").isin(*NUMBERS), number).otherwise(F.to_json(item))
    lines = (
        F.when(F.col("seq") == 0, _text_lines(RULE, DATA_TITLE, RULE, f"Generated: {run_ts}", ""))
        .when(name.isNull(), _text_lines("", RULE))
        .when(F.col("_kind").isin(OBJECT, NULL), _nested_lines(name, F.col("_raw")))
        .otherwise(F.array(F.concat(name, F.lit(": "), F.coalesce(printed, F.col("_raw")))))
    )
    return members.select(key, "seq", F.posexplode_outer(lines).alias("line_no", "line"))


def report_members(members: DataFrame, key: str, run_ts: str) -> DataFrame:
    """The rows of :func:`report_lines` for JSON of any size, which is given member by member.

    ``members`` is what :func:`corpuscope.sources.ranges.read_json_members` returns, ``key`` one of its columns that tells the
    files apart. Files that are not JSON have no report, an empty array or object one of head and foot; plain values none but
    these. A member beyond a variant prints as its text. The place of a member among all of its file comes
    from a global order, so no task sees a file whole.
    """
    sound = members.filter(F.col("kind").isNotNull())
    given = sound.filter("position is not null and kind <> 'value'")
    name = F.coalesce("name", F.col("position").cast("string"))
    number = F.when(F.col("name").rlike(WHOLE_NAME), F.col("name").cast("bigint"))
    pair = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,string>", NO_LIMITS)
    raw = F.when(F.col("kind") == "object", F.get(F.map_values(pair), F.lit(0))).otherwise(F.col("text"))
    placed = ranked(
        given.select(
            key, name.alias("_name"), F.col("value").alias("_item"), raw.alias("_raw"),
            number.isNull().alias("_named"), F.coalesce(number, F.lit(0)).alias("_number"), "position",
        ),
        [key, "_named", "_number", "position"],
        "_rank",
    )
    counts = placed.groupBy(key).agg(F.min("_rank").alias("_first"), F.max("_rank").alias("_last"))
    entries = placed.join(counts, key).select(key, (F.col("_rank") - F.col("_first") + 1).alias("seq"), "_name", "_item", "_raw")
    ends = sound.select(key).distinct().join(counts, key, "left")
    foot = F.coalesce(F.col("_last") - F.col("_first") + 2, F.lit(1)).cast("bigint")
    nothing = (F.lit(None).cast("string").alias("_name"), F.lit(None).cast("variant").alias("_item"), F.lit(None).cast("string").alias("_raw"))
    around = ends.select(key, F.explode(F.array(F.lit(0).cast("bigint"), foot)).alias("seq"), *nothing)
    return _lines_of(entries.union(around), key, run_ts)


def report_sizes(lines: DataFrame, key: str, output: str = "text") -> DataFrame:
    """The result row of each report of :func:`report_lines`: key, format, size in UTF-16 units with line ends."""
    return lines.groupBy(key).agg(
        F.lit(output).alias("format"), F.sum(char_count(F.col("line")) + (1 if output == "text" else 0)).alias("size")
    )


def stage_report(
    runs: DataFrame, stages: DataFrame, errors: DataFrame | None = None, result: str = "result"
) -> DataFrame:
    """Report of each run as rows: run, part, seq, line_no, line; in that order it reads from top to bottom.

    ``runs`` has run, startTime and endTime; ``stages`` has run, seq (from 0),
    stage and a result struct; ``errors`` has run, seq and message. Nothing is
    gathered per run, and only the stage count is aggregated.
    """
    counts = stages.groupBy("run").agg(F.count("*").alias("_stages"))
    head = runs.join(counts, "run", "left")
    total = F.coalesce("_stages", F.lit(0)).cast("string")
    parts = [
        _rows(
            head,
            0,
            F.lit(0),
            _text_lines(
                RULE,
                JOB_TITLE,
                RULE,
                F.concat(F.lit("Start Time: "), "startTime"),
                F.concat(F.lit("End Time: "), "endTime"),
                F.concat(F.lit("Total Stages: "), total),
                "",
            ),
        ),
        _rows(
            stages,
            1,
            F.col("seq"),
            F.concat(
                F.array(
                    F.concat(
                        F.lit("--- Stage "), (F.col("seq") + 1).cast("string"), F.lit(": "), "stage", F.lit(" ---")
                    )
                ),
                F.split(stringify(F.col(result), stages.schema[result].dataType, absent_null=True), "\n"),
                F.array(F.lit("")),
            ),
        ),
        _rows(runs, 4, F.lit(0), _text_lines(RULE)),
    ]
    if errors is not None:
        failed = errors.select("run").distinct()
        parts.append(_rows(failed, 2, F.lit(0), _text_lines(ERRORS_TITLE)))
        parts.append(_rows(errors, 2, F.col("seq") + 1, F.array(F.concat(F.lit("- "), "message"))))
        parts.append(_rows(failed, 3, F.lit(0), _text_lines("")))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def _rows(df: DataFrame, part: int, seq: Column, lines: Column) -> DataFrame:
    return df.select(
        "run",
        F.lit(part).alias("part"),
        seq.cast("bigint").alias("seq"),
        F.posexplode(lines).alias("line_no", "line"),
    )
