"""Queries over the file corpus: sources, rules, stages, aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.functions.jsontext import with_json
from corpuscope.functions.text import count_lines, count_words
from corpuscope.operators.corpus import (
    all_passed,
    collect_documents,
    corpus_averages,
    corpus_totals,
    directory_summary,
    extract_single,
    extract_stage,
    file_type_counts,
    merge_sources,
    merge_summary,
    non_empty,
    preview_files,
    transform_outcomes,
    transform_stage,
)
from corpuscope.operators.items import apply_transform, extract_keys, items_filter, items_map
from corpuscope.operators.reports import report_lines, report_members, report_sizes
from corpuscope.operators.rules import apply_rules, rules_json
from corpuscope.plans.bases import (
    FILES_SQL,
    RECORDS_SQL,
    corpus_files,
    sql_lines,
    sql_trim,
    sql_units,
    sql_words,
)
from corpuscope.plans.corpus_job import corpus_totals_of, run_corpus_job
from corpuscope.plans.incremental_job import run_incremental_job
from corpuscope.plans.registry import query, table
from corpuscope.session import scratch_path, stored
from corpuscope.sources.config import parse_config_lines, read_config_lines
from corpuscope.sources.files import read_json_files, read_text_files, scan_files, sort_listing, text_file_stats
from corpuscope.sources.ranges import extract_ranges, range_size, read_json_members, read_lines
from corpuscope.sources.sinks import write_json, write_text
from corpuscope.sources.versions import current_version

RUN_TS = "2024-01-01T00:00:00Z"

_TOTALS = """CAST(count(*) AS BIGINT) AS "totalFiles", CAST(sum(size) AS BIGINT) AS "totalSize",
    CAST(sum(lines) AS BIGINT) AS "totalLines", CAST(sum(coalesce(wordCount, 0)) AS BIGINT) AS "totalWords" """
_AVERAGES = """CAST(floor(sum(size) / count(*) + 0.5) AS BIGINT) AS "averageSize",
    CAST(floor(sum(lines) / count(*) + 0.5) AS BIGINT) AS "averageLines",
    CAST(floor(sum(coalesce(wordCount, 0)) / count(*) + 0.5) AS BIGINT) AS "averageWords" """


@query(
    "corpus_job",
    f"WITH {RECORDS_SQL} SELECT {_TOTALS}, {_AVERAGES} FROM records",
)
def corpus_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract, transform and aggregate in one pass over the corpus."""
    rules = {name: {"source": name} for name in ("filename", "size", "lines", "wordCount")}
    return corpus_totals_of(corpus_files(spark, sf_dir), rules)


@query(
    "extract_stage",
    f"""WITH {RECORDS_SQL} SELECT filename, size, lines, wordCount AS "wordCount", CASE WHEN jsonData IS NOT NULL THEN
        concat('{{"doc":', jsonData -> '$.doc', ',"filename":', jsonData -> '$.filename', ',"lang":',
            jsonData -> '$.lang', ',"size":', jsonData -> '$.size', '}}') END AS "jsonData",
    parseError AS "parseError", preview FROM records""",
)
def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed JSON is printed by the library, members in order of name."""
    records = extract_stage(corpus_files(spark, sf_dir), RUN_TS).drop("extractedAt")
    return records.withColumn("jsonData", F.to_json("jsonData"))


@query(
    "extract_single",
    f"""WITH {FILES_SQL} SELECT filename, {sql_units("content")} AS size, {sql_lines("content")} AS lines,
    {sql_words("content")} AS "wordCount", NULL AS error FROM files WHERE content <> ''
    UNION ALL SELECT NULL, NULL, NULL, NULL, 'Failed to read file' FROM files WHERE content = ''""",
)
def extracted_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_single(corpus_files(spark, sf_dir), RUN_TS).drop("extractedAt")


@query(
    "preview_files",
    f"""WITH {FILES_SQL} SELECT path AS "filePath", {sql_lines("content")} AS "lineCount",
    {sql_words("content")} AS "wordCount", {sql_units("content")} AS "charCount",
    array_to_string(string_split(content, chr(10))[1:10], chr(10)) AS preview, NULL AS error
    FROM files WHERE content <> ''
    UNION ALL SELECT path, NULL, NULL, NULL, NULL, concat('Failed to read file: ', path) FROM files WHERE content = ''""",
)
def file_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview_files(corpus_files(spark, sf_dir))


@query(
    "non_empty",
    f"WITH {FILES_SQL} SELECT path, filename FROM files WHERE content <> ''",
)
def non_empty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return non_empty(corpus_files(spark, sf_dir)).select("path", "filename")


_RULES = {
    "name": {"source": "filename", "transform": "uppercase"},
    "language": {"source": "lang", "transform": "lowercase"},
    "kilo": {"source": "size", "transform": "multiply", "factor": 0.001},
    "label": {"source": "title", "default": "untitled"},
    "doc": {"source": "doc"},
    "gone": {"source": "nothing"},
}


@query(
    "transform_stage",
    f"""WITH {FILES_SQL}, parsed AS (
        SELECT filename, content, json_valid(content) AS ok,
            CASE WHEN json_valid(content) THEN content END AS j FROM files
        WHERE ends_with(filename, '.json') AND content <> '')
    SELECT filename, CASE WHEN ok THEN 'success' ELSE 'error' END AS status,
        CASE WHEN NOT ok THEN 'SyntaxError: not valid JSON' END AS error,
        CASE WHEN ok THEN filename END AS "outputName",
        CASE WHEN ok THEN concat('{{"name":"', upper(j ->> '$.filename'), '","language":"', lower(j ->> '$.lang'),
            '","label":"untitled","doc":', j ->> '$.doc', '}}') END AS result,
        CASE WHEN ok THEN CAST(j ->> '$.size' AS DOUBLE) * 0.001 END AS kilo
    FROM parsed""",
)
def transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = transform_stage(corpus_files(spark, sf_dir), _RULES)
    # number text differs between engines: compare that member as a number
    kilo = F.get_json_object("result", "$.kilo").cast("double").alias("kilo")
    return result.select(
        "filename", "status", "error", "outputName",
        F.regexp_replace("result", r',"kilo":[^,}]+', "").alias("result"), kilo,
    )


@query(
    "transform_outcomes",
    f"""WITH {FILES_SQL} SELECT CASE WHEN json_valid(content) THEN 'success' ELSE 'error' END AS status,
    CAST(count(*) AS BIGINT) AS files FROM files WHERE ends_with(filename, '.json') AND content <> '' GROUP BY 1""",
)
def transform_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform_outcomes(transform_stage(corpus_files(spark, sf_dir), _RULES))


@query(
    "corpus_totals",
    f"WITH {RECORDS_SQL} SELECT {_TOTALS} FROM records",
)
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_totals(extract_stage(corpus_files(spark, sf_dir), RUN_TS))


@query(
    "corpus_averages",
    f"WITH {RECORDS_SQL} SELECT {_AVERAGES} FROM records",
)
def averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_averages(extract_stage(corpus_files(spark, sf_dir), RUN_TS))


@query(
    "file_type_counts",
    f"""WITH {FILES_SQL} SELECT CASE WHEN doc_id % 9 = 0 THEN 'unknown' ELSE string_split(filename, '.')[-1] END
    AS extension, CAST(count(*) AS BIGINT) AS files FROM files GROUP BY 1""",
)
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus_files(spark, sf_dir)
    return file_type_counts(files.withColumn("filename", F.expr("CASE WHEN doc_id % 9 <> 0 THEN filename END")))


@query(
    "collect_documents",
    f"""WITH {RECORDS_SQL} SELECT filename, size, lines, wordCount AS "wordCount",
    row_number() OVER (ORDER BY filename, doc_id) AS rank FROM records""",
)
def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all documents with their place in listing order."""
    records = extract_stage(corpus_files(spark, sf_dir), RUN_TS).select("filename", "size", "lines", "wordCount")
    return collect_documents(records, rank="rank")


_SOURCES = """SELECT concat('/props/', event_id) AS path, CASE event_id % 6
    WHEN 0 THEN concat(props, ',') WHEN 1 THEN '' ELSE props END AS content FROM events"""


def _event_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('/props/', event_id) AS path",
        "CASE event_id % 6 WHEN 0 THEN concat(props, ',') WHEN 1 THEN '' ELSE props END AS content",
    )


@query(
    "merge_sources",
    f"""SELECT path, CAST(json(content) AS VARCHAR) AS data, NULL AS error FROM ({_SOURCES})
    WHERE content <> '' AND json_valid(content)""",
)
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_sources(_event_sources(spark, sf_dir)).withColumn("data", F.to_json("data"))


@query(
    "merge_summary",
    f"""SELECT CAST(count(*) AS BIGINT) AS sources,
    CAST(count(*) FILTER (content <> '' AND json_valid(content)) AS BIGINT) AS merged,
    CAST(0 AS BIGINT) AS "tooLarge" FROM ({_SOURCES})""",
)
def merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_summary(_event_sources(spark, sf_dir))


_FLAGS = ["success", "exists", "contentMatches"]
_FLAGS_SQL = [
    "CASE WHEN turn % 5 = 4 THEN NULL ELSE length(text) > 40 END AS success",
    "CASE WHEN role = 'system' THEN text <> '' END AS exists",
    "CASE WHEN role = 'assistant' THEN text LIKE '%.%' END AS contentMatches",
]


@query(
    "all_passed",
    f"""SELECT conv_id, bool_and(coalesce(success, true) AND coalesce("exists", true)
        AND coalesce(contentMatches, true)) AS "allPassed"
    FROM (SELECT conv_id, {', '.join(_FLAGS_SQL).replace('AS exists', 'AS "exists"')} FROM conversations)
    GROUP BY conv_id""",
)
def runs_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", *_FLAGS_SQL)
    return all_passed(rows, "conv_id", _FLAGS)


@query(
    "directory_summary",
    f"""WITH {FILES_SQL} SELECT regexp_extract(path, '^(.*)/', 1) AS directory,
    CAST(count(*) AS BIGINT) AS "totalItems", CAST(sum(strlen(content)) AS BIGINT) AS "totalSize"
    FROM files GROUP BY 1""",
)
def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a manifest; empty files count as items."""
    return directory_summary(
        corpus_files(spark, sf_dir).select("path", F.octet_length("content").cast("bigint").alias("length"))
    )


# ---- rules and item transforms

_EVENT_RULES = {
    "label": {"source": "event_type", "transform": "uppercase"},
    "kind": {"source": "event_type", "transform": "lowercase"},
    "cents": {"source": "value", "transform": "multiply", "factor": 100},
    "same": {"source": "value", "transform": "multiply", "factor": 0},
    "whole": {"source": "value", "transform": "round"},
    "id": {"source": "event_id"},
    "passed": {"source": "user_id", "transform": "reverse"},
    "filled": {"source": "missing", "default": "none"},
    "gone": {"source": "missing"},
}


@query(
    "apply_rules",
    """SELECT upper(event_type) AS label, lower(event_type) AS kind, value * 100 AS cents, value AS same,
    floor(value) + CASE WHEN value - floor(value) >= 0.5 THEN 1 ELSE 0 END AS whole, event_id AS id,
    user_id AS passed, 'none' AS filled FROM events""",
)
def ruled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "events"), _EVENT_RULES)


_MEMBERS = """CASE event_id % 6
    WHEN 0 THEN concat('{"k":null,"t":"', event_type, '"}')
    WHEN 1 THEN concat('{"j":', user_id, '}')
    WHEN 2 THEN concat('{"k":"  ', user_id, ' ","t":[1,"b",null]}')
    WHEN 3 THEN '{"k":"many","t":{"a":1}}'
    WHEN 4 THEN concat('{"k":', CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END, ',"t":null}')
    ELSE props END"""


@query(
    "rule_default",
    """SELECT event_id, concat('{"n":', CASE event_id % 6
        WHEN 0 THEN '0' WHEN 1 THEN '-1' WHEN 2 THEN CAST(user_id * 2 AS VARCHAR) WHEN 3 THEN 'null'
        WHEN 4 THEN CASE WHEN user_id % 2 = 0 THEN '2' ELSE '0' END
        ELSE CAST(CAST(props ->> '$.k' AS BIGINT) * 2 AS VARCHAR) END,
    ',"t":', CASE event_id % 6 WHEN 0 THEN concat('"', upper(event_type), '"') WHEN 2 THEN '"1,B,"'
        WHEN 3 THEN '"[OBJECT OBJECT]"' WHEN 4 THEN '"NULL"' ELSE '{"d":[1]}' END, '}') AS record FROM events""",
)
def rule_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent members take the default, JSON null does not."""
    rules = {
        "n": {"source": "k", "transform": "multiply", "factor": 2, "default": -1},
        "t": {"source": "t", "transform": "uppercase", "default": {"d": [1]}},
    }
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_MEMBERS).alias("text"))
    parsed = with_json(rows, "value", F.col("text"))
    return parsed.select("event_id", rules_json(F.col("value"), rules).alias("record"))


@query(
    "items_filter",
    """SELECT conv_id, turn, array_to_string(list_filter(string_split(text, ' '),
    lambda w: length(w) > 4 AND w LIKE '%e%'), ' ') AS words FROM conversations""",
)
def filtered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("words"))
    kept = items_filter(words, "words", "length(item) > 4 AND item LIKE '%e%'")
    return kept.withColumn("words", F.array_join("words", " "))


@query(
    "items_map",
    """SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ' '),
    lambda w: concat(substring(w, 1, 3), length(w))), ' ') AS words FROM conversations""",
)
def mapped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("words"))
    changed = items_map(words, "words", "concat(substring(item, 1, 3), length(item))")
    return changed.withColumn("words", F.array_join("words", " "))


_VALUES = """CASE event_id % 4
    WHEN 0 THEN concat('[', user_id, ',', event_id, ',', event_id % 7, ']')
    WHEN 1 THEN concat('{"a":', user_id, ',"b":null,"c":"', event_type, '"}')
    WHEN 2 THEN 'null' ELSE concat('"', event_type, '"') END"""


def _json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_VALUES).alias("text"))
    return with_json(rows, "data", F.col("text")).select("event_id", "data")


@query(
    "extract_keys",
    """SELECT event_id, CASE event_id % 4
        WHEN 0 THEN concat('{"0":', user_id, ',"length":3}')
        WHEN 1 THEN concat('{"b":null,"c":"', event_type, '"}')
        WHEN 3 THEN concat('"', event_type, '"') END AS data FROM events""",
)
def extracted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    reduced = extract_keys(_json_values(spark, sf_dir), "data", ["c", "b", "0", "length", "zz"])
    return reduced.withColumn("data", F.to_json("data"))


@query(
    "apply_transform",
    """SELECT event_id, CASE event_id % 4
        WHEN 0 THEN concat('[', array_to_string(list_filter([user_id, event_id, event_id % 7],
            lambda n: n % 2 = 0), ','), ']')
        WHEN 1 THEN concat('{"a":', user_id, ',"b":null}')
        WHEN 3 THEN concat('"', event_type, '"') END AS data FROM events""",
)
def transformed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three transforms given: arrays are filtered, the rest is reduced to keys."""
    spec = {"filter": "item::bigint % 2 = 0", "map": "item::bigint + 1", "extract": ["b", "a"]}
    return apply_transform(_json_values(spark, sf_dir), "data", spec).withColumn("data", F.to_json("data"))


# ---- sources and sinks: the corpus written to the shared folder as text files


_folders: dict[tuple[str, str], str] = {}


def _text_folder(spark: SparkSession, sf_dir: str) -> str:
    """The documents as text files, a folder per language, one file per task and language.

    Written once per session, for all queries that read it.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _folders:
        path = scratch_path(spark, "documents")
        documents = table(spark, sf_dir, "documents").select("lang", F.col("text").alias("value"))
        documents.write.partitionBy("lang").text(path)
        _folders[key] = path
    return _folders[key]


# A folder for each 200 documents, with one file in it.
_SHARD = "concat('d', lpad(CAST({} AS {}), 9, '0'))"
_shards: dict[tuple[str, str], str] = {}


def _shard_folder(spark: SparkSession, sf_dir: str) -> str:
    """The documents as text files in folders of known names, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _shards:
        path = scratch_path(spark, "shards")
        shard = F.expr(_SHARD.format("doc_id DIV 200", "STRING"))
        documents = table(spark, sf_dir, "documents").select(shard.alias("shard"), F.col("text").alias("value"))
        documents.repartition("shard").write.partitionBy("shard").text(path)
        _shards[key] = path
    return _shards[key]


@query(
    "scan_files",
    f"""SELECT concat('shard=', {_SHARD.format("doc_id // 200", "VARCHAR")}) AS folder, '.txt' AS extension,
        CAST(sum(strlen(text) + 1) AS BIGINT) AS length,
        row_number() OVER (ORDER BY {_SHARD.format("doc_id // 200", "VARCHAR")}) AS rank
    FROM documents GROUP BY doc_id // 200""",
)
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of the listing by its folder, with its length and its place in order of path."""
    listing = scan_files(spark, _shard_folder(spark, sf_dir), recursive=True, extensions=[".txt"])
    return sort_listing(listing, "path").select(
        F.regexp_extract("path", "/([^/]*)/[^/]*$", 1).alias("folder"),
        F.regexp_extract("name", r"\.[^.]*$", 0).alias("extension"),
        "length",
        "rank",
    )


@query(
    "sort_by_name",
    f"""WITH {FILES_SQL} SELECT path, filename AS name, row_number() OVER (ORDER BY filename, path) AS rank FROM files""",
)
def sorted_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every file of the corpus in order of name, and of path where names repeat."""
    manifest = corpus_files(spark, sf_dir).select("path", F.col("filename").alias("name"))
    return sort_listing(manifest)


def listing_order(listing: DataFrame) -> DataFrame:
    """Prefix and folders of a listing, and whether its rows stand in the order of name and path.

    Neighbours are compared within each task, and the first row of each task with the greatest
    of all tasks before it, for which one row per task is enough.
    """
    place = F.struct(F.col("name").alias("name"), F.col("path").alias("path"))
    numbered = listing.select("path", "name", F.monotonically_increasing_id().alias("position"), place.alias("place"))
    # rows of a task stand together in the numbering
    numbered = numbered.withColumn("task", F.shiftright("position", 33))
    within = W.partitionBy("task").orderBy("position")
    checked = numbered.withColumn("later", F.coalesce(F.lag("place").over(within) < F.col("place"), F.lit(True)))
    tasks = checked.groupBy("task").agg(F.min_by("place", "position").alias("first"), F.max("place").alias("last"))
    before = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    between = F.coalesce(F.max("last").over(before) < F.col("first"), F.lit(True))
    nothing = F.lit(None).cast("string")
    rows = checked.select(
        F.substring("name", 1, 5).alias("prefix"), F.regexp_extract("path", "/([^/]*)/[^/]*$", 1).alias("folder"), "later"
    ).union(tasks.select(nothing, nothing, between))
    return rows.agg(
        F.min("prefix").alias("prefix"), F.count_distinct("folder").alias("folders"), F.bool_and("later").alias("ordered")
    )


@query(
    "text_file_stats",
    f"""SELECT lang, CAST(sum({sql_units("text")} + 1) AS BIGINT) AS size, CAST(sum({sql_words("text")}) AS BIGINT)
        AS words, CAST(sum({sql_lines("text")}) AS BIGINT) AS lines FROM documents GROUP BY lang""",
)
def line_based_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of text files that need not fit a row, summed by folder."""
    stats = text_file_stats(spark, _text_folder(spark, sf_dir), recursive=True)
    return stats.groupBy(F.regexp_extract("path", "/lang=([^/]*)/", 1).alias("lang")).agg(
        F.sum("size").alias("size"), F.sum("wordCount").alias("words"), F.sum(F.col("lines") - 1).alias("lines")
    )


@query(
    "corpus_job_with_rules",
    f"""WITH {RECORDS_SQL} SELECT upper(filename) AS name, CAST(size * 2 AS DOUBLE) AS twice, 'none' AS note
    FROM records WHERE NOT ends_with(filename, '.json')""",
)
def job_with_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records through real rules; each keeps its file's path on the way."""
    rules = {
        "name": {"source": "filename", "transform": "uppercase"},
        "twice": {"source": "size", "transform": "multiply", "factor": 2},
        "note": {"source": "title", "default": "none"},
        "gone": {"source": "nothing"},
    }
    records = extract_stage(corpus_files(spark, sf_dir), RUN_TS, keep=("path",))
    ruled = apply_rules(records, rules, keep=("path",))
    return ruled.where("NOT endswith(path, '.json')").drop("path")


@query(
    "read_text_files",
    f"""SELECT lang, CAST(sum({sql_words("text")}) AS BIGINT) AS words,
    CAST(sum({sql_lines("text")}) AS BIGINT) AS lines FROM documents GROUP BY lang""",
)
def read_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and lines per folder, from whole files; each file ends in a newline."""
    files = read_text_files(spark, _text_folder(spark, sf_dir), recursive=True)
    lang = F.regexp_extract("path", "/lang=([^/]*)/", 1)
    return files.groupBy(lang.alias("lang")).agg(
        F.sum(count_words(F.col("content"))).alias("words"), F.sum(count_lines(F.col("content")) - 1).alias("lines")
    )


@query(
    "corpus_job_on_files",
    f"""SELECT CAST(sum({sql_units("text")} + 1) AS BIGINT) AS size, CAST(sum({sql_words("text")}) AS BIGINT) AS words,
    CAST(sum({sql_lines("text")}) AS BIGINT) AS newlines, 'txt' AS extension FROM documents""",
)
def job_on_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job on text files, with its stage tables and report.

    How many files the documents make depends on the cluster, so newlines are
    compared instead of lines.
    """
    output = scratch_path(spark, "job")
    total = run_corpus_job(spark, f"{_text_folder(spark, sf_dir)}/*", output, run_ts=RUN_TS)
    types = spark.read.json(f"{output}/file_types")
    return total.join(types, total.totalFiles == types.files).select(
        F.col("totalSize").alias("size"),
        F.col("totalWords").alias("words"),
        (F.col("totalLines") - F.col("totalFiles")).alias("newlines"),
        "extension",
    )


def _placed(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Add ``place`` (from 1) and ``last`` within each group; a group lies in one task, in order, and is written as one file.

    The window asks for that itself. A join to the ends of each group with a ``repartition`` behind it would not: the
    planner leaves the latter out, as the join has dealt the rows already, and then broadcasts the ends and
    reads the rows task by task as they were written.
    """
    here = W.partitionBy(*group).orderBy(order)
    placed = rows.withColumns({"place": F.row_number().over(here), "last": F.lead(order).over(here).isNull()})
    return placed.sortWithinPartitions(*group, order)


@query(
    "read_json_files",
    """SELECT lang, doc_id // 200 AS part, CASE WHEN count(*) % 2 = 0 THEN CAST(count(*) AS BIGINT) END AS n,
    CASE WHEN count(*) % 2 = 0 THEN CAST(sum(n_chars) AS BIGINT) END AS chars,
    CASE WHEN count(*) % 2 = 1 THEN 'SyntaxError: not valid JSON' END AS error FROM documents GROUP BY ALL""",
)
def read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array for each language and 200 documents, with an item for each, cut off if their number is odd.

    The reader gets the items; only then are they counted and summed.
    """
    path = scratch_path(spark, "arrays")
    documents = table(spark, sf_dir, "documents").select(
        # a folder's name is neither null nor empty
        F.coalesce("lang", F.lit("")).alias("lang"), F.expr("doc_id DIV 200").alias("part"), "doc_id", "n_chars"
    )
    line = F.expr(
        """concat(IF(place = 1, '[', ''), '{"doc":', doc_id, ',"chars":', n_chars, '}',
        IF(NOT last, ',', IF(place % 2 = 0, ']', '')))"""
    )
    lines = _placed(documents, ["lang", "part"], "doc_id").select("lang", "part", line.alias("value"))
    lines.write.partitionBy("lang", "part").text(path)
    files = read_json_files(spark, path, recursive=True)
    items = F.try_variant_get("jsonData", "$", "array<struct<doc:bigint,chars:bigint>>")
    return files.select(
        F.nullif(F.regexp_extract("path", "/lang=([^/]*)/", 1), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("lang"),
        F.regexp_extract("path", "/part=([^/]*)/", 1).cast("bigint").alias("part"),
        F.when(items.isNotNull(), F.size(items).cast("bigint")).alias("n"),
        F.aggregate(items, F.lit(0).cast("bigint"), lambda total, item: total + item["chars"]).alias("chars"),
        F.col("parseError").alias("error"),
    )


# ---- files in byte ranges


def _json_files(spark: SparkSession, sf_dir: str, member: str, opening: str, closing: str) -> str:
    """JSON files of one line each with a member for each event, 2,500 in a file."""
    path = scratch_path(spark, "json")
    events = table(spark, sf_dir, "events").select(
        F.expr("event_id DIV 2500").alias("part"), "event_id", F.expr(member).alias("value")
    )
    value = F.expr(f"concat(IF(place = 1, '{opening}', ''), value, IF(last, '{closing}', ','))")
    lines = _placed(events, ["part"], "event_id").select("part", value.alias("value"))
    lines.write.partitionBy("part").option("lineSep", " ").text(path)
    return path


def _part(name: str) -> Column:
    return F.regexp_extract("path", f"/{name}=([^/]*)/", 1).cast("bigint").alias(name)


_ITEM = """concat('{"id":', event_id, ',"text":"', event_type, ',],{\\\\"[","list":[', user_id, ',{"v":', value, '}]}')"""


@query(
    "read_json_members",
    """SELECT event_id // 2500 AS part, event_id, user_id, event_type, value, CAST(row_number() OVER (
        PARTITION BY event_id // 2500 ORDER BY event_id) - 1 AS BIGINT) AS position FROM events""",
)
def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as members of JSON arrays of one line each, read in ranges of 64 KB.

    Their texts hold commas, quotes and brackets.
    """
    members = read_json_members(spark, _json_files(spark, sf_dir, _ITEM, "[", "]"), recursive=True, range_bytes=1 << 16)
    item = F.try_variant_get("value", "$", "struct<id:bigint,text:string,list:array<variant>>")
    return members.select(
        _part("part"),
        item["id"].alias("event_id"),
        F.try_variant_get(F.col("value"), "$.list[0]", "bigint").alias("user_id"),
        F.substring_index(item["text"], ",", 1).alias("event_type"),
        F.try_variant_get(F.col("value"), "$.list[1].v", "double").alias("value"),
        "position",
    )


_MEMBER = """CASE event_id % 3 WHEN 0 THEN concat('"', event_id, '":', user_id)
    WHEN 1 THEN concat('"m', event_id, '":{"user":', user_id, ',"none":null}')
    ELSE concat('"n', event_id, '":"', event_type, ' {["') END"""


@query(
    "report_members",
    """WITH placed AS (SELECT *, event_id // 2500 AS part, row_number() OVER (PARTITION BY event_id // 2500
            ORDER BY event_id % 3 <> 0, event_id) AS seq FROM events),
    lines AS (SELECT part, seq, CASE event_id % 3 WHEN 0 THEN [concat(event_id, ': ', user_id)]
            WHEN 1 THEN ['', concat('m', event_id, ':'), concat('  user: ', user_id), '  none: null']
            ELSE [concat('n', event_id, ': "', event_type, ' {["')] END AS lines FROM placed
        UNION ALL SELECT DISTINCT part, 0, [repeat('=', 40), 'Data Processing Report', repeat('=', 40),
            'Generated: 2024-01-01T00:00:00Z', ''] FROM placed
        UNION ALL SELECT part, max(seq) + 1, ['', repeat('=', 40)] FROM placed GROUP BY part)
    SELECT part, CAST(seq AS BIGINT) AS seq, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_no,
        unnest(lines) AS line FROM lines""",
)
def reports_of_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of JSON objects that together hold all events, read in ranges of 64 KB."""
    members = read_json_members(spark, _json_files(spark, sf_dir, _MEMBER, "{", "}"), recursive=True, range_bytes=1 << 16)
    return report_members(members.withColumn("part", _part("part")), "part", RUN_TS)


def _ordered_shards(spark: SparkSession, sf_dir: str) -> str:
    """The documents in order of id as text files, a folder and a file for each 200."""
    path = scratch_path(spark, "ordered")
    documents = table(spark, sf_dir, "documents").select(
        F.expr("doc_id DIV 200").alias("shard"), "doc_id", F.col("text").alias("value")
    )
    ordered = documents.repartition("shard").sortWithinPartitions("shard", "doc_id").select("shard", "value")
    ordered.write.partitionBy("shard").text(path)
    return path


@query(
    "read_lines",
    """WITH numbered AS (SELECT doc_id // 200 AS shard, doc_id, text, sum(len(string_split(text, chr(10)))) OVER (
        PARTITION BY doc_id // 200 ORDER BY doc_id) - len(string_split(text, chr(10))) AS ahead FROM documents)
    SELECT shard, CAST(ahead + generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no,
        unnest(string_split(text, chr(10))) AS line FROM numbered""",
)
def lines_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of text files with its number, a file read in ranges of 64 KB."""
    lines = read_lines(spark, _ordered_shards(spark, sf_dir), recursive=True, range_bytes=1 << 16)
    return lines.select(_part("shard"), "line_no", "line")


@query(
    "extract_ranges",
    f"""WITH whole AS (SELECT doc_id // 200 AS shard, concat(string_agg(text, chr(10) ORDER BY doc_id), chr(10)) AS content
        FROM documents GROUP BY 1)
    SELECT shard, {sql_units("content")} AS size, {sql_lines("content")} AS lines, {sql_words("content")} AS "wordCount",
        substring(content, 1, 100) AS preview FROM whole""",
)
def range_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of text files that are read in ranges of 64 KB."""
    records = extract_ranges(spark, _ordered_shards(spark, sf_dir), RUN_TS, recursive=True, range_bytes=1 << 16)
    return records.select(_part("shard"), "size", "lines", "wordCount", "preview")


@query(
    "incremental_job",
    f"""WITH whole AS (SELECT text, 0 AS added FROM documents UNION ALL SELECT text, 1 FROM benchmark)
    SELECT CAST(sum({sql_units("text")} + 1) AS BIGINT) AS size, CAST(sum({sql_words("text")}) AS BIGINT) AS words,
        CAST(sum({sql_lines("text")}) AS BIGINT) AS newlines,
        CAST(sum(added * ({sql_units("text")} + 1)) AS BIGINT) AS read_again FROM whole""",
)
def second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over the documents as files, then one after the benchmark's items have come as more files.

    The second run reads the new files only; its totals are those of all.
    """
    folder, output = _ordered_shards(spark, sf_dir), scratch_path(spark, "incremental")
    run_incremental_job(spark, folder, output, run_ts=RUN_TS, recursive=True)
    items = table(spark, sf_dir, "benchmark").select(F.lit("items").alias("shard"), F.col("text").alias("value"))
    items.write.mode("append").partitionBy("shard").text(folder)
    total = run_incremental_job(spark, folder, output, run_ts=RUN_TS, recursive=True)
    now = current_version(spark, output).folder
    names, none = ("size", "words", "newlines", "read_again"), F.lit(None).cast("bigint")
    again = spark.read.parquet(f"{output}/{now}/extracted").agg(F.sum("size").alias("size"))
    sums = total.select("totalSize", "totalWords", F.col("totalLines") - F.col("totalFiles"), none).toDF(*names)
    # two rows as one
    return sums.union(again.select(none, none, none, "size")).agg(*(F.max(name).alias(name) for name in names))


@query(
    "report_sizes",
    r"""WITH sizes AS (SELECT event_id, length(concat('{"type":"', event_type, '"}')) AS chars FROM events)
    SELECT event_id, 'text' AS format, CAST(41 + 23 + 41 + 32 + 1 + (chars - 3 + 1) + 1 + 41 AS BIGINT) AS size FROM sizes""",
)
def sizes_of_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result row of a report for every event."""
    given = table(spark, sf_dir, "events").select("event_id", F.expr("""concat('{"type":"', event_type, '"}')""").alias("text"))
    return report_sizes(report_lines(given, "event_id", "text", RUN_TS), "event_id")


_CONFIG = """CASE event_id % 9
    WHEN 0 THEN concat('# ', event_type) WHEN 1 THEN '   ' WHEN 2 THEN event_type WHEN 3 THEN concat('=', value)
    WHEN 4 THEN concat('  ', event_type, ' = "', event_id, '"  ') WHEN 5 THEN concat(event_type, '=''', event_id, '''')
    WHEN 6 THEN concat(event_type, '="', event_id, '''') WHEN 7 THEN concat(event_type, '=a=', event_id)
    ELSE concat(event_type, '=') END"""
_LINE = sql_trim(_CONFIG)


@query(
    "config_lines",
    f"""WITH lines AS (SELECT user_id AS file, event_id AS line_no, {_LINE} AS line FROM events),
    halves AS (SELECT file, line_no, {sql_trim("substring(line, 1, instr(line, '=') - 1)")} AS key,
        {sql_trim("substring(line, instr(line, '=') + 1)")} AS value
        FROM lines WHERE NOT starts_with(line, '#') AND instr(line, '=') >= 2)
    SELECT file, line_no, key, CASE WHEN regexp_full_match(value, '".*"|''.*''') THEN
        substring(value, 2, length(value) - 2) ELSE value END AS value FROM halves""",
)
def config_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), F.expr(_CONFIG).alias("line")
    )
    return parse_config_lines(lines)


@query(
    "read_config_lines",
    """SELECT event_id // 2500 AS file, concat('user', user_id % 300) AS key, arg_max(value, event_id) AS value
    FROM events GROUP BY 1, 2""",
)
def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A config file for each 2,500 events, with a line for each between comments; the last line of a key wins.

    The files are read in ranges of 64 KB.
    """
    path = scratch_path(spark, "config")
    line = F.concat(F.lit("# event\n user"), F.col("user_id") % 300, F.lit(" = '"), F.col("value").cast("string"), F.lit("'"))
    lines = table(spark, sf_dir, "events").select(F.expr("event_id DIV 2500").alias("part"), "event_id", line.alias("value"))
    ordered = lines.repartition("part").sortWithinPartitions("part", "event_id")
    ordered.select("part", "value").write.partitionBy("part").text(path)
    with range_size(spark, 1 << 16):
        settings = stored(read_config_lines(spark, path, recursive=True), "settings")
    return settings.select(
        F.regexp_extract("path", "/part=([^/]*)/", 1).cast("bigint").alias("file"),
        "key",
        F.col("value").cast("double").alias("value"),
    )


@query(
    "write_json",
    f"""WITH {RECORDS_SQL} SELECT filename, size, lines, wordCount AS "wordCount", preview FROM records""",
)
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "extracted")
    records = extract_stage(corpus_files(spark, sf_dir), RUN_TS).select(
        "filename", "size", "lines", "wordCount", "preview"
    )
    write_json(records, path)
    return spark.read.schema(records.schema).json(path)


@query(
    "write_text",
    """SELECT unnest(string_split(text, chr(10))) AS line FROM documents""",
)
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    write_text(table(spark, sf_dir, "documents"), path, "text")
    return spark.read.text(path).withColumnRenamed("value", "line")
