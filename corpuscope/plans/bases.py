"""Relations derived from the given tables, in Spark and in SQL.

``documents`` stands for a corpus of text files, each with a small JSON file
beside it; ``events`` for stored responses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.plans.registry import table

# The white-space class in the dialect of the comparison SQL.
WS_SQL = (
    r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)


def sql_words(text: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({text}, '{WS_SQL}+'), lambda w: w <> '')) AS BIGINT)"


def sql_lines(text: str) -> str:
    return f"CAST(len(string_split({text}, chr(10))) AS BIGINT)"


def sql_units(text: str) -> str:
    astral = rf"regexp_replace({text}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')"
    return f"CAST(length({text}) + length({astral}) AS BIGINT)"


def sql_trim(text: str) -> str:
    return f"regexp_replace({text}, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


# JSON beside each document: one in ten is cut off, one in ten is empty.
_SIDE_JSON = """CASE doc_id % 10
    WHEN 3 THEN concat('{"doc":', doc_id, ',"lang":"', lang, '"')
    WHEN 7 THEN ''
    ELSE concat('{"doc":', doc_id, ',"lang":"', lang, '","size":', n_chars, ',"filename":"', source, '.', lang, '"}')
END"""

FILES_SQL = f"""files AS (
    SELECT doc_id, concat(source, '_', doc_id, '.', lang) AS filename, text AS content,
        concat('/corpus/', source, '/', source, '_', doc_id, '.', lang) AS path
    FROM documents
    UNION ALL
    SELECT doc_id, concat(source, '_', doc_id, '.json'), {_SIDE_JSON},
        concat('/corpus/', source, '/', source, '_', doc_id, '.json')
    FROM documents
)"""


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, filename, content, path; both files of a document from one scan."""
    documents = table(spark, sf_dir, "documents")
    pair = F.array(
        F.struct(F.expr("concat(source, '_', doc_id, '.', lang)").alias("filename"), F.col("text").alias("content")),
        F.struct(F.expr("concat(source, '_', doc_id, '.json')").alias("filename"), F.expr(_SIDE_JSON).alias("content")),
    )
    return documents.select("doc_id", "source", F.inline(pair)).select(
        "doc_id",
        "filename",
        "content",
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), "filename").alias("path"),
    )


RECORDS_SQL = f"""{FILES_SQL},
records AS (
    SELECT doc_id, filename, {sql_units("content")} AS size, {sql_lines("content")} AS lines,
        CASE WHEN NOT ends_with(filename, '.json') THEN {sql_words("content")} END AS wordCount,
        CASE WHEN ends_with(filename, '.json') AND json_valid(content) THEN CAST(json(content) AS VARCHAR) END
            AS jsonData,
        CASE WHEN ends_with(filename, '.json') AND NOT json_valid(content) THEN 'SyntaxError: not valid JSON' END
            AS parseError,
        CASE WHEN NOT ends_with(filename, '.json') THEN substring(content, 1, 100) END AS preview
    FROM files WHERE content <> ''
)"""

_STATUS = """CASE event_id % 8
    WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 301 WHEN 3 THEN 399
    WHEN 4 THEN 400 WHEN 5 THEN 500 WHEN 6 THEN 199 END"""
_STATUS_TEXT = "CASE event_id % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'Accepted' WHEN 2 THEN '' WHEN 3 THEN 'Moved' END"
_BODY = "CASE WHEN event_id % 11 = 0 THEN concat(props, ' x') WHEN event_id % 13 = 0 THEN '[1, 2, 3, 4]' ELSE props END"
_HEADER = "CASE event_id % 3 WHEN 1 THEN 'content-type' ELSE 'Content-Type' END"
_MEDIA = "CASE event_id % 3 WHEN 2 THEN 'text/html' ELSE 'application/json; charset=utf-8' END"
_ERROR = "CASE WHEN event_type = 'error' THEN concat('timeout ', user_id) WHEN event_id % 6 = 0 THEN '' END"
_URL = "concat('https://h', user_id % 50, '.example.com/e/', event_id)"

RESPONSES_SQL = f"""responses AS (
    SELECT event_id, {_URL} AS url, {_STATUS} AS status_code, {_STATUS_TEXT} AS status_text,
        {_HEADER} AS header, {_MEDIA} AS media, {_BODY} AS body, {_ERROR} AS error
    FROM events
),
gated AS (
    SELECT *, CASE WHEN coalesce(error, '') <> '' THEN 'transport_error'
            WHEN status_code >= 400 THEN 'http_error' ELSE 'ok' END AS outcome,
        concat('HTTP ', status_code, ': ', coalesce(status_text, 'undefined')) AS http_message
    FROM responses
)"""


def event_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per event."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr(_URL).alias("url"),
        F.expr(_STATUS).alias("status_code"),
        F.expr(_STATUS_TEXT).alias("status_text"),
        F.create_map(F.expr(_HEADER), F.expr(_MEDIA)).alias("headers"),
        F.expr(_BODY).alias("body"),
        F.expr(_ERROR).alias("error"),
    )


PAGES_SQL = """pages_fetched AS (
    SELECT page_id, url, CASE page_id % 5 WHEN 3 THEN 404 WHEN 4 THEN 301 ELSE 200 END AS status_code,
        CASE WHEN page_id % 7 = 6 THEN 'connection reset' END AS error, html AS body
    FROM pages
)"""


def page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per page; some failed, some with status 404."""
    return table(spark, sf_dir, "pages").select(
        "url",
        F.expr("CASE page_id % 5 WHEN 3 THEN 404 WHEN 4 THEN 301 ELSE 200 END").alias("status_code"),
        F.lit("text").alias("status_text"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html")).alias("headers"),
        F.col("html").alias("body"),
        F.expr("CASE WHEN page_id % 7 = 6 THEN 'connection reset' END").alias("error"),
    )
