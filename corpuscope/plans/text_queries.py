"""Queries over scalar functions: text, HTML, paths, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.html import html_images, html_links, html_pattern, html_text, html_title, valid_pattern
from corpuscope.functions.jsontext import json_body, json_object_or_empty
from corpuscope.functions.paths import base_name, file_extension, has_extension, normalize_path, url_filename
from corpuscope.functions.text import char_count, count_lines, count_words, preview_chars, preview_lines
from corpuscope.plans.bases import (
    FILES_SQL,
    RESPONSES_SQL,
    WS_SQL,
    corpus_files,
    event_responses,
    sql_lines,
    sql_trim,
    sql_units,
    sql_words,
)
from corpuscope.plans.registry import query, table


@query(
    "text_stats",
    f"""SELECT doc_id, {sql_words("text")} AS words, {sql_lines("text")} AS lines, {sql_units("text")} AS chars,
    substring(text, 1, 100) AS preview FROM documents""",
)
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        count_words(text).alias("words"),
        count_lines(text).alias("lines"),
        char_count(text).alias("chars"),
        preview_chars(text).alias("preview"),
    )


@query(
    "preview_lines",
    """SELECT doc_id, array_to_string(string_split(text, chr(10))[1:10], chr(10)) AS preview FROM documents""",
)
def file_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", preview_lines(F.col("text")).alias("preview"))


_TITLE = sql_trim("regexp_extract(html, '<title[^>]*>([^<]+)</title>', 1, 'i')")


@query(
    "html_title",
    f"SELECT page_id, {_TITLE} AS title FROM pages",
)
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_title(F.col("html")).alias("title"))


_NO_SCRIPT = r"regexp_replace(html, '<script[^>]*>[^\n\r\x{2028}\x{2029}]*?</script>', '', 'gi')"
_NO_STYLE = rf"regexp_replace({_NO_SCRIPT}, '<style[^>]*>[^\n\r\x{{2028}}\x{{2029}}]*?</style>', '', 'gi')"
_NO_TAGS = f"regexp_replace({_NO_STYLE}, '<[^>]+>', ' ', 'g')"
TEXT_SQL = f"trim(regexp_replace({_NO_TAGS}, '{WS_SQL}+', ' ', 'g'))"


@query(
    "html_text",
    f"SELECT page_id, {TEXT_SQL} AS text FROM pages",
)
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


LINKS_SQL = """regexp_extract_all(html, '<a[^>]+href=["'']([^"'']+)["''][^>]*>', 1, 'i')"""


@query(
    "html_links",
    f"SELECT page_id, CAST(len({LINKS_SQL}) AS BIGINT) AS n, array_to_string({LINKS_SQL}, ' ') AS links FROM pages",
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = html_links(F.col("html"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.size(links).cast("bigint").alias("n"), F.array_join(links, " ").alias("links")
    )


_IMAGES = """regexp_extract_all(replace(html, '<a href=', '<IMG alt="" src='),
    '<img[^>]+src=["'']([^"'']+)["''][^>]*>', 1, 'i')"""


@query(
    "html_images",
    f"SELECT page_id, array_to_string({_IMAGES}, ' ') AS images FROM pages",
)
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have links only, so these are turned into images first."""
    html = F.replace("html", F.lit("<a href="), F.lit('<IMG alt="" src='))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(html_images(html), " ").alias("images"))


_ITEM = '<(?:p|li)>(?:<a href="([^"]*)")?'


@query(
    "html_pattern",
    f"""SELECT page_id, array_to_string(list_transform(
        list_zip(regexp_extract_all(html, '{_ITEM}', 1, 'i'), regexp_extract_all(html, '{_ITEM}', 0, 'i')),
        lambda m: coalesce(nullif(m[1], ''), m[2])), ' ') AS found FROM pages""",
)
def page_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_pattern(F.col("html"), _ITEM) if valid_pattern(spark, _ITEM) else F.array()
    return pages.select("page_id", F.array_join(found, " ").alias("found"))


@query(
    "url_filename",
    """SELECT page_id, string_split(url, '/')[-1] AS base,
    coalesce(nullif(string_split(url, '/')[-1], ''), 'download.txt') AS filename
    FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN concat(url, '/') ELSE url END AS url FROM pages)""",
)
def url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth URL gets a slash at its end."""
    url = F.expr("CASE WHEN page_id % 4 = 0 THEN concat(url, '/') ELSE url END")
    return table(spark, sf_dir, "pages").select(
        "page_id", base_name(url).alias("base"), url_filename(url).alias("filename")
    )


@query(
    "file_extension",
    f"""WITH {FILES_SQL} SELECT filename, string_split(filename, '.')[-1] AS extension,
    string_split(replace(filename, '.', ''), '.')[-1] AS whole FROM files""",
)
def extension_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("filename")
    return corpus_files(spark, sf_dir).select(
        "filename",
        file_extension(name).alias("extension"),
        file_extension(F.replace(name, F.lit("."), F.lit(""))).alias("whole"),
    )


@query(
    "has_extension",
    f"""WITH {FILES_SQL} SELECT filename, ends_with(filename, '.json') OR ends_with(filename, '.de') AS wanted
    FROM files""",
)
def suffix_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = has_extension(F.col("filename"), [".json", ".de"])
    return corpus_files(spark, sf_dir).select("filename", wanted.alias("wanted"))


_RAW_PATH = """CASE page_id % 3
    WHEN 0 THEN concat('/a/./', replace(url, '?', '/../'), '/../x')
    WHEN 1 THEN concat('../', replace(url, 'example', '..'), '//')
    ELSE replace(url, '.', '/../') END"""


@query(
    "normalize_path",
    f"""WITH raw AS (SELECT page_id, {_RAW_PATH} AS path FROM pages)
    SELECT page_id, concat(CASE WHEN path LIKE '/%' THEN '/' ELSE '' END, array_to_string(list_reduce(
        list_transform(list_filter(string_split(path, '/'), lambda p: p NOT IN ('.', '')), lambda p: [p]),
        lambda done, p: CASE WHEN p[1] = '..' THEN done[:len(done) - 1] ELSE list_concat(done, p) END,
        CAST([] AS VARCHAR[])), '/')) AS path FROM raw""",
)
def path_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "pages").select("page_id", F.expr(_RAW_PATH).alias("path"))
    return raw.select("page_id", normalize_path(F.col("path")).alias("path"))


@query(
    "json_body",
    f"""WITH {RESPONSES_SQL}, parsed AS (
        SELECT event_id, body, header = 'Content-Type' AND media LIKE '%application/json%' AND json_valid(body) AS ok
        FROM responses)
    SELECT event_id, CASE WHEN ok THEN CAST(json(body) AS VARCHAR) END AS body_json,
        CASE WHEN NOT ok THEN body END AS body_text FROM parsed""",
)
def body_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = event_responses(spark, sf_dir).withColumn(
        "_json", json_body(F.try_element_at("headers", F.lit("Content-Type")), F.col("body"))
    )
    return parsed.select(
        "event_id",
        F.to_json("_json").alias("body_json"),
        F.when(F.col("_json").isNull(), F.col("body")).alias("body_text"),
    )


_MAYBE_OBJECT = """CASE event_id % 5
    WHEN 0 THEN props WHEN 1 THEN concat('[', props, ']') WHEN 2 THEN 'null' WHEN 3 THEN concat(props, '}') END"""


@query(
    "json_object_or_empty",
    f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CAST(json(props) AS VARCHAR) ELSE '{{}}' END AS object
    FROM events""",
)
def object_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.expr(_MAYBE_OBJECT).alias("raw"))
    return events.select("event_id", json_object_or_empty(F.col("raw")).alias("object"))
