"""Queries over stored responses, requests and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.jsontext import with_json
from corpuscope.operators.requests import build_requests
from corpuscope.operators.responses import (
    api_result,
    check_status,
    fetch_data,
    fetch_json,
    has_error,
    header_echo,
    is_online,
    post_result,
    response_gate,
    scrape_pages,
    status_summary,
    webhook_result,
)
from corpuscope.plans.bases import PAGES_SQL, RESPONSES_SQL, event_responses, page_responses, sql_units
from corpuscope.plans.registry import query, table
from corpuscope.plans.text_queries import LINKS_SQL, TEXT_SQL, _TITLE
from corpuscope.sources.records import read_responses


@query(
    "response_fields",
    f"""WITH {RESPONSES_SQL} SELECT event_id, url, CAST(status_code AS INTEGER) AS status_code, status_text,
    header, media, body, error FROM responses""",
)
def response_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses written as JSON and read back."""
    stored = event_responses(spark, sf_dir).select(
        "event_id",
        F.to_json(
            F.struct(
                "url",
                F.col("status_code").alias("statusCode"),
                F.col("status_text").alias("statusText"),
                "headers",
                "body",
                "error",
            )
        ).alias("value"),
    )
    read = read_responses(stored)
    entry = F.element_at(F.map_entries("headers"), 1)
    return read.withColumns({"header": entry["key"], "media": entry["value"]}).drop("headers")


@query(
    "response_gate",
    f"""WITH {RESPONSES_SQL} SELECT event_id, outcome, CASE outcome
        WHEN 'transport_error' THEN concat('HTTP request failed: ', error)
        WHEN 'http_error' THEN http_message END AS message FROM gated""",
)
def gated_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response_gate(event_responses(spark, sf_dir)).select("event_id", "outcome", "message")


_ONLINE = "coalesce(error, '') = '' AND coalesce(status_code >= 200 AND status_code < 400, false)"


@query(
    "online_flag",
    f"WITH {RESPONSES_SQL} SELECT event_id, coalesce(error, '') <> '' AS failed, {_ONLINE} AS online FROM responses",
)
def online_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_responses(spark, sf_dir).select(
        "event_id", has_error().alias("failed"), is_online().alias("online")
    )


_STATUS_ROWS = f"""SELECT url, CAST(coalesce(status_code, 0) AS INTEGER) AS status,
    coalesce(nullif(status_text, ''), 'Unknown') AS "statusText", nullif(error, '') AS error, {_ONLINE} AS online
    FROM responses"""


@query(
    "check_status",
    f"WITH {RESPONSES_SQL} {_STATUS_ROWS}",
)
def status_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_status(event_responses(spark, sf_dir))


@query(
    "status_summary",
    f"""WITH {RESPONSES_SQL} SELECT CAST(count(*) AS BIGINT) AS total,
    CAST(count(*) FILTER (online) AS BIGINT) AS online, CAST(count(*) FILTER (NOT online) AS BIGINT) AS offline
    FROM ({_STATUS_ROWS})""",
)
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_summary(check_status(event_responses(spark, sf_dir)))


_PAGE_ERROR = """CASE WHEN error IS NOT NULL THEN concat('{prefix}', error)
    WHEN status_code >= 400 THEN concat('HTTP ', status_code, ': text') END"""
_FETCH_ERROR = _PAGE_ERROR.format(prefix="HTTP request failed: ")
_SCRAPE_ERROR = _PAGE_ERROR.format(prefix="Failed to fetch webpage: ")


@query(
    "fetch_data",
    f"""WITH {PAGES_SQL}, checked AS (SELECT *, {_FETCH_ERROR} AS message FROM pages_fetched)
    SELECT url, CASE WHEN message IS NULL THEN CAST(status_code AS INTEGER) END AS status,
        CASE WHEN message IS NULL THEN {sql_units("body")} END AS "contentLength",
        CASE WHEN message IS NULL THEN body END AS content,
        CASE WHEN message IS NULL THEN 'text/html' END AS media, message AS error FROM checked""",
)
def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = fetch_data(page_responses(spark, sf_dir))
    return fetched.withColumn("media", F.try_element_at("headers", F.lit("Content-Type"))).drop("headers")


@query(
    "fetch_json",
    f"""WITH {RESPONSES_SQL} SELECT url,
        CASE WHEN outcome = 'ok' AND json_valid(body) THEN CAST(status_code AS INTEGER) END AS status,
        CASE WHEN outcome = 'ok' AND json_valid(body) THEN
            CASE WHEN body LIKE '[%' THEN '[2,4]' ELSE CAST(json(body) AS VARCHAR) END END AS data,
        CASE outcome WHEN 'transport_error' THEN concat('Failed to fetch JSON: ', error)
            WHEN 'http_error' THEN http_message
            ELSE CASE WHEN NOT json_valid(body) THEN 'Failed to parse JSON response: SyntaxError' END END AS error
    FROM gated""",
)
def fetched_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"filter": "item::int % 2 = 0", "extract": ["k", "none"]}
    return fetch_json(event_responses(spark, sf_dir), spec).withColumn("data", F.to_json("data"))


def _posted_sql(message: str) -> str:
    return f"""WITH {RESPONSES_SQL}, checked AS (SELECT *, {message} AS message FROM gated)
    SELECT url, CASE WHEN message IS NULL THEN CAST(status_code AS INTEGER) END AS status,
        CASE WHEN message IS NULL THEN status_text END AS "statusText",
        CASE WHEN message IS NULL THEN body END AS response, message AS error FROM checked"""


@query(
    "post_result",
    _posted_sql("""CASE outcome WHEN 'transport_error' THEN concat('POST request failed: ', error)
    WHEN 'http_error' THEN http_message END"""),
)
def posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post_result(event_responses(spark, sf_dir))


@query(
    "webhook_result",
    _posted_sql("CASE outcome WHEN 'transport_error' THEN concat('Webhook call failed: ', error) END"),
)
def webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webhook_result(event_responses(spark, sf_dir))


@query(
    "api_result",
    f"""WITH {RESPONSES_SQL}, checked AS (SELECT *, outcome <> 'transport_error' AS good,
        header = 'Content-Type' AND media LIKE '%application/json%' AND json_valid(body) AS parsed FROM gated)
    SELECT url, CASE WHEN good THEN CAST(status_code AS INTEGER) END AS status,
        CASE WHEN good THEN status_text END AS "statusText",
        CASE WHEN good AND parsed THEN CAST(json(body) AS VARCHAR) END AS "bodyJson",
        CASE WHEN good AND NOT parsed THEN body END AS "bodyText",
        CASE WHEN NOT good THEN concat('API request failed: ', error) END AS error FROM checked""",
)
def api_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = api_result(event_responses(spark, sf_dir)).drop("headers")
    return result.withColumn("bodyJson", F.to_json("bodyJson"))


_HEADING = "<h1>([^<]*)</h1>"
_WITH_IMAGES = """replace(body, '<a href=', '<img alt="" src="/i.png"><a href=')"""
_IMAGES_SQL = """regexp_extract_all(html, '<img[^>]+src=["'']([^"'']+)["''][^>]*>', 1, 'i')"""


@query(
    "scrape_pages",
    f"""WITH {PAGES_SQL}, checked AS (SELECT url, {_WITH_IMAGES} AS html, {_SCRAPE_ERROR} AS message
        FROM pages_fetched)
    SELECT url, CASE WHEN message IS NULL THEN {_TITLE} END AS title,
        CASE WHEN message IS NULL THEN {TEXT_SQL} END AS text,
        CASE WHEN message IS NULL THEN array_to_string({LINKS_SQL}, ' ') END AS links,
        CASE WHEN message IS NULL THEN array_to_string({_IMAGES_SQL}, ' ') END AS images,
        CASE WHEN message IS NULL THEN array_to_string(regexp_extract_all(html, '{_HEADING}', 1, 'i'), '|') END
            AS headings,
        CASE WHEN message IS NULL THEN '' END AS broken, message AS error FROM checked""",
)
def scraped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no images, so each gets one in front of every link."""
    pages = page_responses(spark, sf_dir).withColumn("body", F.expr(_WITH_IMAGES))
    scraped = scrape_pages(pages, {"headings": _HEADING, "broken": "(["})
    return scraped.withColumns(
        {
            "links": F.array_join("links", " "),
            "images": F.array_join("images", " "),
            "headings": F.array_join("headings", "|"),
            "broken": F.array_join("broken", "|"),
        }
    )


@query(
    "header_echo",
    """SELECT event_id, event_id % 4 <> 1 AND event_type <> 'click' AS passed FROM events""",
)
def echoed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the received ids is changed, and clicks come back without their type."""
    headers = table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("map('X-Event-ID', CAST(event_id AS STRING), 'X-Type', event_type)").alias("sent"),
        F.expr(
            """map('X-Event-Id', CAST(CASE WHEN event_id % 4 = 1 THEN event_id + 1 ELSE event_id END AS STRING),
            CASE WHEN event_type = 'click' THEN 'X-Other' ELSE 'x-type' END, event_type)"""
        ).alias("received"),
    )
    return header_echo(headers).select("event_id", "passed")


_KIND = """CASE event_id % 7 WHEN 0 THEN 'fetchData' WHEN 1 THEN 'postData' WHEN 2 THEN 'fetchJSON'
    WHEN 3 THEN 'apiRequest' WHEN 4 THEN 'webhookCall' WHEN 5 THEN 'scrapeWebpage' ELSE 'checkStatus' END"""
_CALL_URL = "CASE WHEN event_id % 10 <> 9 THEN concat('https://api.example.com/', user_id) END"
_HOOK_URL = "CASE event_id % 3 WHEN 0 THEN concat('https://hook.example.com/', user_id) WHEN 1 THEN '' END"
_METHOD = "CASE user_id % 6 WHEN 0 THEN 'post' WHEN 1 THEN 'PUT' WHEN 2 THEN 'delete' WHEN 3 THEN 'POST' END"
_DATA = """CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '"plain text"' WHEN 2 THEN '""' WHEN 3 THEN 'null' END"""
_CALL_HEADER = "CASE WHEN user_id % 4 = 0 THEN 'Content-Type' ELSE 'Accept' END"


@query(
    "build_requests",
    f"""WITH calls AS (SELECT event_id, {_KIND} AS kind, CASE WHEN event_id % 7 = 4 AND event_id % 3 = 0
        THEN {_HOOK_URL} ELSE {_CALL_URL} END AS url, {_METHOD} AS given, {_DATA} AS data,
        {_CALL_HEADER} AS header FROM events),
    shaped AS (SELECT *, event_id % 5 IN (0, 1) AS has_data,
        CASE WHEN kind IN ('fetchData', 'fetchJSON', 'scrapeWebpage', 'checkStatus') THEN 'GET'
            WHEN kind = 'postData' THEN 'POST' WHEN kind = 'webhookCall' THEN coalesce(given, 'POST')
            ELSE upper(coalesce(given, 'GET')) END AS method FROM calls),
    bodied AS (SELECT *, CASE
            WHEN kind = 'postData' OR kind = 'apiRequest' AND method IN ('POST', 'PUT', 'PATCH') AND has_data THEN
                CASE event_id % 5 WHEN 0 THEN CAST(json(data) AS VARCHAR) WHEN 1 THEN 'plain text' ELSE '{{}}' END
            WHEN kind = 'webhookCall' THEN
                CASE WHEN has_data THEN CAST(json(data) AS VARCHAR) ELSE '{{}}' END END AS body FROM shaped)
    SELECT event_id, kind, url, method, body,
        CASE WHEN kind = 'webhookCall' OR body IS NOT NULL AND header <> 'Content-Type' THEN 'application/json'
            WHEN header = 'Content-Type' AND kind NOT IN ('scrapeWebpage', 'checkStatus') THEN 'given' END AS media,
        CASE WHEN kind = 'fetchJSON' THEN 'application/json'
            WHEN header = 'Accept' AND kind NOT IN ('scrapeWebpage', 'checkStatus') THEN 'given' END AS accept,
        CASE WHEN kind = 'scrapeWebpage' THEN 'test agent' END AS agent,
        CASE WHEN url IS NULL THEN CASE WHEN kind = 'webhookCall' THEN 'Webhook URL is required'
                ELSE 'URL is required' END
            WHEN kind = 'webhookCall' AND method NOT IN ('POST', 'PUT') THEN 'Webhook method must be POST or PUT'
            END AS error FROM bodied""",
)
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(
        "event_id",
        F.expr(_KIND).alias("kind"),
        F.expr(_CALL_URL).alias("url"),
        F.expr(_HOOK_URL).alias("webhookUrl"),
        F.expr(_METHOD).alias("method"),
        F.create_map(F.expr(_CALL_HEADER), F.lit("given")).alias("headers"),
        F.expr(_DATA).alias("text"),
    )
    built = build_requests(with_json(calls, "data", F.col("text")).drop("text"), "test agent")
    names = {"media": "Content-Type", "accept": "Accept", "agent": "User-Agent"}
    columns = {column: F.try_element_at("headers", F.lit(name)) for column, name in names.items()}
    return built.withColumns(columns).drop("headers")
