"""Stored HTTP responses: classify, parse, scrape, summarise.

A response has ``url``, ``status_code``, ``status_text``, ``headers``, ``body``
and ``error``; NULL means absent.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.html import (
    html_images,
    html_links,
    html_pattern,
    html_text,
    html_title,
    valid_pattern,
)
from corpuscope.functions.jsontext import TOO_LARGE, is_json_type, json_error, with_json
from corpuscope.functions.text import char_count
from corpuscope.operators.items import apply_transform

# What stands in front of a transport error, by kind of call.
FETCH_FAILED = "HTTP request failed: "
JSON_FAILED = "Failed to fetch JSON: "
PAGE_FAILED = "Failed to fetch webpage: "
POST_FAILED = "POST request failed: "
WEBHOOK_FAILED = "Webhook call failed: "
API_FAILED = "API request failed: "

PARSE_FAILED = "Failed to parse JSON response: SyntaxError"
LARGE_FAILED = "Failed to parse JSON response: RangeError"
NO_BODY = "TypeError: response has no body"


def has_error() -> Column:
    """Whether the transport failed; an empty message does not count."""
    return F.coalesce(F.col("error") != "", F.lit(False))


def _failed(prefix: str) -> Column:
    return F.when(has_error(), F.concat(F.lit(prefix), F.col("error")))


def response_gate(df: DataFrame, prefix: str = FETCH_FAILED) -> DataFrame:
    """Add ``outcome`` (transport_error, http_error, ok) and ``message``."""
    http = F.col("status_code") >= 400
    text = F.coalesce(F.col("status_text"), F.lit("undefined"))
    return df.withColumn(
        "outcome", F.when(has_error(), "transport_error").when(http, "http_error").otherwise("ok")
    ).withColumn(
        "message",
        F.coalesce(
            _failed(prefix),
            F.when(http, F.concat(F.lit("HTTP "), F.col("status_code").cast("string"), F.lit(": "), text)),
        ),
    )


def is_online() -> Column:
    """No error and a status from 200 up to 399."""
    return ~has_error() & F.coalesce(F.col("status_code").between(200, 399), F.lit(False))


def check_status(df: DataFrame) -> DataFrame:
    """One status row per response."""
    return df.select(
        "url",
        F.coalesce(F.col("status_code"), F.lit(0)).alias("status"),
        F.coalesce(F.nullif("status_text", F.lit("")), F.lit("Unknown")).alias("statusText"),
        F.nullif("error", F.lit("")).alias("error"),
        is_online().alias("online"),
    )


def status_summary(status_rows: DataFrame) -> DataFrame:
    """Total, online and offline, from the rows of :func:`check_status`."""
    online = F.col("online")
    return status_rows.agg(
        F.count("*").alias("total"), F.count_if(online).alias("online"), F.count_if(~online).alias("offline")
    )


def _ok(value: Column) -> Column:
    return F.when(F.col("message").isNull(), value)


def fetch_data(df: DataFrame) -> DataFrame:
    """Status, length and content of the responses that pass the gate."""
    gated = response_gate(df, FETCH_FAILED)
    body = F.col("body")
    message = F.coalesce(F.col("message"), F.when(body.isNull(), NO_BODY))
    return gated.withColumn("message", message).select(
        "url",
        _ok(F.col("status_code")).alias("status"),
        _ok(char_count(body)).alias("contentLength"),
        _ok(body).alias("content"),
        _ok(F.col("headers")).alias("headers"),
        F.col("message").alias("error"),
    )


def fetch_json(df: DataFrame, transform: dict[str, Any] | None = None) -> DataFrame:
    """Status and parsed, transformed body; ``data`` is VARIANT."""
    gated = response_gate(df, JSON_FAILED)
    gated = with_json(gated, "data", F.col("body"), F.col("message").isNull())
    gated = gated.withColumn("_large", json_error(F.col("data"), F.col("body")) == TOO_LARGE)
    shaped = apply_transform(gated, "data", transform)
    broken = F.when(F.col("data").isNull(), F.when(F.col("_large"), LARGE_FAILED).otherwise(PARSE_FAILED))
    return shaped.select(
        "url",
        F.when(F.col("data").isNotNull(), F.col("status_code")).alias("status"),
        "data",
        F.coalesce(F.col("message"), broken).alias("error"),
    )


def post_result(df: DataFrame) -> DataFrame:
    """Outcome of a POST: the gate, then status, text and raw response."""
    return _posted(response_gate(df, POST_FAILED))


def webhook_result(df: DataFrame) -> DataFrame:
    """Outcome of a webhook call: only a transport error fails it."""
    return _posted(df.withColumn("message", _failed(WEBHOOK_FAILED)))


def _posted(df: DataFrame) -> DataFrame:
    return df.select(
        "url",
        _ok(F.col("status_code")).alias("status"),
        _ok(F.col("status_text")).alias("statusText"),
        _ok(F.col("body")).alias("response"),
        F.col("message").alias("error"),
    )


def api_result(df: DataFrame) -> DataFrame:
    """Outcome of an API request; here a status of 400 or more is no error.

    ``bodyJson`` is the parsed body where the ``Content-Type`` header (this
    letter case only) says JSON and the body parses; ``bodyText`` otherwise.
    """
    result = df.withColumn("message", _failed(API_FAILED))
    wanted = F.col("message").isNull() & is_json_type(F.try_element_at("headers", F.lit("Content-Type")))
    return with_json(result, "bodyJson", F.col("body"), wanted).select(
        "url",
        _ok(F.col("status_code")).alias("status"),
        _ok(F.col("status_text")).alias("statusText"),
        _ok(F.col("headers")).alias("headers"),
        "bodyJson",
        _ok(F.when(F.col("bodyJson").isNull(), F.col("body"))).alias("bodyText"),
        F.col("message").alias("error"),
    )


def scrape_pages(
    df: DataFrame,
    selectors: dict[str, str] | None = None,
    text_limit: int | None = None,
    link_limit: int | None = None,
    image_limit: int | None = None,
) -> DataFrame:
    """Title, text, links and images of each page that passes the gate.

    All of them, unless a limit is given. ``selectors`` adds one array column per
    pattern. One named like a standard column replaces it; an invalid pattern gives an
    empty array.
    """
    gated = response_gate(df, PAGE_FAILED)
    body = F.col("body")
    columns = {
        "title": html_title(body),
        "text": html_text(body, text_limit),
        "links": html_links(body, link_limit),
        "images": html_images(body, image_limit),
    }
    for name, pattern in (selectors or {}).items():
        usable = valid_pattern(df.sparkSession, pattern)
        columns[name] = html_pattern(body, pattern) if usable else F.array().cast("array<string>")
    return gated.select(
        "url",
        *(_ok(value).alias(name) for name, value in columns.items()),
        F.col("message").alias("error"),
    )


def header_echo(df: DataFrame, sent: str = "sent", received: str = "received") -> DataFrame:
    """Add ``passed``: every sent header came back with its value.

    Names are compared without regard to letter case. Both maps are in one row,
    so no join is needed.
    """
    came_back = F.forall(
        F.map_entries(sent),
        lambda s: F.exists(
            F.map_entries(F.coalesce(F.col(received), F.create_map().cast("map<string,string>"))),
            lambda r: (F.lower(r["key"]) == F.lower(s["key"])) & r["value"].eqNullSafe(s["value"]),
        ),
    )
    return df.withColumn("passed", came_back)
