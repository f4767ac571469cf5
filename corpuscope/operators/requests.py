"""Request rows: method, headers and body of each call before it is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.jsontext import JSON_TYPE, NULL, STRING, kind, value_json

CONTENT_TYPE = "Content-Type"
USER_AGENT = "Mozilla/5.0 (compatible)"
# The kinds of request and the methods that carry a body.
READING = ["fetchData", "fetchJSON", "scrapeWebpage", "checkStatus"]
BODY_METHODS = ["POST", "PUT", "PATCH"]
WEBHOOK_METHODS = ["POST", "PUT"]

# Messages for calls that cannot be sent.
NO_URL = "URL is required"
NO_WEBHOOK_URL = "Webhook URL is required"
BAD_WEBHOOK_METHOD = "Webhook method must be POST or PUT"


def _with_header(headers: Column, name: str, value: str) -> Column:
    """Set a header, replacing the one of that exact name."""
    others = F.map_filter(headers, lambda k, v: k != name)
    return F.map_concat(others, F.create_map(F.lit(name), F.lit(value)))


def _truthy(data: Column, text: Column, type_name: Column) -> Column:
    """Whether a value counts as given: not absent, null, '', 0 or false; ``text`` is its JSON."""
    empty = (type_name == NULL) | text.isin('""', "0", "false")
    return data.isNotNull() & ~empty


def build_requests(df: DataFrame, user_agent: str = USER_AGENT) -> DataFrame:
    """Turn calls into requests.

    Takes ``kind`` (fetchData, postData, fetchJSON, apiRequest, webhookCall,
    scrapeWebpage, checkStatus), ``url`` (of a webhook ``webhookUrl`` before it, if given), ``method``, ``headers`` and ``data``
    (VARIANT; the payload of a webhook). ``data`` gives way to ``body`` and
    ``error``, ``method`` and ``headers`` are filled in, other columns stay.
    """
    call, data, method, body = F.col("kind"), F.col("data"), F.col("method"), F.col("body")
    webhook = call == "webhookCall"

    if "webhookUrl" in df.columns:
        own = F.when(webhook, F.nullif(F.col("webhookUrl"), F.lit("")))
        df = df.withColumn("url", F.coalesce(own, F.col("url"))).drop("webhookUrl")

    # one step each, so that no expression is copied into the next
    given = F.nullif(F.col("method"), F.lit(""))
    filled = (
        F.when(call.isin(*READING), "GET")
        .when(call == "postData", "POST")
        .when(webhook, F.coalesce(given, F.lit("POST")))
        .otherwise(F.upper(F.coalesce(given, F.lit("GET"))))
    )
    steps = df.withColumns({"method": filled, "_type": kind(data), "_json": value_json(data)})
    steps = steps.withColumn("_given", _truthy(data, F.col("_json"), F.col("_type")))

    plain = F.when(F.col("_type") == STRING, F.try_variant_get(data, "$", "string")).otherwise(F.col("_json"))
    empty_object = F.lit("{}")
    steps = steps.withColumn(
        "body",
        F.when(call == "postData", F.when(F.col("_given"), plain).otherwise(empty_object))
        .when(webhook, F.when(F.col("_given"), F.col("_json")).otherwise(empty_object))
        .when((call == "apiRequest") & method.isin(*BODY_METHODS) & F.col("_given"), plain),
    )

    sent = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    typed = F.coalesce(F.try_element_at(sent, F.lit(CONTENT_TYPE)), F.lit("")) != ""
    headers = (
        F.when(call == "fetchJSON", _with_header(sent, "Accept", JSON_TYPE))
        .when(call == "scrapeWebpage", F.create_map(F.lit("User-Agent"), F.lit(user_agent)))
        .when(call == "checkStatus", F.lit(None))
        .when(webhook | (body.isNotNull() & ~typed), _with_header(sent, CONTENT_TYPE, JSON_TYPE))
        .otherwise(sent)
    )
    label = F.when(webhook, NO_WEBHOOK_URL).otherwise(NO_URL)
    error = F.when(F.coalesce(F.col("url"), F.lit("")) == "", label).when(
        webhook & ~method.isin(*WEBHOOK_METHODS), BAD_WEBHOOK_METHOD
    )
    return steps.withColumns({"headers": headers, "error": error}).drop("data", "_type", "_json", "_given")
