from pyspark.sql import functions as F

from corpuscope.functions.jsontext import parse_json
from corpuscope.operators import responses as r
from corpuscope.operators.requests import build_requests

SCHEMA = "url string, status_code int, status_text string, headers map<string,string>, body string, error string"


def frame(spark, *rows):
    return spark.createDataFrame([(f"u{i}", *row) for i, row in enumerate(rows)], SCHEMA)


def by_url(df, *columns):
    return [tuple(row[c] for c in columns) for row in df.orderBy("url").collect()]


def test_gate_and_online(spark):
    df = frame(
        spark,
        (200, "OK", {}, "", None),
        (500, "Bad", {}, "", "refused"),
        (500, "Bad", {}, "", None),
        (400, None, {}, "", ""),
        (399, "", {}, "", ""),
        (199, "x", {}, "", None),
        (None, None, {}, "", None),
    )
    assert by_url(r.response_gate(df, "failed: "), "outcome", "message") == [
        ("ok", None),
        ("transport_error", "failed: refused"),
        ("http_error", "HTTP 500: Bad"),
        ("http_error", "HTTP 400: undefined"),
        ("ok", None),
        ("ok", None),
        ("ok", None),
    ]
    rows = r.check_status(df)
    assert by_url(rows, "status", "statusText", "error", "online") == [
        (200, "OK", None, True),
        (500, "Bad", "refused", False),
        (500, "Bad", None, False),
        (400, "Unknown", None, False),
        (399, "Unknown", None, True),
        (199, "x", None, False),
        (0, "Unknown", None, False),
    ]
    assert r.status_summary(rows).first().asDict() == {"total": 7, "online": 2, "offline": 5}
    assert r.status_summary(rows.limit(0)).first().asDict() == {"total": 0, "online": 0, "offline": 0}


def test_fetch_data(spark):
    smile = chr(0x1F600)
    df = frame(spark, (200, "OK", {"a": "b"}, smile, None), (404, "No", {}, "x", None), (200, "OK", None, None, None))
    assert by_url(r.fetch_data(df), "status", "contentLength", "content", "headers", "error") == [
        (200, 2, smile, {"a": "b"}, None),
        (None, None, None, None, "HTTP 404: No"),
        (None, None, None, None, "TypeError: response has no body"),
    ]


def test_fetch_json(spark):
    df = frame(spark, (200, "OK", {}, "[1,2]", None), (200, "OK", {}, "[1", None), (200, "OK", {}, "null", None),
               (200, "OK", {}, "{}", "down"))
    result = r.fetch_json(df, {"filter": "item::int > 1"}).withColumn("data", F.to_json("data"))
    assert by_url(result, "status", "data", "error") == [
        (200, "[2]", None),
        (None, None, "Failed to parse JSON response: SyntaxError"),
        (200, "null", None),
        (None, None, "Failed to fetch JSON: down"),
    ]
    keys = r.fetch_json(df, {"extract": ["a"]})
    assert by_url(keys, "error")[2] == ("Failed to parse JSON response: SyntaxError",)


def test_post_webhook_api(spark):
    df = frame(spark, (500, "Bad", {"Content-Type": "application/json"}, '{"a":1}', None))
    assert by_url(r.post_result(df), "status", "error") == [(None, "HTTP 500: Bad")]
    assert by_url(r.webhook_result(df), "status", "response", "error") == [(500, '{"a":1}', None)]
    api = r.api_result(df).withColumn("bodyJson", F.to_json("bodyJson"))
    assert by_url(api, "status", "bodyJson", "bodyText", "error") == [(500, '{"a":1}', None, None)]
    other = frame(spark, (200, "OK", {"content-type": "application/json"}, '{"a":1}', None),
                  (200, "OK", {"Content-Type": "application/json"}, '{"a"', None), (200, "OK", None, "t", None))
    assert by_url(r.api_result(other), "bodyText") == [('{"a":1}',), ('{"a"',), ("t",)]


def test_scrape(spark):
    df = frame(spark, (200, "OK", {}, "<title>T</title><a href='/x'>y</a>", None), (404, "No", {}, "<p>", None))
    scraped = r.scrape_pages(df, {"links": "<a[^>]*>", "bad": "(["})
    assert by_url(scraped, "title", "links", "images", "bad", "error") == [
        ("T", ["<a href='/x'>"], [], [], None),
        (None, None, None, None, "HTTP 404: No"),
    ]


def test_header_echo(spark):
    df = spark.createDataFrame(
        [
            (0, {"X-ID": "1", "B": "2"}, {"x-id": "1", "b": "2", "c": "3"}),
            (1, {"X-ID": "1"}, {"x-id": "2"}),
            (2, {"X-ID": "1"}, {}),
            (3, {}, {}),
            (4, {"X-ID": "1"}, None),
        ],
        "i int, sent map<string,string>, received map<string,string>",
    )
    assert [row.passed for row in r.header_echo(df).orderBy("i").collect()] == [True, False, False, True, False]


def test_requests(spark):
    calls = [
        ("postData", "u", None, None, None),
        ("postData", "u", None, {"Content-Type": "text/plain"}, '"raw"'),
        ("apiRequest", "u", "patch", {"A": "b"}, '{"k":1}'),
        ("apiRequest", "u", "get", {}, '{"k":1}'),
        ("apiRequest", "u", "put", {}, "0"),
        ("webhookCall", "u", "put", {"Content-Type": "x"}, '"p"'),
        ("webhookCall", "", None, {}, None),
        ("fetchJSON", "u", "POST", {"Accept": "x", "B": "c"}, '{"k":1}'),
        ("checkStatus", "u", None, {"B": "c"}, None),
        ("scrapeWebpage", "u", None, {"B": "c"}, None),
        ("fetchData", None, None, {"B": "c"}, None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(calls)],
                               "i int, kind string, url string, method string, headers map<string,string>, t string")
    built = build_requests(df.withColumn("data", parse_json(F.col("t"))).drop("t"), "agent").orderBy("i").collect()
    json_type = {"Content-Type": "application/json"}
    assert [(b.method, b.headers, b.body, b.error) for b in built] == [
        ("POST", json_type, "{}", None),
        ("POST", {"Content-Type": "text/plain"}, "raw", None),
        ("PATCH", {"A": "b", **json_type}, '{"k":1}', None),
        ("GET", {}, None, None),
        ("PUT", {}, None, None),
        ("put", json_type, '"p"', "Webhook method must be POST or PUT"),
        ("POST", json_type, "{}", "Webhook URL is required"),
        ("GET", {"B": "c", "Accept": "application/json"}, None, None),
        ("GET", None, None, None),
        ("GET", {"User-Agent": "agent"}, None, None),
        ("GET", {"B": "c"}, None, "URL is required"),
    ]
