"""Queries over lookups, call and result records, logs, probes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators.lookups import (
    download_info,
    env_overlay,
    existing,
    exists_flag,
    last_wins,
    missing,
    prompt_lookup,
    resolve_calls,
    resource_lookup,
)
from corpuscope.operators.probes import probe_capabilities, probe_sections, probe_verdicts
from corpuscope.operators.records import (
    log_counts,
    log_filter,
    output_text,
    read_envelope,
    result_counts,
    to_envelope,
    to_error_envelope,
)
from corpuscope.operators.reports import report_lines, stage_report
from corpuscope.plans.registry import query, table
from corpuscope.session import scratch_path
from corpuscope.sources.records import call_json, read_calls, read_catalog, read_messages
from corpuscope.sources.sinks import write_json

# ---- existence and lookups

_MANIFEST = "SELECT doc_id, concat('/labels/', doc_id) AS path FROM documents"
_LABELLED = "SELECT DISTINCT concat('/labels/', doc_id) AS path FROM labels"


def _manifest(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).select("doc_id", F.expr("concat('/labels/', doc_id)").alias("path"))


@query(
    "exists_flag",
    f"""SELECT doc_id, m.path, f.path IS NOT NULL AS "exists"
    FROM ({_MANIFEST}) m LEFT JOIN ({_LABELLED}) f ON m.path = f.path""",
)
def exists_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exists_flag(_manifest(spark, sf_dir, "documents"), _manifest(spark, sf_dir, "labels"))


@query(
    "existing_only",
    f"SELECT * FROM ({_MANIFEST}) WHERE path IN ({_LABELLED})",
)
def existing_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return existing(_manifest(spark, sf_dir, "documents"), _manifest(spark, sf_dir, "labels"))


@query(
    "missing_only",
    f"SELECT * FROM ({_MANIFEST}) WHERE path NOT IN ({_LABELLED})",
)
def missing_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing(_manifest(spark, sf_dir, "documents"), _manifest(spark, sf_dir, "labels"))


_HOT_PATH = "CASE WHEN event_id % 3 = 0 THEN '/hot' ELSE concat('/users/', user_id) END"


@query(
    "hot_lookup",
    f"""SELECT event_id, path, path IN (SELECT concat('/users/', c_custkey) FROM customer UNION ALL SELECT '/hot')
        AS "exists" FROM (SELECT event_id, {_HOT_PATH} AS path FROM events)""",
)
def hot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all events ask for one path."""
    asked = table(spark, sf_dir, "events").select("event_id", F.expr(_HOT_PATH).alias("path"))
    known = table(spark, sf_dir, "customer").select(
        F.explode(F.array(F.expr("concat('/users/', c_custkey)"), F.lit("/hot"))).alias("path")
    )
    return exists_flag(asked, known)


@query(
    "read_catalog",
    """SELECT 'prompt' AS kind, concat('p', conv_id, '-', turn) AS name, text AS template,
        concat('[{"name":"', role, '"}]') AS arguments, NULL AS uri, NULL AS "mimeType" FROM conversations
    UNION ALL SELECT 'resource', concat('r', conv_id, '-', turn), NULL, NULL, concat('res://', role), 'text/plain'
        FROM conversations""",
)
def catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and resources written as JSON lines and read back."""
    rows = table(spark, sf_dir, "conversations")
    prompts = rows.select(
        F.expr("concat('p', conv_id, '-', turn)").alias("name"),
        F.col("text").alias("template"),
        F.array(F.struct(F.col("role").alias("name"))).alias("arguments"),
    )
    resources = rows.select(
        F.expr("concat('r', conv_id, '-', turn)").alias("name"),
        F.expr("concat('res://', role)").alias("uri"),
        F.lit("text/plain").alias("mimeType"),
    )
    read = []
    for kind, entries in (("prompt", prompts), ("resource", resources)):
        path = scratch_path(spark, kind)
        write_json(entries, path)
        read.append(read_catalog(spark, path, kind).withColumn("kind", F.lit(kind)))
    return read[0].unionByName(read[1], allowMissingColumns=True)


@query(
    "catalog_lookup",
    """SELECT conv_id, turn, wanted AS "promptName",
        CASE WHEN wanted IN ('user', 'assistant') THEN concat('Answer as ', wanted) END AS template,
        CASE WHEN wanted IN ('user', 'assistant') THEN concat('[{"name":"', wanted, '"}]') END AS arguments,
        CASE WHEN wanted IN ('user', 'assistant') THEN concat(wanted, ': Answer as ', wanted) END AS message,
        CASE WHEN wanted = '' THEN 'Prompt name requiered'
            WHEN wanted = 'system' THEN 'Failed to get prompt system' END AS error
    FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN '' ELSE role END AS wanted FROM conversations)""",
)
def prompts_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    prompts = conversations.where("role <> 'system'").select(
        F.col("role").alias("name"),
        F.expr("concat('Answer as ', role)").alias("template"),
        F.expr("""concat('[{"name":"', role, '"}]')""").alias("arguments"),
    )
    asked = conversations.selectExpr("conv_id", "turn", "CASE WHEN turn % 5 = 3 THEN '' ELSE role END AS promptName")
    return prompt_lookup(asked, prompts.distinct())


@query(
    "catalog_lookup_resources",
    """SELECT conv_id, turn, role AS "resourceName",
        CASE WHEN role <> 'user' THEN concat(role, ': take a look following link:', chr(10), 'res://', role)
            ELSE 'Failed to load resource: user' END AS text,
        CASE WHEN role <> 'user' THEN concat('res://', role) ELSE '' END AS uri,
        CASE WHEN role <> 'user' THEN 'text/plain' ELSE 'plain/text' END AS "mimeType",
        CASE WHEN role <> 'user' THEN role ELSE '' END AS name,
        CASE WHEN role = 'user' THEN 'Failed to load resource: user' END AS error FROM conversations""",
)
def resources_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    resources = conversations.where("role <> 'user'").select(
        F.col("role").alias("name"),
        F.expr("concat('res://', role)").alias("uri"),
        F.lit("text/plain").alias("mimeType"),
    )
    asked = conversations.select("conv_id", "turn", F.col("role").alias("resourceName"))
    return resource_lookup(asked, resources.distinct())


_PARAMS = """CASE (conv_id + turn) % 6 WHEN 0 THEN '{}' WHEN 1 THEN '{"testHandler":"assistant"}' WHEN 2 THEN '{"a":'
    WHEN 3 THEN '{"testHandler":""}' WHEN 4 THEN '{"testHandler":"other"}' ELSE '[1]' END"""


@query(
    "resolve_calls",
    """WITH named AS (SELECT conv_id, turn, (conv_id + turn) % 6 = 2 AS broken, CASE (conv_id + turn) % 6
        WHEN 1 THEN 'assistant' WHEN 2 THEN NULL WHEN 4 THEN 'other' ELSE role END AS handler FROM conversations)
    SELECT conv_id, turn, handler,
        CASE WHEN handler IN ('user', 'assistant') THEN concat('mod_', handler) END AS module,
        CASE WHEN broken THEN 'SyntaxError: not valid JSON'
            WHEN handler NOT IN ('user', 'assistant') THEN concat('Unknown handler: ', handler) END AS error
    FROM named""",
)
def calls_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    handlers = conversations.where("role <> 'system'").select(
        F.col("role").alias("handler"), F.expr("concat('mod_', role)").alias("module")
    )
    calls = conversations.select("conv_id", "turn", F.col("role").alias("handlerName"), F.expr(_PARAMS).alias("params"))
    return resolve_calls(calls, handlers.distinct()).drop("handlerName", "params")


_TARGET = """coalesce(CASE WHEN page_id % 3 = 0 THEN concat('/data/', page_id, '.html') END,
    concat('/tmp/', coalesce(nullif(string_split(url, '/')[-1], ''), 'download.txt')))"""


@query(
    "download_info",
    f"""WITH downloads AS (SELECT page_id, url, html, page_id % 7 <> 5 AS downloaded, {_TARGET} AS path FROM pages),
    stored AS (SELECT path, max(length(html)) AS size FROM downloads WHERE starts_with(url, 'https') GROUP BY path)
    SELECT page_id, url, downloaded, d.path, CAST(coalesce(size, 0) AS BIGINT) AS size, s.path IS NOT NULL AS "exists",
        downloaded AS success, CASE WHEN NOT downloaded THEN 'Failed to download file' END AS error FROM downloads d LEFT JOIN stored s ON d.path = s.path""",
)
def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    asked = pages.selectExpr(
        "page_id", "url", "page_id % 7 <> 5 AS downloaded", "CASE WHEN page_id % 3 = 0 THEN concat('/data/', page_id, '.html') ELSE '' END AS destination"
    )
    stored = pages.where("startswith(url, 'https')").selectExpr(
        """coalesce(CASE WHEN page_id % 3 = 0 THEN concat('/data/', page_id, '.html') END,
        concat('/tmp/', coalesce(nullif(substring_index(url, '/', -1), ''), 'download.txt'))) AS path""",
        "CAST(length(html) AS BIGINT) AS size",
    )
    return download_info(asked, stored)


@query(
    "last_wins",
    "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
)
def last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "value")


@query(
    "env_overlay",
    """WITH env AS (SELECT concat('KEY_', user_id) AS key, arg_max(value, event_id) AS value FROM events
        WHERE event_id % 3 = 0 GROUP BY 1),
    parsed AS (SELECT concat('KEY_', user_id) AS key, arg_max(value, event_id) AS value FROM events
        WHERE event_id % 3 <> 0 GROUP BY 1)
    SELECT * FROM env UNION ALL SELECT * FROM parsed WHERE key NOT IN (SELECT key FROM env)""",
)
def env_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all events is the environment, the others are parsed settings."""
    events = table(spark, sf_dir, "events").withColumn("key", F.expr("concat('KEY_', user_id)"))
    env = last_wins(events.where("event_id % 3 = 0"), ["key"], "event_id", "value")
    parsed = last_wins(events.where("event_id % 3 <> 0"), ["key"], "event_id", "value")
    return env_overlay(env, parsed)


# ---- call records and envelopes


@query(
    "call_fields",
    """SELECT role AS name, 'CustomTool' AS "toolType", concat('do_', role) AS "execHandler",
    CAST(conv_id AS VARCHAR) AS "sessionId", 'plugin' AS "pluginName", turn AS turn_argument, text AS text_argument,
    'toolEntry' AS "execMethod" FROM conversations""",
)
def call_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "conversations").select(
        call_json(
            name=F.col("role"),
            toolType=F.lit("CustomTool"),
            execHandler=F.expr("concat('do_', role)"),
            sessionId=F.col("conv_id").cast("string"),
            pluginName=F.lit("plugin"),
            arguments=F.struct("turn", "text"),
            execMethod=F.lit("toolEntry"),
        ).alias("value")
    )
    return read_calls(stored).select(
        "*",
        F.try_variant_get("arguments", "$.turn", "bigint").alias("turn_argument"),
        F.try_variant_get("arguments", "$.text", "string").alias("text_argument"),
    ).drop("arguments")


@query(
    "message_fields",
    """SELECT '2.0' AS jsonrpc, concat(conv_id, '-', turn) AS id,
    CASE WHEN role = 'user' THEN 'tools/call' END AS method, CASE WHEN role = 'user' THEN text END AS asked,
    CASE WHEN role <> 'user' THEN text END AS answered FROM conversations""",
)
def message_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("role") == "user"
    stored = table(spark, sf_dir, "conversations").select(
        call_json(
            jsonrpc=F.lit("2.0"),
            id=F.expr("concat(conv_id, '-', turn)"),
            method=F.when(user, "tools/call"),
            params=F.when(user, F.struct("text")),
            result=F.when(~user, F.struct("text")),
        ).alias("value")
    )
    return read_messages(stored).select(
        "jsonrpc",
        "id",
        "method",
        F.try_variant_get("params", "$.text", "string").alias("asked"),
        F.try_variant_get("result", "$.text", "string").alias("answered"),
    )


@query(
    "result_envelope",
    """SELECT event_id, concat('{"text":', to_json(concat('{', chr(10), '  "event_id": ', event_id, ',', chr(10),
        '  "tags": [', chr(10), '    "', event_type, '",', chr(10), '    "x"', chr(10), '  ],', chr(10),
        '  "note": null', chr(10), '}')),
        ',"success":true,"metadata":{"operation":"', event_type, '","path":null}}') AS envelope,
    concat('{"text":"', event_type, ' failed","metadata":{"success":false,"error":"', event_type, ' failed"}}')
        AS failure FROM events""",
)
def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.struct(
            "event_id", F.array("event_type", F.lit("x")).alias("tags"), F.lit(None).cast("string").alias("note")
        ).alias("data"),
        F.struct(F.col("event_type").alias("operation"), F.lit(None).cast("string").alias("path")).alias("metadata"),
        F.concat("event_type", F.lit(" failed")).alias("message"),
    )
    failed = to_error_envelope(events, "message", with_success=False).withColumnRenamed("envelope", "failure")
    return to_envelope(failed, "data", "metadata").select("event_id", "envelope", "failure")


# Four forms of envelope; each success flag where that form has it.
_ENVELOPE = """CASE event_id % 4
    WHEN 0 THEN concat('{"text":"t', event_id, '","success":true,"metadata":{"operation":"', event_type, '"}}')
    WHEN 1 THEN concat('{"text":"t', event_id, '","metadata":{"operation":"', event_type, '","success":',
        CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END, ',"stdout":["a","b"],"stderr":[]}}')
    WHEN 2 THEN concat('{"text":"t', event_id, '","success":false,"metadata":{"operation":"', event_type,
        '","error":"bad"}}')
    ELSE concat('{"text":"t', event_id, '","metadata":{"operation":"', event_type, '"}}') END"""
_SUCCESS = "CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN user_id % 2 = 0 WHEN 2 THEN false END"


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(_ENVELOPE).alias("envelope"))


@query(
    "envelope_fields",
    f"""SELECT event_id, concat('t', event_id) AS text, {_SUCCESS} AS success, event_type AS operation,
    CASE WHEN event_id % 4 = 2 THEN 'bad' END AS error,
    CASE WHEN event_id % 4 = 1 THEN 'a b' END AS stdout FROM events""",
)
def envelope_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_envelope(_envelopes(spark, sf_dir))
    return read.select("event_id", "text", "success", "operation", "error", F.array_join("stdout", " ").alias("stdout"))


@query(
    "result_counts",
    f"""SELECT event_type AS operation, CAST(count(*) AS BIGINT) AS total,
    CAST(count(*) FILTER (success) AS BIGINT) AS succeeded, CAST(count(*) FILTER (NOT success) AS BIGINT) AS failed
    FROM (SELECT event_type, {_SUCCESS} AS success FROM events) GROUP BY 1""",
)
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_counts(read_envelope(_envelopes(spark, sf_dir)))


@query(
    "output_text",
    """SELECT conv_id, turn, concat('[Run] ', role, chr(10), text,
    CASE WHEN turn % 3 > 0 THEN concat(chr(10), 'Errors and Warnings:', chr(10), role, chr(10), turn) ELSE '' END)
    AS output FROM conversations""",
)
def output_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stderr = F.when(F.col("turn") % 3 > 0, F.array("role", F.col("turn").cast("string"))).otherwise(
        F.array().cast("array<string>")
    )
    output = output_text(F.concat(F.lit("[Run] "), "role"), F.split("text", "\n"), stderr)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", output.alias("output"))


# ---- logs

_LEVEL = """CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'info'
    ELSE 'debug' END"""


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr(_LEVEL).alias("level"),
        F.col("event_type").alias("category"),
        F.col("props").alias("context"),
    )


@query(
    "log_counts",
    f"""SELECT level, CAST(count(*) AS BIGINT) AS records,
    CAST(CASE level WHEN 'debug' THEN 0 WHEN 'info' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS BIGINT) AS rank
    FROM (SELECT lower({_LEVEL}) AS level FROM events) GROUP BY 1""",
)
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_counts(_logs(spark, sf_dir))


@query(
    "log_filter",
    f"""SELECT event_id, {_LEVEL} AS level, event_type AS category, props AS context FROM events
    WHERE event_type IN ('error', 'purchase')""",
)
def warnings_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_filter(_logs(spark, sf_dir), "warning")


# ---- probe output

_PROBE_LINE = "CASE WHEN line_no % 7 = 3 THEN concat('=== ', substring(line, 1, 12), ' ===') ELSE line END"


@query(
    "probe_sections",
    f"""WITH lines AS (SELECT doc_id AS run, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
    probe AS (SELECT run, line_no, {_PROBE_LINE} AS text, CASE WHEN line_no % 7 = 3 THEN substring(line, 1, 12) END
        AS title FROM lines)
    SELECT run, CAST(line_no AS INTEGER) AS line_no, text, last_value(title IGNORE NULLS) OVER (
        PARTITION BY run ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM probe""",
)
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents, every seventh made a header."""
    lines = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("run"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return probe_sections(lines.select("run", "line_no", F.expr(_PROBE_LINE).alias("text")))


# One feature per event type; the value decides on the verdict.
_VERDICT_LINE = """CASE event_type
    WHEN 'view' THEN CASE WHEN value > 250 THEN '-O3 optimization supported' ELSE '-O3 optimization not available' END
    WHEN 'click' THEN CASE WHEN value > 250 THEN 'LTO supported' ELSE 'LTO not supported or failed' END
    WHEN 'signup' THEN CASE WHEN value > 250 THEN '-flto thin LTO supported' ELSE '-flto not available' END
    WHEN 'purchase' THEN CASE WHEN value > 250 THEN 'ASLR compatible' ELSE 'ASLR not available' END
    ELSE 'Checking PIC support:' END"""
_FEATURE = "CASE event_type WHEN 'view' THEN '-O3' WHEN 'click' THEN 'LTO' WHEN 'signup' THEN '-flto' ELSE 'ASLR' END"
_VERDICTS_SQL = f"""SELECT user_id AS host, {_FEATURE} AS feature, arg_max(value > 250, event_id) AS supported
    FROM events WHERE event_type <> 'error' GROUP BY 1, 2"""


def _probe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("host"), F.col("event_id").alias("line_no"), F.expr(_VERDICT_LINE).alias("text")
    )


@query(
    "probe_verdicts",
    _VERDICTS_SQL,
)
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe_verdicts(_probe_lines(spark, sf_dir))


# Besides, features that no list names: as many as there are users at some hosts.
_OPEN_LINE = f"CASE WHEN event_type = 'error' THEN concat('-fx', user_id % 97, ' odd option supported') ELSE {_VERDICT_LINE} END"
_OPEN_FEATURE = f"CASE WHEN event_type = 'error' THEN concat('-fx', user_id % 97) ELSE {_FEATURE} END"


@query(
    "probe_capabilities",
    f"""WITH verdicts AS (SELECT user_id % 500 AS host, {_OPEN_FEATURE} AS feature,
        arg_max(event_type = 'error' OR value > 250, event_id) AS supported FROM events GROUP BY 1, 2)
    SELECT host, concat('{{', string_agg(concat('"', feature, '":', supported), ',' ORDER BY feature)
            FILTER (starts_with(feature, '-fx') OR feature = 'ASLR'), '}}') AS others,
        bool_or(supported) FILTER (feature = '-O3') AS o3, bool_or(supported) FILTER (feature = 'LTO') AS lto,
        bool_or(supported) FILTER (feature = '-flto') AS flag, bool_or(supported) FILTER (feature = 'PIE') AS pie
    FROM verdicts GROUP BY host""",
)
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four features of each host as columns, and all others, those that no list names too."""
    lines = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 500).alias("host"), F.col("event_id").alias("line_no"), F.expr(_OPEN_LINE).alias("text")
    )
    found = probe_capabilities(lines, features=["-O3", "LTO", "-flto", "PIE"])
    return found.select(
        "host",
        F.coalesce(F.to_json("others"), F.lit("{}")).alias("others"),
        F.col("`-O3`").alias("o3"),
        F.col("LTO").alias("lto"),
        F.col("`-flto`").alias("flag"),
        F.col("PIE").alias("pie"),
    )


# ---- reports

_REPORT_JSON = """concat('{"type":"', event_type, '","value":', value, ',"detail":{"user":', user_id,
    ',"list":[1,"a",null],"deep":{"x":1},"none":null},"list":[', event_id, ',"b"],"none":null}',
    CASE WHEN event_id % 10 = 9 THEN '}' ELSE '' END)"""


@query(
    "report_lines",
    """WITH reports AS (SELECT event_id, unnest([
        {'seq': 0, 'lines': [repeat('=', 40), 'Data Processing Report', repeat('=', 40),
            'Generated: 2024-01-01T00:00:00.000Z', '']},
        {'seq': 1, 'lines': [concat('type: "', event_type, '"')]},
        {'seq': 2, 'lines': [concat('value: ', regexp_replace(CAST(value AS VARCHAR), '\\.0$', ''))]},
        {'seq': 3, 'lines': ['', 'detail:', concat('  user: ', user_id), '  list: 1,a,', '  deep: [object Object]',
            '  none: null']},
        {'seq': 4, 'lines': [concat('list: [', event_id, ',"b"]')]},
        {'seq': 5, 'lines': ['', 'none:']},
        {'seq': 6, 'lines': ['', repeat('=', 40)]}]) AS part FROM events WHERE json_valid(""" + _REPORT_JSON + """))
    SELECT event_id, CAST(part.seq AS INTEGER) AS seq,
        CAST(generate_subscripts(part.lines, 1) - 1 AS INTEGER) AS line_no, unnest(part.lines) AS line FROM reports""",
)
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "events").select("event_id", F.expr(_REPORT_JSON).alias("text"))
    return report_lines(texts, "event_id", "text", "2024-01-01T00:00:00.000Z")


@query(
    "stage_report",
    """WITH runs AS (SELECT conv_id AS run, concat('t', min(turn)) AS s, concat('t', max(turn)) AS e,
            count(*) AS n FROM conversations GROUP BY 1),
    blocks AS (
        SELECT run, 0 AS part, 0 AS seq, [repeat('=', 40), 'Pipeline Execution Report', repeat('=', 40),
            concat('Start Time: ', s), concat('End Time: ', e), concat('Total Stages: ', n), ''] AS lines FROM runs
        UNION ALL SELECT conv_id, 1, turn, [concat('--- Stage ', turn + 1, ': ', role, ' ---'), '{',
            concat('  "chars": ', length(text)) || CASE WHEN role = 'user' THEN ',' ELSE '' END]
            || CASE WHEN role = 'user' THEN ['  "who": "user"'] ELSE [] END || ['}', ''] FROM conversations
        UNION ALL SELECT run, 2, 0, ['--- Errors ---'] FROM runs WHERE run IN
            (SELECT conv_id FROM conversations WHERE role = 'system')
        UNION ALL SELECT conv_id, 2, turn + 1, [concat('- system ', turn)] FROM conversations WHERE role = 'system'
        UNION ALL SELECT run, 3, 0, [''] FROM runs WHERE run IN
            (SELECT conv_id FROM conversations WHERE role = 'system')
        UNION ALL SELECT run, 4, 0, [repeat('=', 40)] FROM runs)
    SELECT run, part, CAST(seq AS BIGINT) AS seq, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_no,
        unnest(lines) AS line FROM blocks""",
)
def stage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as runs, turns as stages, system turns as errors."""
    turns = table(spark, sf_dir, "conversations").withColumnsRenamed({"conv_id": "run", "turn": "seq"})
    runs = turns.groupBy("run").agg(
        F.concat(F.lit("t"), F.min("seq").cast("string")).alias("startTime"),
        F.concat(F.lit("t"), F.max("seq").cast("string")).alias("endTime"),
    )
    result = F.struct(F.length("text").alias("chars"), F.when(F.col("role") == "user", F.col("role")).alias("who"))
    stages = turns.select("run", "seq", F.col("role").alias("stage"), result.alias("result"))
    errors = turns.where("role = 'system'").select("run", "seq", F.expr("concat('system ', seq)").alias("message"))
    return stage_report(runs, stages, errors)
