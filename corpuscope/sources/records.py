"""Readers of stored responses, calls and catalogs: JSON text to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSE_TYPE = (
    "struct<url:string,statusCode:int,statusText:string,headers:map<string,string>,body:string,error:string>"
)
CALL_TYPE = (
    "struct<name:string,toolType:string,execHandler:string,sessionId:string,pluginName:string,"
    "arguments:variant,execMethod:string>"
)
MESSAGE_TYPE = "struct<jsonrpc:string,id:string,method:string,params:variant,result:variant>"
CATALOG_TYPES = {
    "prompt": "name string, template string, arguments variant",
    "resource": "name string, uri string, mimeType string",
}


def _expand(df: DataFrame, json_col: str, type_name: str, names: dict[str, str]) -> DataFrame:
    parsed = df.withColumn("_parsed", F.from_json(json_col, type_name))
    kept = [c for c in df.columns if c != json_col]
    return parsed.select(*kept, *(F.col(f"_parsed.{member}").alias(name) for member, name in names.items()))


def read_responses(df: DataFrame, json_col: str = "value") -> DataFrame:
    """Response JSON to url, status_code, status_text, headers, body, error."""
    names = {
        "url": "url",
        "statusCode": "status_code",
        "statusText": "status_text",
        "headers": "headers",
        "body": "body",
        "error": "error",
    }
    return _expand(df, json_col, RESPONSE_TYPE, names)


def read_calls(df: DataFrame, json_col: str = "value") -> DataFrame:
    """Call record JSON to its seven members; ``arguments`` is VARIANT."""
    names = ["name", "toolType", "execHandler", "sessionId", "pluginName", "arguments", "execMethod"]
    return _expand(df, json_col, CALL_TYPE, {n: n for n in names})


def read_messages(df: DataFrame, json_col: str = "value") -> DataFrame:
    """JSON-RPC message to jsonrpc, id, method, params, result."""
    names = ["jsonrpc", "id", "method", "params", "result"]
    return _expand(df, json_col, MESSAGE_TYPE, {n: n for n in names})


def read_catalog(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Prompt or resource definitions, one JSON object per line.

    A prompt's ``arguments`` become JSON text, so that definitions compare.
    """
    catalog = spark.read.schema(CATALOG_TYPES[kind]).json(path)
    return catalog.withColumn("arguments", F.to_json("arguments")) if kind == "prompt" else catalog


def call_json(**members: Column) -> Column:
    """JSON text of a record with the given members, for writing call logs."""
    return F.to_json(F.struct(*(value.alias(name) for name, value in members.items())))
