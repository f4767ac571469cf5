"""Lookups by key: existence, catalogs, handlers, config overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.jsontext import (
    PARSE_ERROR,
    STRING,
    is_object,
    json_error,
    kind,
    member,
    scalar_text,
    with_json,
)
from corpuscope.functions.paths import url_filename

# Messages of failed lookups, and what a missing resource shows.
NO_PROMPT_NAME = "Prompt name requiered"
NO_PROMPT = "Failed to get prompt "
NO_RESOURCE_NAME = "MCP resource name required"
NO_RESOURCE = "Failed to load resource: "
NO_RESOURCE_TYPE = "plain/text"
BAD_PROMPT = "Failed to parse prompt "
BAD_RESOURCE = "Failed to parse resource: "
NO_HANDLER = "Unknown handler: "
NO_URL = "URL is required"
NO_DOWNLOAD = "Failed to download file"

BAD_PARAMS = PARSE_ERROR

def one_per_key(df: DataFrame, key: str, *columns: Column) -> DataFrame:
    """Aggregate a right side to one row per key.

    Grouped by a hash besides the key, its rows are not yet dealt by the key alone, so a join
    deals both sides anew; only then can adaptive execution split a hot key of the left.
    """
    return df.groupBy(F.xxhash64(key).alias("_hash"), key).agg(F.lit(True).alias("_found"), *columns).drop("_hash")


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join to the one row per key of :func:`one_per_key`; ``how`` is left, left_semi or left_anti.

    No hint and no job of its own: adaptive execution sees the real sizes and broadcasts
    a small right side, or splits the partitions that a hot key of the left makes large, by
    as much as they are larger.
    """
    return left.join(right, key, how)


def exists_flag(
    manifest: DataFrame, files: DataFrame, key: str = "path", details: tuple[str, ...] = ()
) -> DataFrame:
    """The manifest with a column ``exists``, and the ``details`` columns of the files found.

    For a path listed twice the details are the largest of each.
    """
    known = one_per_key(files, key, *(F.max(c).alias(c) for c in details))
    found = lookup(manifest, known, key)
    return found.withColumn("exists", F.col("_found").isNotNull()).drop("_found")


def existing(manifest: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Manifest rows whose file exists."""
    return lookup(manifest, one_per_key(files, key), key, "left_semi")


def missing(manifest: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Manifest rows whose file does not exist."""
    return lookup(manifest, one_per_key(files, key), key, "left_anti")


def _definitions(catalog: DataFrame, columns: list[str], name: str) -> DataFrame:
    """One definition per name; of several the smallest, so that reruns agree.

    A definition without any member stands for JSON null: it is known, but says nothing.
    """
    said = F.greatest(F.lit(False), *(F.col(c).isNotNull() for c in columns)).alias("_said")
    named = catalog.withColumnRenamed("name", name)
    chosen = one_per_key(named, name, F.min(F.struct(~said, *columns, said)).alias("_entry"))
    fields = [f"_entry.{c}" for c in [*columns, "_said"]]
    return chosen.select(name, "_found", *fields)


def prompt_lookup(df: DataFrame, prompts: DataFrame, name: str = "promptName") -> DataFrame:
    """Template and arguments of each named prompt, or an error."""
    found = lookup(df, _definitions(prompts, ["template", "arguments"], name), name)
    wanted = F.col(name)
    error = (
        F.when(F.coalesce(wanted, F.lit("")) == "", NO_PROMPT_NAME)
        .when(F.col("_found").isNull(), F.concat(F.lit(NO_PROMPT), wanted))
        .when(~F.col("_said"), F.concat(F.lit(BAD_PROMPT), wanted))
    )
    message = F.when(error.isNull(), F.concat(wanted, F.lit(": "), F.coalesce("template", F.lit("undefined"))))
    return found.withColumns({"message": message, "error": error}).drop("_found", "_said")


def resource_lookup(df: DataFrame, resources: DataFrame, name: str = "resourceName") -> DataFrame:
    """Address, media type and ``name`` of each named resource, or an error."""
    found = lookup(df, _definitions(resources, ["uri", "mimeType"], name), name)
    wanted = F.col(name)
    asked = F.coalesce(F.nullif(wanted, F.lit("")), F.lit(NO_RESOURCE_NAME))
    error = F.when(F.col("_found").isNull(), F.concat(F.lit(NO_RESOURCE), asked)).when(
        ~F.col("_said"), F.concat(F.lit(BAD_RESOURCE), asked)
    )
    known = error.isNull()
    uri = F.coalesce("uri", F.lit("undefined"))
    text = F.when(known, F.concat(wanted, F.lit(": take a look following link:\n"), uri)).otherwise(error)
    return found.withColumns(
        {
            "text": text,
            "error": error,
            "uri": F.when(known, F.col("uri")).otherwise(""),
            "mimeType": F.when(known, F.col("mimeType")).otherwise(NO_RESOURCE_TYPE),
            "name": F.when(known, wanted).otherwise(""),
        }
    ).drop("_found", "_said")


def resolve_calls(calls: DataFrame, handlers: DataFrame) -> DataFrame:
    """Handler of each call, from ``handlerName`` and the JSON text ``params``.

    A non-empty ``testHandler`` parameter replaces the given name. Parameters
    that do not parse, and unknown names, give an error. ``handlers`` has
    ``handler`` and any columns to add.
    """
    params, given, text = F.col("_params"), F.col("_given"), F.col("_text")
    parsed = with_json(calls, "_params", F.col("params"))
    parsed = parsed.withColumn("_given", F.when(is_object(params), member(params, "testHandler")))
    parsed = parsed.withColumn("_text", scalar_text(given))
    usable = params.isNotNull() & ~F.is_variant_null(params)
    # '', false, 0 and null count as not given
    counts = F.when(kind(given) == STRING, text != "").otherwise(~text.isin("false", "0", "null"))
    handler = F.coalesce(F.when(counts, text), F.col("handlerName"))
    named = parsed.withColumn("handler", F.when(usable, handler)).drop("_given", "_text")
    extra = [c for c in handlers.columns if c != "handler"]
    known = one_per_key(handlers, "handler", F.min(F.struct(F.lit(True).alias("_known"), *extra)).alias("_entry"))
    found = lookup(named, known.select("handler", "_entry.*"), "handler")
    reason = F.coalesce(json_error(params, F.col("params")), F.lit(BAD_PARAMS))
    error = F.when(~usable, reason).when(
        F.col("_known").isNull(),
        F.concat(F.lit(NO_HANDLER), F.coalesce(F.col("handler"), F.lit("undefined"))),
    )
    return found.withColumn("error", error).drop("_params", "_known")


def download_info(downloads: DataFrame, files: DataFrame, temp_dir: str = "/tmp") -> DataFrame:
    """Path, size, existence and outcome of each download.

    ``downloads`` has ``url`` and ``destination``; where that is NULL or empty
    it is the URL's file name in ``temp_dir``. ``files`` has ``path`` and
    ``size``, one row per path. A download without a URL, or whose ``downloaded`` (where
    that column is given) is false, has an ``error``.
    """
    given = F.nullif(F.col("destination"), F.lit(""))
    default = F.concat(F.lit(temp_dir.rstrip("/") + "/"), url_filename(F.col("url")))
    wanted = downloads.withColumn("path", F.coalesce(given, default)).drop("destination")
    found = lookup(wanted, one_per_key(files, "path", F.max("size").alias("_size")), "path")
    failed = ~F.col("downloaded") if "downloaded" in downloads.columns else F.lit(False)
    error = F.when(F.coalesce("url", F.lit("")) == "", NO_URL).when(failed, NO_DOWNLOAD)
    return (
        found.withColumn("size", F.coalesce(F.col("_size"), F.lit(0)))
        .withColumn("exists", F.col("_found").isNotNull())
        .withColumn("error", error)
        .withColumn("success", F.col("error").isNull())
        .drop("_size", "_found")
    )


def last_wins(df: DataFrame, keys: list[str], order: str | Column, value: str) -> DataFrame:
    """The latest value per key; of several with one ``order`` the greatest, so that reruns agree.

    Rows without an order say that there is the key, not its value. An aggregate, not a window: every
    task sends one row per key, whatever the number of assignments to it.
    """
    place = F.col(order) if isinstance(order, str) else order
    ranked = F.when(place.isNotNull(), F.struct(place.alias("place"), F.col(value).alias("value")))
    return df.groupBy(*keys).agg(F.max(ranked).alias("_last")).select(*keys, F.col("_last.value").alias(value))


def env_overlay(env: DataFrame, parsed: DataFrame, key: str = "key") -> DataFrame:
    """The environment plus the parsed keys it does not have."""
    added = lookup(parsed, one_per_key(env, key), key, "left_anti")
    return env.unionByName(added.select(*env.columns))
