"""Path and URL functions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

DOWNLOAD_NAME = "download.txt"


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """What precedes the last slash, '' if there is none."""
    return F.regexp_extract(path, r"(?s)^(.*)/", 1)


def url_filename(url: Column) -> Column:
    """Base name of a URL, with a fixed name for URLs that end in a slash."""
    return F.coalesce(F.nullif(base_name(url), F.lit("")), F.lit(DOWNLOAD_NAME))


def file_extension(name: Column) -> Column:
    """What follows the last dot; the whole name if there is no dot."""
    return F.substring_index(name, ".", -1)


def has_extension(name: Column, extensions: list[str]) -> Column:
    """Whether the name ends in one of the suffixes."""
    return reduce(or_, (F.endswith(name, F.lit(ext)) for ext in extensions), F.lit(False))


def normalize_path(path: Column) -> Column:
    """Resolve '.', '..' and double slashes, keep a leading slash."""
    pieces = F.filter(F.split(path, "/"), lambda p: ~p.isin(".", ""))
    resolved = F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda done, p: F.when(
            p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        ).otherwise(F.concat(done, F.array(p))),
    )
    root = F.when(F.startswith(path, F.lit("/")), "/").otherwise("")
    return F.concat(root, F.array_join(resolved, "/"))
