"""Extraction from HTML by pattern."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.text import collapse_ws, preview_chars, trim_ws

# What is looked for.
TITLE = r"(?i)<title[^>]*>([^<]+)</title>"
SCRIPT = r"(?i)<script[^>]*>[^\n\r\u2028\u2029]*?</script>"
STYLE = r"(?i)<style[^>]*>[^\n\r\u2028\u2029]*?</style>"
TAG = r"<[^>]+>"
LINK = r"""(?i)<a[^>]+href=["']([^"']+)["'][^>]*>"""
IMAGE = r"""(?i)<img[^>]+src=["']([^"']+)["'][^>]*>"""


def html_title(html: Column) -> Column:
    """Text of the first title element that has some, '' if there is none."""
    return trim_ws(F.regexp_extract(html, TITLE, 1))


def html_text(html: Column, limit: int | None = None) -> Column:
    """Text without tags and without one-line scripts and styles, or its first ``limit`` characters.

    A script or style element that spans lines keeps its content.
    """
    without = F.regexp_replace(F.regexp_replace(html, SCRIPT, ""), STYLE, "")
    spaced = F.regexp_replace(without, TAG, " ")
    # every run of white space is one blank by now, so a plain trim is enough
    text = F.trim(collapse_ws(spaced))
    return text if limit is None else preview_chars(text, limit)


def _first(found: Column, limit: int | None) -> Column:
    return found if limit is None else F.slice(found, 1, limit)


def html_links(html: Column, limit: int | None = None) -> Column:
    """Link targets in document order, duplicates kept; with ``limit`` the first so many."""
    return _first(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), limit)


def html_images(html: Column, limit: int | None = None) -> Column:
    """Image sources in document order; with ``limit`` the first so many."""
    return _first(F.regexp_extract_all(html, F.lit(IMAGE), F.lit(1)), limit)


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether the JVM accepts ``pattern`` as a regular expression."""
    try:
        spark.range(1).select(F.regexp_like(F.lit(""), F.lit(pattern))).collect()
    except PySparkException:
        return False
    return True


def html_pattern(html: Column, pattern: str) -> Column:
    """Per match the first group, or the whole match where that is empty.

    The pattern must be valid (see :func:`valid_pattern`). The empty group put
    behind it makes group 1 exist for a pattern without groups.
    """
    search = F.lit(f"(?i)(?:{pattern})()")
    whole = F.regexp_extract_all(html, search, F.lit(0))
    group = F.regexp_extract_all(html, search, F.lit(1))
    return F.zip_with(group, whole, lambda g, w: F.coalesce(F.nullif(g, F.lit("")), w))
