"""Compiler-probe output: lines under ``=== title ===`` headers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.jsontext import NO_LIMITS, quote

# Header form and the verdicts that end a feature line.
HEADER = r"^=== (.*) ===$"
SUPPORTED = [" supported", " compatible"]
UNSUPPORTED = [" not available", " not supported or failed"]

# The features that are probed.
FEATURES = [
    "-O3",
    "-g",
    "-fPIC",
    "-fPIE",
    "-flto",
    "-fstack-protector-strong",
    "-fexceptions",
    "-frtti",
    "LTO",
    "PIE",
    "Stack protector",
    "ASLR",
]

BLOCK_LINES = 65_536


def probe_sections(
    lines: DataFrame,
    run: str = "run",
    line_no: str = "line_no",
    text: str = "text",
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """Add ``section``: the title of the last header at or above each line.

    A run may be of any length, so it is cut into blocks of line numbers. Each
    block is filled by itself, and what a block inherits is worked out on one
    row per block. Lines before the first header have no section.
    """
    title = F.when(F.col(text).rlike(HEADER), F.regexp_extract(text, HEADER, 1))
    blocked = lines.withColumn("_block", F.floor(F.col(line_no) / block_lines)).withColumn("_title", title)

    within = Window.partitionBy(run, "_block").orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    own = blocked.withColumn("_own", F.last("_title", ignorenulls=True).over(within))

    per_block = blocked.groupBy(run, "_block").agg(
        F.max_by("_title", F.when(F.col("_title").isNotNull(), F.col(line_no))).alias("_last")
    )
    before = Window.partitionBy(run).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inherited = per_block.select(run, "_block", F.last("_last", ignorenulls=True).over(before).alias("_inherited"))

    # the lines are already sorted by run and block, so a merge moves only the other side
    joined = own.join(inherited.hint("merge"), [run, "_block"], "left")
    return joined.withColumn("section", F.coalesce("_own", "_inherited")).select(*lines.columns, "section")


def feature_name(label: Column) -> Column:
    """A flag is its own first word; other features keep the whole label."""
    return F.when(F.startswith(label, F.lit("-")), F.substring_index(label, " ", 1)).otherwise(label)


def probe_verdicts(lines: DataFrame, host: str = "host", line_no: str = "line_no", text: str = "text") -> DataFrame:
    """Per host and feature whether it is supported, by the last line that says so."""
    line = F.col(text)
    no, yes = _label(line, UNSUPPORTED), _label(line, SUPPORTED)
    # tested on the line, not on the feature: this is what gets pushed below
    judged = reduce(or_, (line.endswith(v) for v in UNSUPPORTED + SUPPORTED))
    found = lines.where(judged).select(
        host,
        line_no,
        feature_name(F.coalesce(no, yes)).alias("feature"),
        no.isNull().alias("supported"),
    )
    return found.groupBy(host, "feature").agg(F.max_by("supported", line_no).alias("supported"))


def _label(line: Column, verdicts: list[str]) -> Column:
    """The line without the verdict it ends in, NULL if it ends in none of them."""
    return F.coalesce(
        *(F.when(line.endswith(v), F.left(line, F.length(line) - len(v))) for v in verdicts)
    )


def probe_capabilities(
    lines: DataFrame, host: str = "host", features: list[str] | None = None, **columns: str
) -> DataFrame:
    """One row per host, one boolean column per listed feature, NULL where nothing was said; and ``others``.

    The set of features is open: ``others`` is a map of all features that are not listed, in order of name, to
    whether they are supported, NULL if there are none. Two aggregates: the last verdict of each host and
    feature, one row per task before the shuffle, then the features of a host.
    """
    listed = FEATURES if features is None else features
    named = F.col("feature").isin(*listed) if listed else F.lit(False)
    member = F.when(~named, F.concat(quote(F.col("feature")), F.lit(":"), F.col("supported").cast("string")))
    verdicts = probe_verdicts(lines, host, **columns).withColumn("_member", member)
    found = verdicts.groupBy(host).agg(
        *(F.bool_or(F.when(F.col("feature") == name, F.col("supported"))).alias(name) for name in listed),
        F.expr("listagg(_member, ',') WITHIN GROUP (ORDER BY feature)").alias("_others"),
    )
    others = F.from_json(F.concat(F.lit("{"), "_others", F.lit("}")), "map<string,boolean>", NO_LIMITS)
    return found.withColumn("others", others).drop("_others")
