"""The corpus job over a folder that changes: only files that are new or changed are read again.

A version of the output holds a manifest (path, length, time of change, and the run that extracted the file), the
records of the files that its run read, and the totals of all. Records of files that did not change stay where an
earlier run wrote them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators.corpus import add_averages, corpus_totals, extract_stage, file_type_counts
from corpuscope.operators.rules import Rules, apply_rules
from corpuscope.plans.corpus_job import SOURCE
from corpuscope.sources.files import read_text_files, scan_files
from corpuscope.sources.sinks import write_json
from corpuscope.sources.versions import commit_version, current_version, drop_folders, new_folder

#: Paths of changed files that the driver holds at a time; a folder's listing is held by it in any case.
PATHS = 10_000

_MARKS = ["path", "length", "modificationTime"]
_TOTALS = ("totalFiles", "totalSize", "totalLines", "totalWords")
_TYPES = "extension string, files bigint"


def _escaped(path: str) -> str:
    """A path that is taken as it is, not as a pattern."""
    return re.sub(r"([\\*?\[\]{},])", r"\\\1", path)


def _blocks(paths: DataFrame) -> Iterator[list[str]]:
    block: list[str] = []
    for row in paths.toLocalIterator():
        block.append(_escaped(row.path))
        if len(block) == PATHS:
            yield block
            block = []
    if block:
        yield block


def _whole(records: DataFrame) -> bool:
    """Whether all that is summed is a whole number, so that differences are exact."""
    kinds = dict(records.dtypes)
    return all(kinds.get(c, "bigint") in ("tinyint", "smallint", "int", "bigint") for c in ("size", "lines", "wordCount"))


def run_incremental_job(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    rules: Rules | None = None,
    run_ts: str | None = None,
    recursive: bool = False,
) -> DataFrame:
    """Bring the output up to date with the folder and return the aggregate row.

    The first run, or one with other rules, reads all files. A later one compares the listing with the last manifest by path,
    length and time of change: files that are new or changed are read, what is gone or
    replaced is taken off the totals by its own stored records, and nothing else is touched. Totals that are no whole
    numbers (rules may make them so) are summed anew from the stored records, without reading a text.

    The new version holds once its last row is written; a run that breaks before leaves the old version
    as it was, and its folder is never read (see :func:`clean`). Two runs at once cannot both be
    committed: the slower one raises :class:`corpuscope.sources.versions.Conflict`. A folder without files is an empty
    corpus; a missing one stops the job.
    """
    output_path = output_path.rstrip("/")
    recipe = json.dumps(rules or {}, sort_keys=True, default=str)
    before = current_version(spark, output_path)
    base = f"{output_path}/{before.folder}" if before and before.recipe == recipe else None
    folder = new_folder()
    here = f"{output_path}/{folder}"

    listing = scan_files(spark, input_path, recursive=recursive).select(*_MARKS)
    if base is None:
        old = spark.createDataFrame([], "path string, length bigint, modificationTime timestamp, run string")
    else:
        old = spark.read.parquet(f"{base}/manifest")
    kept = listing.join(old, _MARKS).select(*_MARKS, "run")
    fresh = listing.join(old, _MARKS, "left_anti").select(*_MARKS, F.lit(folder).alias("run"))
    kept.union(fresh).write.parquet(f"{here}/manifest")
    manifest = spark.read.parquet(f"{here}/manifest")
    fresh = manifest.filter(F.col("run") == folder)
    gone = old.join(manifest, [*_MARKS, "run"], "left_anti").select("path", "run")

    # an empty table first, so that a run without changes has one too
    blocks = [None] if base is None else [[], *_blocks(fresh.select("path"))]
    for block in blocks:
        if block is None:
            files = read_text_files(spark, input_path, recursive).join(fresh.select("path"), "path", "left_semi")
        elif block:
            files = read_text_files(spark, block)
        else:
            files = spark.createDataFrame([], "path string, filename string, content string")
        files = files.withColumnRenamed("path", SOURCE)
        extract_stage(files, run_ts, keep=(SOURCE,)).write.mode("append").parquet(f"{here}/extracted")
    extracted = spark.read.parquet(f"{here}/extracted")
    apply_rules(extracted, rules or {}, keep=(SOURCE,)).write.parquet(f"{here}/transformed")
    added = spark.read.parquet(f"{here}/transformed")

    if base is None:
        totals, types = corpus_totals(added), file_type_counts(added)
    else:
        runs = [row.run for row in gone.select("run").distinct().collect()]  # one row per earlier run
        lost = _records(spark, output_path, runs, gone, added)
        if _whole(added):
            totals = _difference(spark, base, added, lost)
        else:
            totals = corpus_totals(_current(spark, output_path, manifest, added))
        earlier = spark.read.schema(_TYPES).json(f"{base}/file_types")
        minus = file_type_counts(lost).select("extension", (-F.col("files")).alias("files"))
        types = earlier.union(file_type_counts(added)).union(minus).groupBy("extension").agg(F.sum("files").alias("files"))
        types = types.filter("files > 0")
    write_json(add_averages(totals), f"{here}/totals")
    write_json(types, f"{here}/file_types")
    commit_version(spark, output_path, folder, before, recipe)
    return spark.read.schema(add_averages(totals).schema).json(f"{here}/totals")


def _difference(spark: SparkSession, base: str, added: DataFrame, lost: DataFrame) -> DataFrame:
    """The last totals, those of new records added and those of lost ones taken off."""
    known = spark.read.schema(", ".join(f"{t} bigint" for t in _TOTALS)).json(f"{base}/totals")
    minus = corpus_totals(lost).select(*(-F.col(t) for t in _TOTALS))
    parts = known.union(corpus_totals(added).select(*_TOTALS)).union(minus)
    return parts.agg(*(F.sum(t).cast("bigint").alias(t) for t in _TOTALS))


def _records(spark: SparkSession, output_path: str, runs: list[str], entries: DataFrame, like: DataFrame) -> DataFrame:
    """The stored records of some entries (path, run) of a manifest."""
    empty = like.limit(0)
    tables = [
        spark.read.parquet(f"{output_path}/{run}/transformed").join(
            entries.filter(F.col("run") == run).select(F.col("path").alias(SOURCE)), SOURCE, "left_semi"
        )
        for run in runs
    ]
    return reduce(DataFrame.unionByName, tables, empty)


def _current(spark: SparkSession, output_path: str, manifest: DataFrame, like: DataFrame) -> DataFrame:
    runs = [row.run for row in manifest.select("run").distinct().collect()]
    return _records(spark, output_path, runs, manifest.select("path", "run"), like)


def current_records(spark: SparkSession, output_path: str) -> DataFrame:
    """The records of all files of the version that holds, with the file's ``_path``."""
    output_path = output_path.rstrip("/")
    folder = current_version(spark, output_path).folder
    manifest = spark.read.parquet(f"{output_path}/{folder}/manifest")
    return _current(spark, output_path, manifest, spark.read.parquet(f"{output_path}/{folder}/transformed"))


def compact(spark: SparkSession, output_path: str) -> None:
    """Write the records of all runs into one new version, so that later runs read one table."""
    output_path = output_path.rstrip("/")
    before = current_version(spark, output_path)
    base, folder = f"{output_path}/{before.folder}", new_folder()
    here = f"{output_path}/{folder}"
    manifest = spark.read.parquet(f"{base}/manifest")
    current_records(spark, output_path).write.parquet(f"{here}/transformed")
    manifest.withColumn("run", F.lit(folder)).write.parquet(f"{here}/manifest")
    for name in ("totals", "file_types"):
        spark.read.text(f"{base}/{name}").write.text(f"{here}/{name}")
    commit_version(spark, output_path, folder, before, before.recipe)


def clean(spark: SparkSession, output_path: str) -> list[str]:
    """Remove the folders that the version that holds does not need; returns their names. Not while a job runs."""
    output_path = output_path.rstrip("/")
    now = current_version(spark, output_path)
    manifest = spark.read.parquet(f"{output_path}/{now.folder}/manifest")
    used = {row.run for row in manifest.select("run").distinct().collect()}
    return drop_folders(spark, output_path, used | {now.folder})
