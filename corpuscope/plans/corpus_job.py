"""The corpus job: extract, transform, aggregate, report."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators.corpus import (
    add_averages,
    collect_documents,
    corpus_totals,
    extract_stage,
    file_type_counts,
)
from corpuscope.operators.reports import stage_report
from corpuscope.operators.rules import Rules, apply_rules
from corpuscope.sources.files import read_text_files
from corpuscope.sources.sinks import replacing, write_json, write_text

#: The column that carries a record's file through the stages.
SOURCE = "_path"

_FOLDERS = ("extracted", "transformed", "totals", "file_types", "data", "report")


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def corpus_totals_of(files: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Totals and averages of a corpus in one pass, without stage output."""
    records = apply_rules(extract_stage(files), rules or {})
    return add_averages(corpus_totals(records))


def run_corpus_job(
    spark: SparkSession, input_path: str, output_path: str, rules: Rules | None = None, run_ts: str | None = None
) -> DataFrame:
    """Run all stages and return the aggregate row.

    Output below ``output_path``, in place of that of an earlier run once all of it is written (a run that
    breaks leaves the old output as it was): ``extracted`` and
    ``transformed`` as Parquet with the source file's ``_path``; ``totals``,
    ``file_types`` and ``data`` (all records in order of path) as JSON lines; ``report``
    as text. Rules that give a record no member make it ``{}``. The texts are read once; the later stages start from the
    stage tables, so a lost executor costs no second pass over them. A missing
    input folder stops the job before anything is written.
    """
    started = run_ts or _now()
    with replacing(spark, output_path, _FOLDERS) as folder:
        files = read_text_files(spark, input_path).withColumnRenamed("path", SOURCE)
        extract_stage(files, run_ts, keep=(SOURCE,)).write.parquet(f"{folder}/extracted")
        extracted = spark.read.parquet(f"{folder}/extracted")

        apply_rules(extracted, rules or {}, keep=(SOURCE,)).write.parquet(f"{folder}/transformed")
        transformed = spark.read.parquet(f"{folder}/transformed")

        totals = add_averages(corpus_totals(transformed))
        write_json(totals, f"{folder}/totals")
        write_json(file_type_counts(transformed), f"{folder}/file_types")
        data = collect_documents(transformed, (SOURCE,)).drop(SOURCE)
        if data.columns:
            write_json(data, f"{folder}/data")
        else:
            write_text(data.select(F.lit("{}").alias("record")), f"{folder}/data", "record")

        aggregate = spark.read.schema(totals.schema).json(f"{folder}/totals")
        report = _report(spark, extracted, transformed, aggregate, output_path, started, run_ts or _now())
        write_text(report, f"{folder}/report", "line", ["run", "part", "seq", "line_no"])
    return spark.read.schema(totals.schema).json(f"{output_path}/totals")


def _report(
    spark: SparkSession,
    extracted: DataFrame,
    transformed: DataFrame,
    aggregate: DataFrame,
    output_path: str,
    started: str,
    ended: str,
) -> DataFrame:
    """Stage report with the counts of each stage; the records themselves are in the stage tables."""

    def stage(seq: int, title: str, rows: DataFrame, folder: str, **counts: str) -> DataFrame:
        result = F.struct(
            F.lit(f"{output_path}/{folder}").alias("outputDir"),
            *(
                (F.col(counts[name]) if name in counts else F.lit(None)).cast("bigint").alias(name)
                for name in ("filesProcessed", "totalFiles", "totalSize")
            ),
        )
        return rows.select(
            F.lit(0).alias("run"), F.lit(seq).alias("seq"), F.lit(title).alias("stage"), result.alias("result")
        )

    def count(df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("files"))

    stages = (
        stage(0, "extract", count(extracted), "extracted", filesProcessed="files")
        .unionByName(stage(1, "transform", count(transformed), "transformed", filesProcessed="files"))
        .unionByName(stage(2, "aggregate", aggregate, "totals", totalFiles="totalFiles", totalSize="totalSize"))
    )
    times = {"run": F.lit(0), "startTime": F.lit(started), "endTime": F.lit(ended)}
    runs = spark.range(1).select(*(value.alias(name) for name, value in times.items()))
    return stage_report(runs, stages)
