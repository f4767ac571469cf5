"""Versions of an output: each is written to a folder of its own, and a committed row tells which one holds.

A run that breaks leaves a folder that no row names; readers never see it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corpuscope.sources.sinks import _at, _files, remove

_SCHEMA = "seq bigint, folder string, recipe string"


class Conflict(RuntimeError):
    """Another run has committed since this one began."""


def _log(path: str) -> str:
    return f"{path.rstrip('/')}/_versions"


def _rows(spark: SparkSession, path: str) -> DataFrame:
    log = _log(path)
    if not _files(spark, log).exists(_at(spark, log)):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).json(log)


def current_version(spark: SparkSession, path: str) -> Row | None:
    """seq, folder and recipe of the version that holds, None if there is none.

    Of two that were committed with one number the one of the lesser folder name holds.
    """
    latest = _rows(spark, path).agg(F.max(F.col("seq")).alias("seq"))
    same = _rows(spark, path).join(latest, "seq").groupBy("seq").agg(F.min(F.struct("folder", "recipe")).alias("v"))
    return same.select("seq", "v.*").first()


def new_folder() -> str:
    """The name of a version's folder."""
    return f"run-{uuid.uuid4().hex}"


def commit_version(spark: SparkSession, path: str, folder: str, after: Row | None, recipe: str = "") -> None:
    """Make a folder the version that holds: one row is added, by Spark's own commit of a job.

    ``after`` is what :func:`current_version` said when the run began; raises :class:`Conflict` if another run
    was faster.
    """
    now = current_version(spark, path)
    if (now and now.seq) != (after and after.seq):
        raise Conflict(path)
    seq = (after.seq if after else 0) + 1
    spark.createDataFrame([(seq, folder, recipe)], _SCHEMA).coalesce(1).write.mode("append").json(_log(path))
    if current_version(spark, path).folder != folder:
        raise Conflict(path)


def drop_folders(spark: SparkSession, path: str, used: set[str]) -> list[str]:
    """Remove the folders of versions that are not in use, those of broken runs too; returns their names."""
    path = path.rstrip("/")
    found = [s.getPath().getName() for s in _files(spark, path).listStatus(_at(spark, path)) if s.isDirectory()]
    unused = sorted(name for name in found if name.startswith("run-") and name not in used)
    for name in unused:
        remove(spark, f"{path}/{name}")
    return unused
