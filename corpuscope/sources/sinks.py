"""Writers. Output is a folder with one file per task; an earlier run's output is replaced.

New output is written beside the old one, which gives way only when all of it is there: a run that breaks
leaves the old output as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _at(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, if there is one."""
    _files(spark, path).delete(_at(spark, path), True)


def _old(path: str) -> str:
    parent, _, name = path.rpartition("/")
    return f"{parent}/_old-{name}" if parent else f"_old-{name}"


def recover(spark: SparkSession, path: str) -> None:
    """Bring back a folder whose replacement was broken off between its two renames."""
    files, old = _files(spark, path), _at(spark, _old(path))
    if not files.exists(_at(spark, path)) and files.exists(old):
        files.rename(old, _at(spark, path))


def switch(spark: SparkSession, written: str, path: str) -> None:
    """Put a written folder in the place of another: two renames, then the old one is removed."""
    files, old = _files(spark, path), _at(spark, _old(path))
    recover(spark, path)
    if files.exists(_at(spark, path)):
        files.delete(old, True)
        if not files.rename(_at(spark, path), old):
            raise OSError(f"cannot move {path}")
    files.mkdirs(_at(spark, path).getParent())
    if not files.rename(_at(spark, written), _at(spark, path)):
        files.rename(old, _at(spark, path))
        raise OSError(f"cannot move {written}")
    files.delete(old, True)


@contextmanager
def replacing(spark: SparkSession, path: str, names: tuple[str, ...] = ()) -> Iterator[str]:
    """A folder to write to, which takes the place of ``path`` when the block is left without an error.

    With ``names`` only these folders below ``path`` are replaced. After an error what was written is removed and
    ``path`` is as it was. Spark's readers pass over the folder while it is written.
    """
    path = path.rstrip("/")
    parent, _, name = path.rpartition("/")
    mark = f"_next-{uuid.uuid4().hex}"
    beside = f"{path}/{mark}" if names else (f"{parent}/{mark}-{name}" if parent else f"{mark}-{name}")
    try:
        yield beside
        for inner in names:
            switch(spark, f"{beside}/{inner}", f"{path}/{inner}")
        if not names:
            switch(spark, beside, path)
    finally:
        remove(spark, beside)


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None, keep_nulls: bool = False) -> None:
    """One JSON object per line; NULL members are left out, or written as null."""
    with replacing(df.sparkSession, path) as beside:
        writer = df.write.partitionBy(*(partition_by or []))
        writer.option("ignoreNullFields", str(not keep_nulls).lower()).json(beside)


def write_text(df: DataFrame, path: str, column: str = "line", order_by: list[str] | None = None) -> None:
    """One line per row. With ``order_by`` the files in name order read in that order."""
    rows = df.orderBy(*order_by) if order_by else df
    with replacing(df.sparkSession, path) as beside:
        rows.select(F.col(column).cast("string")).write.text(beside)
