"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    # a repeated member name keeps its last value, as JSON.parse does
    "spark.sql.variant.allowDuplicateKeys": "true",
    # hot join keys are split by measured partition size, small sides are
    # broadcast by measured size, small shuffle partitions are merged
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators count on."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


#: Scratch paths that were given out and not removed.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, from ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it then writes below its
    warehouse folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder.

    All scratch paths of an application lie in one folder, which the driver's JVM
    removes when it ends. A driver that is killed leaves the folder named after its
    application behind.
    """
    context = spark.sparkContext
    folder = f"{shared_dir(spark)}/corpuscope-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    unique = f"{folder}/{name}-{uuid.uuid4().hex}"
    _written.append(unique)
    return unique


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, a lost executor costs no more."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Kept:
    """The tables of a block of :func:`passing_tables` that stay."""

    def __init__(self) -> None:
        self.files: list[str] = []

    def __call__(self, *tables: DataFrame) -> None:
        """Keep what these tables read from the shared folder."""
        for table in tables:
            self.files.extend(table.inputFiles())


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Kept]:
    """Remove the scratch tables written within, but for those that are kept.

    For steps whose result is written: nothing that is read later may depend on the rest.
    """
    first, kept = len(_written), Kept()
    try:
        yield kept
    finally:
        folders = {part for file in kept.files for part in file.split("/")}
        for path in [p for p in _written[first:] if p.rsplit("/", 1)[1] not in folders]:
            _written.remove(path)
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
