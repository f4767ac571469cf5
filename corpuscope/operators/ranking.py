"""Global order as data: the place of every row, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.session import shuffle_partitions, stored


def ranked(df: DataFrame, order: list[str | Column], rank: str = "rank") -> DataFrame:
    """Add the place of each row (from 1) in the given order; rows that tie get neighbouring places.

    The rows are dealt into ranges of the order and written once, so a task that runs again sees the
    same ranges. A range is numbered by itself; how many rows lie ahead of it is known from
    the ranges' sizes, one number per shuffle partition, which is all that reaches the driver.
    """
    parts = shuffle_partitions(df.sparkSession)
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranked")
    sizes = {row["_range"]: row["count"] for row in dealt.groupBy("_range").count().collect()}
    ahead, starts = 0, []
    for number in range(parts):
        starts.append(ahead)
        ahead += sizes.get(number, 0)
    start = F.get(F.lit(starts), F.col("_range")).cast("bigint")
    here = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(rank, start + here).drop("_range")
