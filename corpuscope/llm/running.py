"""Running totals over a whole table, in any order, without gathering it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.session import shuffle_partitions, stored


def running_totals(df: DataFrame, order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """Add ``row_index`` and, for each value column, ``before_<value>``: the rows and the sum ahead of each row.

    The rows are dealt into ranges of the order and written once, so that a task that
    is run again sees the same ranges. The totals of the ranges, one row per range,
    give each range its start; a window within the range gives the rest. Nulls in the
    values count as 0. Rows that tie in ``order`` get some order among themselves.
    """
    parts = shuffle_partitions(df.sparkSession)
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"), *(F.sum(v).alias(f"_sum_{v}") for v in values)
    )
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_rows"),
        *(F.coalesce(F.sum(f"_sum_{v}").over(ahead), F.lit(0)).alias(f"_sum_{v}") for v in values),
    )
    within = W.partitionBy("_part").orderBy(*order)
    earlier = within.rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumns(
        {"_row": F.row_number().over(within) - 1}
        | {f"_here_{v}": F.coalesce(F.sum(v).over(earlier), F.lit(0)) for v in values}
    )
    # one row per range: the number of ranges bounds what is broadcast
    return local.join(F.broadcast(starts), "_part").select(
        *df.columns,
        (F.col("_rows") + F.col("_row")).alias("row_index"),
        *((F.col(f"_sum_{v}") + F.col(f"_here_{v}")).alias(f"before_{v}") for v in values),
    )
