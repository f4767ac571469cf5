"""Contiguous shards of nearly equal bytes, cut from a global prefix sum of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.registry import query, table
from corpuscope.llm.running import running_totals

#: Bytes that a document takes besides its text.
OVERHEAD = 16


def byte_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents, in ascending id, into ``shards`` contiguous shards of nearly equal bytes.

    A document's size is the UTF-8 length of its text plus 16; a null text has length
    0. Ranges of the id order are summed, the sums give each range its start, and a
    document goes to the shard in which the middle of its bytes lies, so a shard is off
    the equal share by less than the largest document. Only ids, sizes and checksums
    are shuffled. Documents with a null id come first; repeated rows are documents of
    their own. Other columns of ``docs`` are left aside. An empty table gives an empty
    result. One document larger than a share leaves some shard empty.

    Columns: the id, ``size``, ``text_crc32``, ``shard`` from 0, ``slot`` (place in the
    shard from 0, without gaps).
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = running_totals(sizes, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], ["size"])
    total = placed.agg(F.max(F.col("before_size") + F.col("size"))).scalar()
    middle = (F.col("before_size") * 2 + F.col("size")) * shards
    cut = placed.withColumn("shard", F.least(F.floor(middle / (total * 2)), F.lit(shards - 1)).cast("int"))
    starts = cut.groupBy("shard").agg(F.min("row_index").alias("_start"))  # one row per shard
    return cut.join(F.broadcast(starts), "shard").select(
        F.col("doc_id").alias(id_col),
        "size",
        "text_crc32",
        "shard",
        (F.col("row_index") - F.col("_start")).cast("long").alias("slot"),
    )


@query("op4_byte_shards")
def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 contiguous shards of nearly equal bytes."""
    return byte_shards(table(spark, sf_dir, "documents"), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
