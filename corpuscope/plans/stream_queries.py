"""Queries over tables that arrive as streams, and over tables that are dealt once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators.corpus import extract_stage
from corpuscope.plans.bases import RECORDS_SQL, corpus_files
from corpuscope.plans.registry import query, table
from corpuscope.session import scratch_path, shuffle_partitions
from corpuscope.sources.dealt import Lookups, deal
from corpuscope.streaming.settings import current_overlay, current_settings, stream_last_wins
from corpuscope.streaming.totals import current_totals, stream_corpus_totals

RUN_TS = "2024-01-01T00:00:00Z"
#: Batches that a table arrives in.
BATCHES = 3


def _arriving(df: DataFrame, name: str) -> DataFrame:
    """A table as a stream of files, in three batches."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(BATCHES))).write.partitionBy("_part").parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // BATCHES))
    return reader.parquet(f"{path}/*")


@query(
    "stream_totals",
    f"""WITH {RECORDS_SQL} SELECT CAST(count(*) AS BIGINT) AS "totalFiles", CAST(sum(size) AS BIGINT) AS "totalSize",
        CAST(sum(lines) AS BIGINT) AS "totalLines", CAST(sum(coalesce(wordCount, 0)) AS BIGINT) AS "totalWords",
        CAST(floor(sum(size) / count(*) + 0.5) AS BIGINT) AS "averageSize",
        CAST(floor(sum(lines) / count(*) + 0.5) AS BIGINT) AS "averageLines",
        CAST(floor(sum(coalesce(wordCount, 0)) / count(*) + 0.5) AS BIGINT) AS "averageWords" FROM records""",
)
def totals_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all files, which arrive in batches."""
    files = _arriving(corpus_files(spark, sf_dir).select("filename", "content"), "arriving_files")
    path = scratch_path(spark, "stream_totals")
    stream_corpus_totals(extract_stage(files, RUN_TS), path).awaitTermination()
    return current_totals(spark, path)


@query(
    "stream_last_wins",
    "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
)
def last_values_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value per user and type of event, from events that arrive in batches and in no order."""
    keys, path = ["user_id", "event_type"], scratch_path(spark, "stream_last_wins")
    events = table(spark, sf_dir, "events").select(*keys, "event_id", "value")
    stream_last_wins(_arriving(events, "arriving_events"), keys, "event_id", "value", path).awaitTermination()
    return current_settings(spark, path, keys, "value")


@query(
    "stream_overlay",
    """WITH env AS (SELECT concat('KEY_', user_id) AS key, arg_max(value, event_id) AS value FROM events
        WHERE event_id % 3 = 0 GROUP BY 1),
    parsed AS (SELECT concat('KEY_', user_id) AS key, arg_max(value, event_id) AS value FROM events
        WHERE event_id % 3 <> 0 GROUP BY 1)
    SELECT * FROM env UNION ALL SELECT * FROM parsed WHERE key NOT IN (SELECT key FROM env)""",
)
def overlay_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings arrive in batches over an environment that is there."""
    events = table(spark, sf_dir, "events").select(F.expr("concat('KEY_', user_id)").alias("key"), "event_id", "value")
    env = events.where("event_id % 3 = 0").groupBy("key").agg(F.max_by("value", "event_id").alias("value"))
    path = scratch_path(spark, "stream_overlay")
    parsed = _arriving(events.where("event_id % 3 <> 0"), "arriving_settings")
    stream_last_wins(parsed, ["key"], "event_id", "value", path).awaitTermination()
    return current_overlay(env, path)


_HOT = "CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END"


@query(
    "dealt_lookups",
    f"""WITH asked AS (SELECT event_id, {_HOT} AS id FROM events),
    buyers AS (SELECT o_custkey AS id, CAST(count(*) AS BIGINT) AS orders FROM orders GROUP BY 1)
    SELECT event_id, id, id IN (SELECT c_custkey FROM customer) AS is_customer, buyers.id IS NOT NULL AS is_buyer,
        orders FROM asked LEFT JOIN buyers USING (id)""",
)
def lookups_of_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are dealt once, then looked up in two catalogs; a third of all ask for one key."""
    asked = table(spark, sf_dir, "events").select("event_id", F.expr(_HOT).cast("long").alias("id"))
    dealt = deal(asked, "id", scratch_path(spark, "dealt_events"), shuffle_partitions(spark))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("id"))
    found = Lookups(spark, dealt).add(customers, "is_customer").add(buyers, "is_buyer", F.count("*").alias("orders"))
    return found.result()
