"""The JSON files that queries write for themselves, on tables of many tasks."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuscope.plans import ORACLES, QUERIES
from tests.conftest import DATA
from tests.test_queries import canonical


@pytest.mark.parametrize("name", ["read_json_files", "read_json_members", "report_members"])
def test_json_folders_hold_one_file(spark, tmp_path, name):
    """Larger tables: no join is planned as a broadcast, and then becomes one by the sizes that are measured."""
    con = duckdb.connect()
    for source, key, step in (("documents", "doc_id", 1), ("events", "event_id", 10)):  # several files of each
        given = spark.read.parquet(f"{DATA}/{source}.parquet").withColumn(key, F.col(key) * step)
        given.repartition(6).write.parquet(f"{tmp_path}/{source}.parquet")
        con.execute(f"CREATE VIEW {source} AS SELECT * FROM '{tmp_path}/{source}.parquet/*.parquet'")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "4KB",
        # a side that fills few partitions would not be broadcast
        "spark.sql.shuffle.partitions": "4",
        # small partitions stay apart, as large ones do
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1b",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        result = QUERIES[name](spark, str(tmp_path))
        got = canonical(result.columns, result.collect())
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    cursor = con.execute(ORACLES[name])
    assert got == canonical([d[0] for d in cursor.description], cursor.fetchall())


def test_documents_without_a_language_have_an_array(spark, tmp_path):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 20")
    documents.withColumn("lang", F.when(F.col("doc_id") >= 6, F.col("lang"))).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["read_json_files"](spark, str(tmp_path)).where("lang IS NULL").collect()
    assert [(r.part, r.n) for r in rows] == [(0, 6)]
