"""Streams in batches against the batch operators, and tables that are dealt once."""

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import corpus
from corpuscope.operators.lookups import env_overlay, last_wins
from corpuscope.sources.dealt import Lookups, deal, dealt_rows, drop_dealt
from corpuscope.streaming.batches import batch_path, finished_batches
from corpuscope.streaming.settings import current_overlay, current_settings, stream_last_wins
from corpuscope.streaming.totals import add_batch, current_totals, current_types, stream_corpus_totals

RECORDS = "filename string, size bigint, lines bigint, wordCount bigint"
ROWS = "key string, at bigint, value string"


def rows(df):
    return sorted(map(repr, df.collect()))


def arrive(spark, data, schema, path, number):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def record_parts():
    made = [(f"f{i}.{'txt' if i % 3 else 'json'}", i * 7, i, i if i % 3 else None) for i in range(30)]
    return [made[:10], made[10:11], made[11:], [(None, 0, 0, None), ("", 1, 1, 0)]]


def test_totals_of_a_stream_equal_the_batch(spark, tmp_path):
    path = str(tmp_path)
    parts = record_parts()
    for number, part in enumerate(parts):
        stream = arrive(spark, part, RECORDS, path, number)
        if number % 2:  # two files wait, then one run takes them one by one
            stream_corpus_totals(stream, f"{path}/out").awaitTermination(120)
    whole = spark.createDataFrame([row for part in parts for row in part], RECORDS)
    assert rows(current_totals(spark, f"{path}/out")) == rows(corpus.add_averages(corpus.corpus_totals(whole)))
    assert rows(current_types(spark, f"{path}/out")) == rows(corpus.file_type_counts(whole))
    assert len(finished_batches(spark, f"{path}/out", "types/_SUCCESS")) == 2


def test_a_batch_run_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path)
    parts = [spark.createDataFrame(part, RECORDS) for part in record_parts()[:3]]
    for number, part in enumerate(parts):
        add_batch(part, number, path)
        add_batch(part, number, path)
    whole = parts[0].union(parts[1]).union(parts[2])
    assert current_totals(spark, path).first().totalFiles == whole.count()


def test_a_batch_that_broke_off_is_made_anew(spark, tmp_path):
    path = str(tmp_path)
    first, second = (spark.createDataFrame(part, RECORDS) for part in record_parts()[:2])
    add_batch(first, 0, path)
    # the second one wrote its totals, then its driver was lost
    spark.createDataFrame([(99, 99, 99, 99)], "a bigint, b bigint, c bigint, d bigint").write.parquet(
        f"{batch_path(path, 1)}/totals"
    )
    assert current_totals(spark, path).first().totalFiles == 10
    add_batch(second, 1, path)
    assert current_totals(spark, path).first().totalFiles == 11


def test_no_batch_yet(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        current_totals(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        current_settings(spark, str(tmp_path), ["key"], "value")


PARTS = [
    [("a", 5, "five"), ("b", 1, "one"), ("a", 9, None), (None, 1, "nameless")],
    [("a", 7, "late"), ("b", 1, "two"), ("c", None, "no place"), ("d", 3, "")],
    [("b", 1, "one"), ("a", 9, "nine"), ("hot", 1, "x"), ("c", None, None)] + [("hot", i, str(i)) for i in range(200)],
]


def test_last_assignment_of_a_stream_equals_the_batch(spark, tmp_path):
    path = str(tmp_path)
    for number, part in enumerate(PARTS):
        stream = arrive(spark, part, ROWS, path, number)
        if number:  # two batches in the first run, one more after a restart
            stream_last_wins(stream, ["key"], "at", "value", f"{path}/out", salts=2).awaitTermination(300)
    whole = spark.createDataFrame([row for part in PARTS for row in part], ROWS)
    got = current_settings(spark, f"{path}/out", ["key"], "value")
    assert rows(got) == rows(last_wins(whole, ["key"], "at", "value"))
    assert {r.key: r.value for r in got.collect()} == {
        "a": "nine", "b": "two", "c": None, "d": "", "hot": "199", None: "nameless"
    }
    assert finished_batches(spark, f"{path}/out") == [0, 1, 2]
    # a stale assignment is not put out
    late = spark.read.parquet(batch_path(f"{path}/out", 1)).where("key = 'a' AND _order = 7")
    first = spark.read.parquet(batch_path(f"{path}/out", 0)).where("key = 'a'")
    assert late.count() + first.count() <= 3
    env = spark.createDataFrame([("a", "mine"), ("z", "other")], "key string, value string")
    assert rows(current_overlay(env, f"{path}/out")) == rows(env_overlay(env, last_wins(whole, ["key"], "at", "value")))


def test_a_batch_keeps_one_row_for_each_of_its_keys(spark, tmp_path):
    path = str(tmp_path)
    stream = arrive(spark, [(f"k{i % 5}", i, str(i)) for i in range(500)], ROWS, path, 0)
    query = stream_last_wins(stream, ["key"], "at", "value", f"{path}/out")
    query.awaitTermination(300)
    assert spark.read.parquet(batch_path(f"{path}/out", 0)).count() == 5
    # no store is opened, whose cost would grow with partitions and batches
    assert query.lastProgress is not None and not query.lastProgress.stateOperators


def test_ties_of_the_order_go_to_the_greatest_value(spark):
    for data in ([("k", 1, "a"), ("k", 1, "b")], [("k", 1, "b"), ("k", 1, "a")]):
        assert last_wins(spark.createDataFrame(data, ROWS), ["key"], "at", "value").first().value == "b"


def test_lookups_leave_a_dealt_table_where_it_is(spark, tmp_path):
    asked = [(i, "hot" if i % 3 == 0 else f"k{i % 17}") for i in range(300)] + [(1000, None), (0, "hot")]
    table = spark.createDataFrame(asked, "id int, name string")
    dealt = deal(table, "name", str(tmp_path / "dealt"), 4, salts=3)
    catalog = spark.createDataFrame([("hot", 1), ("hot", 5), ("k3", 2), (None, 8)], "name string, size int")
    names = spark.createDataFrame([("k4",), ("k3",)], "name string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(dealt_rows(spark, dealt).select("id", "name")) == rows(table)
        found = Lookups(spark, dealt).add(catalog, "sized", F.max("size").alias("size")).add(names, "named").result()
        sizes = {"hot": 5, "k3": 2}
        want = [(i, n, n in sizes, sizes.get(n), n in ("k3", "k4")) for i, n in asked]
        got = [tuple(r) for r in found.select("id", "name", "sized", "size", "named").collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        plan = found._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
        # both joins and the table's scan stand above the first exchange, which is the catalog's
        first = next(i for i, line in enumerate(lines) if "Exchange" in line)
        assert scan < first and sum("SortMergeJoin" in line for line in lines[:scan]) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        drop_dealt(spark, dealt)
