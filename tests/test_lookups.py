from pyspark.sql import functions as F

from corpuscope.operators import lookups as lk


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def manifest(spark):
    """A third of the rows on one path, some rows without a path, exact copies."""
    key = F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('p', id % 97) END")
    return spark.range(0, 3000, 1, 6).select((F.col("id") % 500).alias("n"), key.alias("path"))


def test_hot_key_keeps_all_rows(spark):
    left = manifest(spark)
    right = spark.createDataFrame([("hot", 1), *[(f"p{i}", i) for i in range(0, 97, 2)]], "path string, size int")
    joined = lk.lookup(left, lk.one_per_key(right, "path", F.max("size").alias("size")), "path")
    assert joined.count() == 3000
    assert joined.where("path = 'hot' AND size = 1").count() == 1000
    assert joined.where("path IS NULL AND _found").count() == 0


def test_hot_key_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        left = spark.range(0, 200000, 1, 8).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE uuid() END AS path")
        right = spark.range(200000).selectExpr("CASE WHEN id = 0 THEN 'hot' ELSE concat('p', id) END AS path")
        flags = lk.exists_flag(left, right)
        assert flags.where("exists").count() == 66667
        flags.collect()
        assert "skew=true" in flags._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_exists(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "n int, path string")
    files = spark.createDataFrame([("a",), ("a",), ("c",)], "path string")
    flags = lk.exists_flag(left, files).orderBy("n").collect()
    assert [(r.n, r.exists) for r in flags] == [(1, True), (2, False), (3, True), (4, False)]
    assert sorted(r.n for r in lk.existing(left, files).collect()) == [1, 3]
    sized = spark.createDataFrame([("a", 5), ("c", 6)], "path string, length int")
    detailed = lk.exists_flag(left, sized, details=("length",)).orderBy("n").collect()
    assert [(r.exists, r.length) for r in detailed] == [(True, 5), (False, None), (True, 5), (False, None)]
    assert sorted(r.n for r in lk.missing(left, files).collect()) == [2, 4]


def test_prompts(spark):
    prompts = spark.createDataFrame(
        [("p", "Do {x}", "[]"), ("p", "Do {y}", "[]"), ("p", None, None), ("n", None, None)],
        "name string, template string, arguments string",
    )
    asked = spark.createDataFrame([(1, "p"), (2, "q"), (3, ""), (4, None), (5, "n")], "i int, promptName string")
    rows = lk.prompt_lookup(asked, prompts).orderBy("i").collect()
    assert [(r.message, r.error) for r in rows] == [
        ("p: Do {x}", None),
        (None, "Failed to get prompt q"),
        (None, "Prompt name requiered"),
        (None, "Prompt name requiered"),
        (None, "Failed to parse prompt n"),
    ]


def test_resources(spark):
    resources = spark.createDataFrame([("r", "file:///r", "text/plain"), ("n", None, None)], "name string, uri string, mimeType string")
    asked = spark.createDataFrame([(1, "r"), (2, "s"), (3, None), (4, "n")], "i int, resourceName string")
    rows = lk.resource_lookup(asked, resources).orderBy("i").collect()
    assert [r.name for r in rows] == ["r", "", "", ""]
    assert [(r.text, r.uri, r.mimeType, r.error) for r in rows] == [
        ("r: take a look following link:\nfile:///r", "file:///r", "text/plain", None),
        ("Failed to load resource: s", "", "plain/text", "Failed to load resource: s"),
        ("Failed to load resource: MCP resource name required", "", "plain/text",
         "Failed to load resource: MCP resource name required"),
        ("Failed to parse resource: n", "", "plain/text", "Failed to parse resource: n"),
    ]


def test_resolve_calls(spark):
    handlers = spark.createDataFrame([("a", "m1"), ("b", "m2")], "handler string, module string")
    cases = [
        ("a", "{}", "a", "m1", None),
        ("a", '{"testHandler":"b"}', "b", "m2", None),
        ("a", '{"testHandler":""}', "a", "m1", None),
        ("a", '{"testHandler":false}', "a", "m1", None),
        ("a", '{"testHandler":0}', "a", "m1", None),
        ("a", '{"testHandler":"0"}', "0", None, "Unknown handler: 0"),
        ("x", "[]", "x", None, "Unknown handler: x"),
        (None, "{}", None, None, "Unknown handler: undefined"),
        ("a", "{", None, None, "SyntaxError: not valid JSON"),
        ("a", None, None, None, "SyntaxError: not valid JSON"),
        ("a", "null", None, None, "SyntaxError: not valid JSON"),
    ]
    calls = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, handlerName string, params string")
    rows = lk.resolve_calls(calls, handlers).orderBy("i").collect()
    assert [(r.handler, r.module, r.error) for r in rows] == [c[2:] for c in cases]


def test_downloads(spark):
    asked = spark.createDataFrame(
        [("http://h/a.zip", None), ("http://h/", ""), ("http://h/a.zip", "/d/x")], "url string, destination string"
    )
    files = spark.createDataFrame([("/t/a.zip", 5), ("/d/x", 7)], "path string, size int")
    rows = lk.download_info(asked, files, "/t/").orderBy("path").collect()
    assert [(r.path, r["size"], r.exists) for r in rows] == [
        ("/d/x", 7, True), ("/t/a.zip", 5, True), ("/t/download.txt", 0, False),
    ]
    tried = asked.withColumn("downloaded", F.col("destination").isNull()).union(
        spark.createDataFrame([(None, "/d/x", True)], "url string, destination string, downloaded boolean")
    )
    rows = lk.download_info(tried, files, "/t").orderBy("path", "url").collect()
    assert [(r.path, r.error, r.success) for r in rows] == [
        ("/d/x", "URL is required", False), ("/d/x", "Failed to download file", False), ("/t/a.zip", None, True),
        ("/t/download.txt", "Failed to download file", False),
    ]


def test_last_wins_and_overlay(spark):
    lines = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("j", 1, None)], "key string, n int, value string")
    assert {r.key: r.value for r in lk.last_wins(lines, ["key"], "n", "value").collect()} == {"k": "c", "j": None}
    env = spark.createDataFrame([("A", "1"), ("B", "")], "key string, value string")
    parsed = spark.createDataFrame([("9", "A"), ("2", "C")], "value string, key string")
    merged = lk.env_overlay(env, parsed)
    assert {r.key: r.value for r in merged.collect()} == {"A": "1", "B": "", "C": "2"}
