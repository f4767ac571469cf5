import json
import random

from pyspark.sql import functions as F

from corpuscope.operators import probes, records, reports


def test_envelope_round_trip(spark):
    df = spark.sql(
        """SELECT 1 AS i, named_struct('n', 1, 's', 'x') AS data,
        named_struct('operation', 'op', 'path', CAST(NULL AS STRING)) AS metadata, 'went wrong' AS message"""
    )
    text = records.to_envelope(df, "data", "metadata").first().envelope
    assert json.loads(text) == {"text": '{\n  "n": 1,\n  "s": "x"\n}', "success": True,
                                "metadata": {"operation": "op", "path": None}}
    plain = records.to_envelope(df, "data", "metadata", with_success=False).first().envelope
    assert "success" not in json.loads(plain)
    failed = records.to_error_envelope(df, "message").first().envelope
    assert json.loads(failed) == {"text": "went wrong", "success": False, "metadata": {"error": "went wrong"}}
    other = records.to_error_envelope(df, "message", with_success=False).first().envelope
    assert json.loads(other) == {"text": "went wrong", "metadata": {"success": False, "error": "went wrong"}}


def test_read_envelope_and_counts(spark):
    rows = [
        '{"text":"a","success":true,"metadata":{"operation":"x","success":false}}',
        '{"text":"a","metadata":{"operation":"x","success":false,"exitCode":2,"stderr":["e"]}}',
        '{"text":"a","metadata":{"operation":"x"}}',
        '{"error":"boom"}',
        "broken",
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, envelope string")
    read = records.read_envelope(df)
    got = read.orderBy("i").collect()
    assert [(r.success, r.operation, r.exitCode, r.stderr, r.error) for r in got] == [
        (True, "x", None, None, None), (False, "x", 2, ["e"], None), (None, "x", None, None, None),
        (False, None, None, None, "boom"), (None, None, None, None, None),
    ]
    joined = '{"text":"t","metadata":{"operation":"c","stdout":"a\\nb","stderr":"","success":true}}'
    row = records.read_envelope(spark.createDataFrame([(joined,)], "envelope string")).first()
    assert (row.operation, row.stdout, row.stderr) == ("c", ["a", "b"], [])
    documented = spark.createDataFrame([('{"error":true,"message":"no file","code":"FILE_NOT_FOUND"}',)], "envelope string")
    row = records.read_envelope(documented).first()
    assert (row.success, row.code, row.error) == (False, "FILE_NOT_FOUND", "no file")
    counts = {r.operation: (r.total, r.succeeded, r.failed) for r in records.result_counts(read).collect()}
    assert counts == {"x": (3, 1, 1), None: (2, 0, 1)}


def test_output_text(spark):
    df = spark.createDataFrame(
        [(0, ["a", "b"], ["e"]), (1, [], []), (2, None, None), (3, ["a"], [])], "i int, o array<string>, e array<string>"
    )
    text = records.output_text(F.lit("done"), F.col("o"), F.col("e"))
    assert [r.t for r in df.select("i", text.alias("t")).orderBy("i").collect()] == [
        "done\na\nb\nErrors and Warnings:\ne", "done\n", "done\n", "done\na",
    ]


def test_logs(spark):
    df = spark.createDataFrame([("debug",), ("INFO",), ("warning",), ("error",), ("error",), ("odd",)], "level string")
    assert {r.level: (r.records, r["rank"]) for r in records.log_counts(df).collect()} == {
        "debug": (1, 0), "info": (1, 1), "warning": (1, 2), "error": (2, 3), "odd": (1, None),
    }
    assert sorted(r.level for r in records.log_filter(df, "warning").collect()) == ["error", "error", "warning"]


def test_sections_across_blocks(spark):
    rng = random.Random(3)
    lines, expected = [], {}
    for run in ("a", "b", "c"):
        title = None
        for n in range(200):
            text = f"=== T{n} ===" if rng.random() < 0.03 and run != "c" else f"line {n}"
            title = text[4:-4] if text.startswith("===") else title
            lines.append((run, n, text))
            expected[run, n] = title
    rng.shuffle(lines)
    df = spark.createDataFrame(lines, "run string, line_no int, text string").repartition(5)
    for block in (1, 7, 64, 10_000):
        got = probes.probe_sections(df, block_lines=block).collect()
        assert {(r.run, r.line_no): r.section for r in got} == expected
        assert len(got) == len(lines)


def test_capabilities(spark):
    text = [
        ("h1", 1, "-O3 optimization not available"),
        ("h1", 2, "-O3 optimization supported"),
        ("h1", 3, "LTO not supported or failed"),
        ("h1", 4, "ASLR compatible"),
        ("h1", 5, "Stack protector not available"),
        ("h2", 1, "-fPIC position independent code supported"),
        ("h2", 2, "Checking PIC support:"),
        ("h3", 1, "nothing"),
    ]
    df = spark.createDataFrame(text, "host string, line_no int, text string")
    rows = {r.host: r.asDict() for r in probes.probe_capabilities(df).collect()}
    assert set(rows) == {"h1", "h2"}
    said = {k: v for k, v in rows["h1"].items() if v is not None}
    assert said == {"host": "h1", "-O3": True, "LTO": False, "ASLR": True, "Stack protector": False}
    assert {k for k, v in rows["h2"].items() if v} == {"host", "-fPIC"}


def test_report(spark):
    text = '{"b":"x","a":{"z":1,"y":[1,"q",null],"o":{"k":1},"n":null},"l":[1.0,"s"],"n":null,"f":2.50}'
    df = spark.createDataFrame([(1, text), (2, "broken"), (3, "{}"), (4, "[5]")], "i int, t string")
    got = reports.report_lines(df, "i", "t", "TS").orderBy("i", "seq", "line_no").collect()
    rule = "=" * 40
    head = [rule, "Data Processing Report", rule, "Generated: TS", ""]
    assert [r.line for r in got if r.i == 1] == head + [
        'b: "x"', "", "a:", "  z: 1", "  y: 1,q,", "  o: [object Object]", "  n: null", 'l: [1,"s"]', "", "n:", "f: 2.5",
        "", rule,
    ]
    assert [r.line for r in got if r.i == 3] == head + ["", rule]
    assert {r.i for r in got} == {1, 3, 4}
    assert [r.line for r in got if r.i == 4] == head + ["0: 5", "", rule]
    sizes = {r.i: r["size"] for r in reports.report_sizes(reports.report_lines(df, "i", "t", "TS"), "i").collect()}
    assert sizes[3] == sum(len(line) + 1 for line in [*head, "", rule])
    printed = reports.report_lines(df, "i", "t", "TS", output="json").where("i = 3").first()
    assert printed.line == "{}"


def test_report_order_and_other_values(spark):
    texts = ['[1,{"a":2},null,[3]]', '{"b":1,"2":2,"1":{"y":1,"0":2},"b":4}', '"aé"', "7", "null", '{"k":[]} x']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = reports.report_lines(df, "i", "t", "TS").orderBy("i", "seq", "line_no").collect()
    lines = {i: [r.line for r in got if r.i == i][5:-2] for i in range(6)}
    assert lines == {
        0: ["0: 1", "", "1:", "  a: 2", "", "2:", "3: [3]"],
        1: ["", "1:", "  0: 2", "  y: 1", "2: 2", "b: 4"],
        2: ['0: "a"', '1: "é"'],
        3: [],
        4: [],
        5: [],
    }
    assert {r.i for r in got} == {0, 1, 2, 3, 4}


def test_stage_report(spark):
    runs = spark.createDataFrame([(1, "s", "e"), (2, "s", "e")], "run int, startTime string, endTime string")
    stages = spark.createDataFrame([(1, 1, "two", (5, None)), (1, 0, "one", (3, "x"))],
                                   "run int, seq int, stage string, result struct<n:int,m:string>")
    errors = spark.createDataFrame([(1, 0, "bad")], "run int, seq int, message string")
    got = reports.stage_report(runs, stages, errors).orderBy("run", "part", "seq", "line_no").collect()
    rule = "=" * 40
    head = [rule, "Pipeline Execution Report", rule, "Start Time: s", "End Time: e"]
    assert [r.line for r in got if r.run == 1] == head + [
        "Total Stages: 2", "", "--- Stage 1: one ---", "{", '  "n": 3,', '  "m": "x"', "}", "",
        "--- Stage 2: two ---", "{", '  "n": 5', "}", "", "--- Errors ---", "- bad", "", rule,
    ]
    assert [r.line for r in got if r.run == 2] == head + ["Total Stages: 0", "", rule]
