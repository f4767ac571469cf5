import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpuscope import session
from corpuscope.functions.text import char_count, count_lines, count_words
from corpuscope.operators import corpus
from corpuscope.plans.corpus_job import run_corpus_job
from corpuscope.plans.corpus_queries import listing_order
from corpuscope.sources import config, files, records, sinks
from corpuscope.streaming.files import append_json, stream_text_files

FILES = {
    "good.json": '{"a": 1, "b": null}',
    "broken.json": '{"a": 1',
    "null.json": "null",
    "notes.txt": "one two\nthree\n",
    "Makefile": "all:\n\tcc",
    "a.tar.gz": "x",
    "empty.txt": "",
    "b c+d.txt": "blank in name",
}
TS = "2024-05-06T07:08:09.000Z"


@pytest.fixture
def folder(tmp_path):
    target = tmp_path / "in"
    target.mkdir()
    for name, content in FILES.items():
        (target / name).write_text(content)
    (target / "sub").mkdir()
    (target / "sub" / "deep.txt").write_text("deep")
    return str(target)


def test_scan(spark, folder):
    names = [r.name for r in files.scan_files(spark, folder, sort="name").collect()]
    assert names == sorted(n for n, c in FILES.items() if c)
    assert {r.name for r in files.scan_files(spark, folder, extensions=[".json"]).collect()} == {
        "good.json", "broken.json", "null.json",
    }
    some = files.scan_files(spark, folder, recursive=True, extensions=[".txt", ".gz"])
    assert {r.name for r in some.collect()} == {"notes.txt", "a.tar.gz", "b c+d.txt", "deep.txt"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_directory_summary(spark, folder):
    summary = corpus.directory_summary(files.scan_files(spark, folder, recursive=True)).collect()
    got = {os.path.basename(r.directory): (r.totalItems, r.totalSize) for r in summary}
    assert got == {"in": (7, sum(len(c) for c in FILES.values())), "sub": (1, 4)}


def test_read_text(spark, folder):
    read = {r.filename: (r.path, r.content) for r in files.read_text_files(spark, folder).collect()}
    assert {n: c for n, (_, c) in read.items()} == {n: c for n, c in FILES.items() if c}
    listed = {r.path for r in files.scan_files(spark, folder).collect()}
    assert {p for p, _ in read.values()} == listed


def test_missing_path_is_an_error(spark, folder):
    with pytest.raises(PySparkException):
        files.read_text_files(spark, folder + "/none").collect()


def test_read_json(spark, folder):
    parsed = files.read_json_files(spark, folder).select("filename", F.to_json("jsonData").alias("j"), "parseError")
    got = {r.filename: (r.j, r.parseError is not None) for r in parsed.collect()}
    assert got["good.json"] == ('{"a":1,"b":null}', False)
    assert got["null.json"] == ("null", False)
    assert got["broken.json"] == (None, True)
    assert got["notes.txt"] == (None, True)


def test_extract(spark, folder):
    got = {r.filename: r for r in corpus.extract_stage(files.read_text_files(spark, folder), TS).collect()}
    assert "empty.txt" not in got
    text = got["notes.txt"]
    assert (text["size"], text.lines, text.wordCount, text.preview) == (14, 3, 3, FILES["notes.txt"])
    assert text.jsonData is None and text.parseError is None
    assert text.extractedAt.isoformat() == "2024-05-06T07:08:09"
    good = got["good.json"]
    assert good.wordCount is None and good.preview is None and good.parseError is None
    assert good.jsonData.toPython() == {"a": 1, "b": None}
    assert got["broken.json"].parseError and got["broken.json"].jsonData is None
    assert got["null.json"].parseError is None


def test_single(spark, folder):
    got = {r.filename: r for r in corpus.extract_single(files.read_text_files(spark, folder)).collect()}
    assert got["good.json"].wordCount == 4


def test_preview(spark, folder):
    got = {os.path.basename(r.filePath): r for r in corpus.preview_files(files.read_text_files(spark, folder)).collect()}
    row = got["notes.txt"]
    assert (row.lineCount, row.wordCount, row.charCount, row.preview) == (3, 3, 14, FILES["notes.txt"])


def test_transform_stage(spark):
    rows = [("x.extracted.json", '{"a":1}'), ("y.json", "{"), ("z.txt", "{}"), ("e.json", ""), ("n.json", "null")]
    df = spark.createDataFrame(rows, "filename string, content string")
    got = {r.filename: r for r in corpus.transform_stage(df, {"b": {"source": "a"}}).collect()}
    assert set(got) == {"x.extracted.json", "y.json", "n.json"}
    assert (got["x.extracted.json"].status, got["x.extracted.json"].outputName, got["x.extracted.json"].result) == (
        "success", "x.transformed.json", '{"b":1}',
    )
    assert got["y.json"].status == "error" and got["n.json"].status == "error"
    plain = {r.filename: r.status for r in corpus.transform_stage(df, {}).collect()}
    assert plain["n.json"] == "success"
    outcomes = {r.status: r.files for r in corpus.transform_outcomes(corpus.transform_stage(df, {})).collect()}
    assert outcomes == {"success": 2, "error": 1}


def test_aggregates(spark):
    rows = [("a.txt", 3, 1, None), ("b.tar.gz", 4, 2, 5), ("Makefile", None, 1, 1), (None, 1, 1, 1), ("", 0, 0, 0)]
    df = spark.createDataFrame(rows, "filename string, size long, lines long, wordCount long")
    assert corpus.corpus_totals(df).first().asDict() == {
        "totalFiles": 5, "totalSize": 8, "totalLines": 5, "totalWords": 7,
    }
    assert corpus.corpus_averages(df).first().asDict() == {"averageSize": 2, "averageLines": 1, "averageWords": 1}
    assert {r.extension: r.files for r in corpus.file_type_counts(df).collect()} == {
        "txt": 1, "gz": 1, "Makefile": 1, "unknown": 2,
    }
    empty = df.limit(0)
    assert corpus.corpus_totals(empty).first().asDict() == {
        "totalFiles": 0, "totalSize": 0, "totalLines": 0, "totalWords": 0,
    }
    assert corpus.corpus_averages(empty).first().asDict() == {
        "averageSize": None, "averageLines": None, "averageWords": None,
    }
    bare = corpus.corpus_totals(df.select(F.lit(1).alias("x"))).first()
    assert (bare.totalFiles, bare.totalSize) == (5, 0)
    assert {r.extension: r.files for r in corpus.file_type_counts(df.select("size")).collect()} == {"unknown": 5}
    assert [r.filename for r in corpus.collect_documents(df.na.fill("~")).collect()][:2] == ["", "Makefile"]


def test_totals_of_changed_members(spark):
    df = spark.createDataFrame([(1.5, "7"), (2.0, "many")], "size double, lines string")
    total = corpus.corpus_totals(df).first()
    assert (total.totalSize, total.totalLines, total.totalWords) == (3.5, 7, 0)


def test_merge(spark):
    df = spark.createDataFrame([("a", "{}"), ("b", "{"), ("c", ""), ("d", None), ("e", "null")], "path string, content string")
    assert corpus.merge_summary(df).first().asDict() == {"sources": 5, "merged": 2, "tooLarge": 0}
    assert sorted((r.path, r.error) for r in corpus.merge_sources(df).collect()) == [("a", None), ("e", None)]


def test_sources_beyond_a_variant_are_kept(spark):
    df = spark.range(1).selectExpr("'big' AS path", "concat('[', repeat('1234567,', 18000000), '1]') AS content")
    assert corpus.merge_summary(df).first().asDict() == {"sources": 1, "merged": 0, "tooLarge": 1}
    row = corpus.merge_sources(df).first()
    assert (row.path, row.data, row.error) == ("big", None, "RangeError: JSON value too large")


def test_files_that_cannot_be_read(spark):
    rows = [("/d/a.txt", "one two\nx"), ("/d/b.txt", ""), ("/d/c.txt", None), ("", "x"), (None, None)]
    df = spark.createDataFrame(rows, "path string, content string")
    single = [(r.filename, r.wordCount, r.error) for r in corpus.extract_single(df, TS).collect()]
    assert single == [
        ("a.txt", 3, None), (None, None, "Failed to read file"), (None, None, "Input file not found: /d/c.txt"),
        (None, None, "Input file not found: "), (None, None, "Input file not found: undefined"),
    ]
    preview = [(r.filePath, r.lineCount, r.error) for r in corpus.preview_files(df, lines=1).collect()]
    assert preview == [
        ("/d/a.txt", 2, None), ("/d/b.txt", None, "Failed to read file: /d/b.txt"),
        ("/d/c.txt", None, "File not found: /d/c.txt"), ("", None, "filePath parameter is required"),
        (None, None, "filePath parameter is required"),
    ]


def test_files_are_listed_by_name_and_path(spark):
    df = spark.createDataFrame([("b", "/2/b", 1), ("a", "/9/a", 2), ("b", "/1/b", 3)], "filename string, path string, size int")
    assert [r["size"] for r in corpus.collect_documents(df.repartition(3)).collect()] == [2, 3, 1]


def test_large_text_files_in_several_tasks(spark, tmp_path):
    target = tmp_path / "text"
    target.mkdir()
    content = "".join(f"line {i} \u00e9 \U0001f600\n" for i in range(20000))
    (target / "big.txt").write_text(content)
    (target / "small.txt").write_text("a b\n\nc\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        stats = files.text_file_stats(spark, str(target))
        got = {os.path.basename(r.path): (r["size"], r.lines, r.wordCount) for r in stats.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    units = len(content.encode("utf-16-le")) // 2
    assert got == {"big.txt": (units, 20001, 80000), "small.txt": (7, 4, 3)}


def test_text_files_without_a_last_newline(spark, tmp_path):
    texts = {"open.txt": "a b\n\nc \u00e9 \U0001f600", "one.txt": "x", "shut.txt": "a\n", "blank.txt": "\n", "empty_end.txt": "a\n\n"}
    texts |= {"mark.txt": "\ufeffa b\nc", "mark_shut.txt": "\ufeffa b\nc\n", "big.txt": "line \u00e9\n" * 9000 + "end"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        stats = files.text_file_stats(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {os.path.basename(r.path): (r["size"], r.lines, r.wordCount) for r in stats}
    whole = files.read_text_files(spark, str(tmp_path)).select(
        "filename", char_count(F.col("content")), count_lines(F.col("content")), count_words(F.col("content"))
    )
    assert got == {name: tuple(rest) for name, *rest in whole.collect()}
    assert got["open.txt"] == (len(texts["open.txt"]) + 1, 3, 5) and got["one.txt"] == (1, 1, 1)


def test_order_of_a_listing_between_tasks(spark):
    def ordered(names):
        rows = [(f"/x/lang=en/{n}", n) for n in names]
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "path string, name string")
        return listing_order(df).first()

    assert ordered(["part-a", "part-b", "part-c", "part-d"]).asDict() == {"prefix": "part-", "folders": 1, "ordered": True}
    assert not ordered(["part-c", "part-d", "part-a", "part-b"]).ordered
    assert not ordered(["part-b", "part-a", "part-c", "part-d"]).ordered


def test_all_passed(spark):
    df = spark.createDataFrame([(1, True, None), (1, None, None), (2, True, False), (2, True, True)],
                               "run int, success boolean, exists boolean")
    got = {r.run: r.allPassed for r in corpus.all_passed(df, "run", ["success", "exists"]).collect()}
    assert got == {1: True, 2: False}


def test_job(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    total = run_corpus_job(spark, folder, out, run_ts=TS).first()
    texts = [c for c in FILES.values() if c]
    assert (total.totalFiles, total.totalSize) == (len(texts), sum(map(len, texts)))
    assert total.totalWords == sum(len(c.split()) for n, c in FILES.items() if not n.endswith(".json"))
    types = {r.extension: r.files for r in spark.read.json(f"{out}/file_types").collect()}
    assert types == {"json": 3, "txt": 2, "Makefile": 1, "gz": 1}
    data = [json.loads(r.value) for r in spark.read.text(f"{out}/data").collect()]
    by_name = {d["filename"]: d for d in data}
    assert by_name["good.json"]["jsonData"] == {"a": 1, "b": None}
    assert "wordCount" not in by_name["good.json"] and "jsonData" not in by_name["notes.txt"]
    parts = sorted(p for p in os.listdir(f"{out}/report") if p.endswith(".txt"))
    report = "".join(open(f"{out}/report/{p}").read() for p in parts).split("\n")
    assert report[1] == "Pipeline Execution Report"
    assert report[3:6] == [f"Start Time: {TS}", f"End Time: {TS}", "Total Stages: 3"]
    assert [line for line in report if line.startswith("--- ")] == [
        "--- Stage 1: extract ---", "--- Stage 2: transform ---", "--- Stage 3: aggregate ---",
    ]
    assert f'  "totalFiles": {len(texts)},' in report


def test_job_with_rules(spark, folder, tmp_path):
    out = str(tmp_path / "ruled")
    rules = {"filename": {"source": "filename", "transform": "uppercase"}, "size": {"source": "size"}}
    total = run_corpus_job(spark, folder, out, rules, TS).first()
    assert total.totalSize > 0 and total.totalLines == 0
    assert {r.extension for r in spark.read.json(f"{out}/file_types").collect()} == {"JSON", "TXT", "MAKEFILE", "GZ"}


def test_job_replaces_what_an_earlier_run_left(spark, folder, tmp_path):
    out = str(tmp_path / "again")
    run_corpus_job(spark, folder, out, run_ts=TS)
    rules = {"name": {"source": "filename", "transform": "uppercase"}, "kilo": {"source": "size", "transform": "multiply", "factor": 2},
             "note": {"source": "none", "default": "-"}}
    total = run_corpus_job(spark, folder, out, rules, TS).first()
    data = [json.loads(r.value) for r in spark.read.text(f"{out}/data").collect()]
    names = sorted((n for n, c in FILES.items() if c))
    assert [d["name"] for d in data] == [n.upper() for n in names]
    assert [d["kilo"] for d in data] == [2.0 * len(FILES[n]) for n in names] and {d["note"] for d in data} == {"-"}
    assert (total.totalFiles, total.totalSize) == (len(names), 0)


def test_job_of_rules_that_yield_nothing(spark, folder, tmp_path):
    out = str(tmp_path / "nothing")
    total = run_corpus_job(spark, folder, out, {"x": {"source": "none"}}, TS).first()
    assert (total.totalFiles, total.totalSize, total.totalWords) == (sum(bool(c) for c in FILES.values()), 0, 0)
    assert {r.value for r in spark.read.text(f"{out}/data").collect()} == {"{}"}


def test_job_stops_without_input(spark, tmp_path):
    with pytest.raises(PySparkException):
        run_corpus_job(spark, str(tmp_path / "none"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_config(spark, tmp_path):
    lines = ["# c", "", " A = 1 ", "=x", "none", "B='q'", 'C="m\'', "D=", 'E="', "A=2", "F = a = b", "\u00a0G\u00a0=\u00a0h"]
    (tmp_path / ".env").write_text("\n".join(lines))
    (tmp_path / "x.env").write_text("\n".join(lines))
    got = {r.key: r.value for r in config.read_config_lines(spark, str(tmp_path / "x.env")).collect()}
    assert got == {"A": "2", "B": "q", "C": "\"m'", "D": "", "E": '"', "F": "a = b", "G": "h"}


def test_records(spark, tmp_path):
    response = '{"url":"u","statusCode":200,"statusText":"OK","headers":{"A":"b"},"body":"x"}'
    call = '{"name":"n","toolType":"t","execHandler":"h","sessionId":"s","pluginName":"p","arguments":{"path":"/x"},"execMethod":"m"}'
    message = '{"jsonrpc":"2.0","id":"1","method":"tools/call","params":{"a":1}}'
    path = str(tmp_path / "lines")
    sinks.write_text(spark.createDataFrame([(response,)], "line string"), path)
    got = records.read_responses(spark.read.text(path)).first()
    assert got.asDict() == {"url": "u", "status_code": 200, "status_text": "OK", "headers": {"A": "b"}, "body": "x", "error": None}
    row = records.read_calls(spark.createDataFrame([(call,)], "value string")).first()
    assert (row.execHandler, row.arguments.toPython()) == ("h", {"path": "/x"})
    row = records.read_messages(spark.createDataFrame([(message,)], "value string")).first()
    assert (row.method, row.params.toPython(), row.result) == ("tools/call", {"a": 1}, None)


def test_catalog(spark, tmp_path):
    path = str(tmp_path / "prompts")
    sinks.write_text(spark.createDataFrame([('{"name":"p","template":"T","arguments":[{"name":"x"}]}',)], "line string"), path)
    assert records.read_catalog(spark, path, "prompt").first().asDict() == {
        "name": "p", "template": "T", "arguments": '[{"name":"x"}]',
    }


def test_writers(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(2, "b", None), (1, "a", "x")], "n int, line string, o string").repartition(2)
    sinks.write_text(df, path, order_by=["n"])
    parts = sorted(p for p in os.listdir(path) if p.endswith(".txt"))
    assert "".join(open(f"{path}/{p}").read() for p in parts) == "a\nb\n"
    sinks.write_json(df, path)
    assert {json.dumps(json.loads(r.value)) for r in spark.read.text(path).collect()} == {
        '{"n": 2, "line": "b"}', '{"n": 1, "line": "a", "o": "x"}',
    }


def test_stream_equals_batch(spark, folder, tmp_path):
    out, checkpoint = str(tmp_path / "stream"), str(tmp_path / "checkpoint")
    streamed = corpus.extract_stage(stream_text_files(spark, folder, max_files=2), TS)
    append_json(streamed, out, checkpoint).awaitTermination(120)
    batch = corpus.extract_stage(files.read_text_files(spark, folder), TS)
    again = spark.read.schema(batch.schema).json(out)
    as_text = lambda df: sorted(r.t for r in df.select(F.to_json(F.struct(*sorted(df.columns))).alias("t")).collect())
    assert as_text(again) == as_text(batch)


def test_stream_totals(spark, folder):
    totals = corpus.corpus_totals(corpus.extract_stage(stream_text_files(spark, folder, max_files=3), TS))
    query = totals.writeStream.format("memory").queryName("stream_totals").outputMode("complete").start()
    try:
        query.processAllAvailable()
        got = spark.table("stream_totals").collect()
    finally:
        query.stop()
    assert got == corpus.corpus_totals(corpus.extract_stage(files.read_text_files(spark, folder), TS)).collect()


def test_stream_of_pages(spark, tmp_path):
    from corpuscope.operators.responses import scrape_pages
    from corpuscope.plans.bases import page_responses
    from tests.conftest import DATA

    pages = page_responses(spark, DATA)
    stored = str(tmp_path / "pages")
    pages.repartition(3).write.parquet(stored)
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(stored)
    out = str(tmp_path / "scraped")
    append_json(scrape_pages(stream, {"h": "<h1>([^<]*)"}), out, str(tmp_path / "cp")).awaitTermination(120)
    batch = scrape_pages(pages, {"h": "<h1>([^<]*)"})
    again = spark.read.schema(batch.schema).json(out)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, batch.collect()))


def test_shared_dir(spark, monkeypatch):
    first = session.scratch_path(spark, "x")
    assert first != session.scratch_path(spark, "x")
    assert os.path.dirname(os.path.dirname(first)) == session.shared_dir(spark)
    class Conf:
        def get(self, key, default=None):
            return "hdfs:///shared/" if key == "spark.checkpoint.dir" else default
    class Session:
        conf = Conf()
    assert session.shared_dir(Session()) == "hdfs:///shared"


def test_passing_tables(spark):
    with session.passing_tables(spark) as keep:
        gone, kept = session.stored(spark.range(3), "gone"), session.stored(spark.range(4), "kept")
        keep(kept)
    assert kept.count() == 4
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|FileNotFound|not found"):
        gone.count()
