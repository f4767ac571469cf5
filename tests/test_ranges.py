"""Files that are read in byte ranges, global order as data."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import corpus, reports
from corpuscope.operators.ranking import ranked
from corpuscope.sources import config, files
from corpuscope.sources.ranges import extract_ranges, range_size, read_json_members, read_lines, read_pieces

TS = "2024-05-06T07:08:09.000Z"

JSON_FILES = {
    "array.json": json.dumps([{"i": i, "s": 'x,"]}{[,\\' * (i % 3), "l": [1, 2, {"q": None}]} for i in range(60)]),
    "pretty.json": json.dumps([{"a": [i, {"b": "é,  \\\""}]} for i in range(20)], indent=2, ensure_ascii=False) + "\n",
    "object.json": '{"a":1, "b":[1,2], "a":{"z":"},{"}, "c\\"]": null}',
    "spaces.json": " \r\n\t[ 1 ,\n 2 ] \n",
    "empty_array.json": "[]",
    "empty_object.json": " {} \n",
    "text.json": '"x,y"',
    "number.json": "5",
    "null.json": "null",
    "b c+d%20é.json": "[true]",
    "escapes.json": '[1,"a\\",b",{"k":"\\\\"},3]',
    "nested.json": "[" * 40 + "1,2" + "]" * 40,
    "trailing.json": "[1,2,]",
    "two.json": "[1][2]",
    "two_more.json": "[1],[2]",
    "open.json": "[1,2",
    "open_quote.json": '[1,"2]',
    "colon.json": '{"a" 1}',
    "word.json": "nul",
    "comma.json": "[1,2],",
    "bracket.json": "[1,2}",
    "only.json": ",",
    "extra.json": "[1,2] x",
    "nothing.json": "{,}",
    "closed.json": "1]",
    "bom.json": "﻿[1]",
}


def value_of(text):
    try:
        return json.loads(text, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return Exception


@pytest.mark.parametrize("size", [32, None])
def test_members_of_json_files(spark, tmp_path, size):
    for name, text in JSON_FILES.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    found = read_json_members(spark, str(tmp_path), range_bytes=size)
    rows = found.select("path", "filename", "kind", "position", "name", F.to_json("value").alias("value"), "parseError")
    got = {}
    for row in rows.orderBy("path", "position").collect():
        got.setdefault(row.filename, []).append(row)
    assert set(got) == set(JSON_FILES)
    assert {r.path for rows in got.values() for r in rows} == {r.path for r in files.scan_files(spark, str(tmp_path)).collect()}
    for name, text in JSON_FILES.items():
        expected, rows = value_of(text), got[name]
        if expected is Exception:
            assert [(r.kind, r.position, r.value, r.parseError is not None) for r in rows] == [(None, None, None, True)], name
            continue
        assert all(r.parseError is None for r in rows), name
        values = [json.loads(r.value) for r in rows if r.position is not None]
        if isinstance(expected, list):
            assert values == expected and rows[0].kind == "array", name
        elif isinstance(expected, dict):
            assert dict(zip((r.name for r in rows if r.position is not None), values, strict=True)) == expected, name
            assert [r.name for r in rows if r.position is not None] == list(expected), name
        else:
            assert values == [expected] and rows[0].kind == "value", name


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "one.json").write_text("[" + ",".join(map(str, range(20_000))) + "]")
    with range_size(spark, 4096):
        pieces = read_pieces(spark, str(tmp_path), ",")
        assert pieces.rdd.getNumPartitions() > 20
    rows = read_json_members(spark, str(tmp_path), range_bytes=4096).select("position", F.col("value").cast("bigint").alias("v"))
    assert rows.where("v <> position").count() == 0 and rows.count() == 20_000


def test_settings_go_back(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError), range_size(spark, 5):
        raise ValueError
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


TEXTS = {
    "a.txt": "one two\nthree\n\nfour é\r\n",
    "b.txt": "no end",
    "c.txt": "\n",
    "d.txt": "\n\nx" * 300 + "\U0001f600 end",
    "e b+c.txt": "word " * 200 + "\n" + "w\n" * 300,
    "f.json": '{"a": [1,2],\n "b": 2}\n',
    "g.json": '{"a": [1,2]',
    "h.txt": "﻿mark\nb",
}


@pytest.mark.parametrize("size", [64, None])
def test_ranges_give_what_whole_files_give(spark, tmp_path, size):
    for name, text in TEXTS.items():
        (tmp_path / name).write_bytes(text.encode())
    whole = corpus.extract_stage(files.read_text_files(spark, str(tmp_path)), TS).drop("jsonData")
    ranges = extract_ranges(spark, str(tmp_path), TS, range_bytes=size)
    assert {r.path for r in ranges.collect()} == {r.path for r in files.scan_files(spark, str(tmp_path)).collect()}
    columns = whole.columns
    assert sorted(map(repr, ranges.select(columns).collect())) == sorted(map(repr, whole.select(columns).collect()))

    got = {}
    for row in read_lines(spark, str(tmp_path), range_bytes=size).collect():
        got.setdefault(row.path.rsplit("/", 1)[1], {})[row.line_no] = row.line
    for name, text in TEXTS.items():
        lines = text.removeprefix("﻿").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        assert got[name] == dict(enumerate(lines)), name


def test_small_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}, x\n" for i in range(6000)))
    with range_size(spark, 256):
        ranges = read_pieces(spark, str(tmp_path)).rdd.getNumPartitions()
    lines = read_lines(spark, str(tmp_path), range_bytes=256)
    stored = {p for p in lines.inputFiles()}
    most = 4 * spark.sparkContext.defaultParallelism
    assert ranges > 2 * most and len(stored) <= most
    assert sorted((r.line_no, r.line) for r in lines.collect()) == [(i, f"line {i}, x") for i in range(6000)]


def test_only_json_files_are_read_as_json(spark, tmp_path):
    for name in ("a.txt", "b.json", "c.json.txt"):
        (tmp_path / name).write_text("1,2,3")
    with range_size(spark, None):
        assert {r.path.rsplit("/", 1)[1] for r in read_pieces(spark, str(tmp_path), ",", names="*.json").collect()} == {"b.json"}
    (tmp_path / "b.json").unlink()
    got = extract_ranges(spark, [str(tmp_path / "a.txt"), str(tmp_path / "c.json.txt")], TS)
    assert [(r.wordCount, r.parseError) for r in got.collect()] == [(1, None)] * 2


def test_settings_from_ranges(spark, tmp_path):
    pick = random.Random(2)
    expected = {}
    for name in ("a.env", "b.env"):
        lines = []
        for i in range(400):
            key = f"K{pick.randrange(30)}"
            lines.append(f"# {i}" if i % 7 == 0 else f" {key} = '{i}'")
            if i % 7:
                expected[name, key] = str(i)
        (tmp_path / name).write_text("\n".join(lines))
    with range_size(spark, 256):
        settings = config.read_config_lines(spark, str(tmp_path))
        assert read_pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 10
        got = {(r.path.rsplit("/", 1)[1], r.key): r.value for r in settings.collect()}
    assert got == expected


def test_ranked(spark):
    names = [f"n{random.Random(i).randrange(50):03}" for i in range(500)]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, i int").repartition(7)
    got = [(r["rank"], r.name, r.i) for r in ranked(df, ["name", "i"]).collect()]
    assert sorted(got) == [(k + 1, n, i) for k, (n, i) in enumerate(sorted((n, i) for i, n in enumerate(names)))]
    assert ranked(df.limit(0), ["name"]).collect() == []
    nulls = spark.createDataFrame([(None,), ("b",), (None,)], "path string")
    assert [(r.path, r["rank"]) for r in files.sort_listing(nulls, "path").orderBy("rank").collect()] == [(None, 1), (None, 2), ("b", 3)]


def test_collected_records_keep_their_place(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 0)], "filename string, size int")
    got = corpus.collect_documents(df, rank="place").collect()
    assert {(r.place, r.filename, r["size"]) for r in got} == {(1, "a", 2), (2, "b", 0), (3, "b", 1)}


def test_report_of_members_is_that_of_the_text(spark, tmp_path):
    texts = {n: t for n, t in JSON_FILES.items() if n in ("array.json", "object.json", "empty_array.json", "empty_object.json", "two.json", "nested.json")}
    texts["mixed.json"] = '{"b":1.0,"10":{"x":[1,null,{"y":2}],"n":null},"2":"t","c":null,"b":{"q":1},"e":{}}'
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    whole = spark.createDataFrame(list(texts.items()), "filename string, text string")
    expected = reports.report_lines(whole, "filename", "text", TS).collect()
    got = reports.report_members(read_json_members(spark, str(tmp_path), range_bytes=16), "filename", TS).collect()
    assert sorted(tuple(map(str, r)) for r in got) == sorted(tuple(map(str, r)) for r in expected)


def test_sizes_of_reports(spark):
    df = spark.createDataFrame([(1, '{"a":1}')], "i int, t string")
    lines = reports.report_lines(df, "i", "t", "TS")
    text = "\n".join(r.line for r in lines.orderBy("seq", "line_no").collect()) + "\n"
    assert reports.report_sizes(lines, "i").first().asDict() == {"i": 1, "format": "text", "size": len(text)}
