import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpuscope.functions.jsontext import parse_json
from corpuscope.operators.items import apply_transform, extract_keys, items_filter, items_map
from corpuscope.operators.rules import apply_rules, rules_json


def ruled(spark, text, rules):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(rules_json(parse_json(F.col("t")), rules).alias("r")).first().r


def test_no_rules_returns_input(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert apply_rules(df, {}) is df
    assert json.loads(ruled(spark, '{"a":1,"b":null}', {})) == {"a": 1, "b": None}


def test_typed_rules(spark):
    df = spark.createDataFrame([("Ab", -2.5, True, "7x", None), ("c", 2.5, False, " 7 ", "set")],
                               "s string, d double, b boolean, t string, n string")
    rules = {
        "up": {"source": "s", "transform": "uppercase"},
        "low": {"source": "s", "transform": "lowercase"},
        "dtext": {"source": "d", "transform": "lowercase"},
        "twice": {"source": "d", "transform": "multiply", "factor": 2},
        "zero": {"source": "d", "transform": "multiply", "factor": 0},
        "whole": {"source": "d", "transform": "round"},
        "flag": {"source": "b", "transform": "multiply", "factor": 3},
        "number": {"source": "t", "transform": "round"},
        "filled": {"source": "n", "default": "none"},
        "fresh": {"default": 4},
        "same": {"source": "s", "transform": "unknown"},
        "gone": {"source": "nothing"},
    }
    rows = [r.asDict() for r in apply_rules(df, rules).collect()]
    assert rows == [
        {"up": "AB", "low": "ab", "dtext": "-2.5", "twice": -5.0, "zero": -2.5, "whole": -2.0, "flag": 3.0,
         "number": None, "filled": "none", "fresh": 4, "same": "Ab"},
        {"up": "C", "low": "c", "dtext": "2.5", "twice": 5.0, "zero": 2.5, "whole": 3.0, "flag": 0.0,
         "number": 7.0, "filled": "set", "fresh": 4, "same": "c"},
    ]


def test_defaults_of_another_type(spark):
    df = spark.sql("SELECT * FROM VALUES (5L, 2.5D, parse_json('1')), (NULL, NULL, NULL) AS t(n, d, v)")
    rules = {
        "a": {"source": "n", "default": "none"},
        "b": {"source": "n", "default": 0},
        "c": {"source": "d", "default": True},
        "d": {"source": "d", "transform": "round", "default": "none"},
        "e": {"source": "v", "default": {"k": [1]}},
        "f": {"source": "d", "default": 1},
        "g": {"default": [1, 2]},
        "h": {"source": "n", "default": None},
    }
    plain = [[x.toPython() if hasattr(x, "toPython") else x for x in r] for r in apply_rules(df, rules).collect()]
    assert plain == [
        ["5", 5, "2.5", "3", 1, 2.5, [1, 2], 5],
        ["none", 0, "true", "none", {"k": [1]}, 1.0, [1, 2], None],
    ]


def test_json_rules_tell_absent_from_null(spark):
    rules = {"x": {"source": "a", "default": "none"}, "y": {"source": "b", "default": [1]}, "z": {"source": "c"}}
    assert ruled(spark, '{"a":null}', rules) == '{"x":null,"y":[1]}'
    assert ruled(spark, '{"a":false,"b":{"q":1},"c":""}', rules) == '{"x":false,"y":{"q":1},"z":""}'


def test_json_rules_convert(spark):
    rules = {
        "up": {"source": "s", "transform": "uppercase"},
        "n": {"source": "s", "transform": "multiply", "factor": 2},
        "r": {"source": "v", "transform": "round"},
        "one": {"source": "v", "transform": "multiply"},
        "null": {"source": "z", "transform": "uppercase"},
        "zero": {"source": "z", "transform": "multiply", "factor": 5},
    }
    assert ruled(spark, '{"s":"a\\"b","v":-2.5,"z":null}', rules) == (
        '{"up":"A\\"B","n":null,"r":-2,"one":-2.5,"null":"NULL","zero":0}'
    )


def test_json_rule_with_odd_names(spark):
    rules = {'k"': {"source": "it's"}}
    assert ruled(spark, '{"it\'s":1}', rules) == '{"k\\"":1}'
    for name in ('a.b', 'x y', '\u00e9', '', '["q"]', "?"):
        text = json.dumps({name: 5}, ensure_ascii=False)
        assert ruled(spark, text, {"v": {"source": name, "default": 0}}) == ('{"v":5}' if name else '{"v":0}')


def values_frame(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return df.select("i", parse_json(F.col("t")).alias("data"))


def texts(df):
    return [r.r for r in df.select("i", F.to_json("data").alias("r")).orderBy("i").collect()]


def test_items(spark):
    df = spark.createDataFrame([([1, 2, 3, None],), ([],), (None,)], "a array<int>")
    assert [r.a for r in items_filter(df, "a", "item > 1").collect()] == [[2, 3], [], None]
    assert [r.a for r in items_map(df, "a", "item * 10").collect()] == [[10, 20, 30, None], [], None]
    with pytest.raises(PySparkException):
        items_map(df, "a", "item +").collect()


def test_extract_keys(spark):
    df = values_frame(spark, '{"a":1,"b":null}', "null", '"s"', "7", '["x","y"]')
    assert texts(extract_keys(df, "data", ["b", "a", "c", "1", "length"])) == [
        '{"a":1,"b":null}', None, '"s"', "7", '{"1":"y","length":2}',
    ]


def test_transform_precedence(spark):
    df = values_frame(spark, "[1,2,3,4]", '{"a":1,"b":2}', "5", "null")
    both = {"filter": "item::int > 2", "map": "item::int * 10", "extract": ["a"]}
    assert texts(apply_transform(df, "data", both)) == ["[3,4]", '{"a":1}', "5", None]
    assert texts(apply_transform(df, "data", {"map": "item::int * 10"})) == [
        "[10,20,30,40]", '{"a":1,"b":2}', "5", "null",
    ]
    assert texts(apply_transform(df, "data", {"filter": "", "extract": ["a"]}))[1] == '{"a":1}'
    assert texts(apply_transform(df, "data", None)) == ["[1,2,3,4]", '{"a":1,"b":2}', "5", "null"]
    empty = values_frame(spark, "[]")
    assert texts(apply_transform(empty, "data", both)) == ["[]"]
