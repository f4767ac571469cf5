"""Scalar functions on small inputs, expected values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import html, jsontext, numbers, paths, text

SMILE = chr(0x1F600)
NBSP = chr(0xA0)
WIDE = chr(0x3000)


def test_count_words(values):
    items = ["", "one", "a b\n", f"a{NBSP}b{WIDE}c", "\t x \r\n\x0b\x0c y  ", f"{NBSP}", "a\u200bb", "a\u180eb", None]
    assert values(text.count_words, items) == [0, 1, 2, 3, 2, 0, 1, 1, None]


def test_count_words_against_python(values):
    spaces = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    rng = random.Random(7)
    letters = "ab\xe9\u4e2d\u1681\u200b\u2030"
    items = ["".join(rng.choice(spaces if rng.random() < 0.4 else letters) for _ in range(30)) for _ in range(300)]
    table = str.maketrans({c: " " for c in spaces})
    counts = [len([w for w in i.translate(table).split(" ") if w]) for i in items]
    assert values(text.count_words, items) == counts
    collapsed = [" ".join(w for w in i.translate(table).split(" ") if w) for i in items]
    assert [v.strip(" ") for v in values(text.collapse_ws, items)] == collapsed
    assert values(text.trim_ws, items) == [i.strip(spaces) for i in items]


def test_count_lines_and_chars(values):
    assert values(text.count_lines, ["", "a", "a\n", "a\nb\n\n"]) == [1, 1, 2, 4]
    assert values(text.char_count, ["", "ab", "\xe9", SMILE, f"a{SMILE}b"]) == [0, 2, 1, 2, 4]


def test_preview_chars(values):
    items = ["", "short", "x" * 150, SMILE * 60, "x" * 99 + SMILE, "x" * 98 + SMILE + "y"]
    expected = ["", "short", "x" * 100, SMILE * 50, "x" * 99, "x" * 98 + SMILE]
    assert values(text.preview_chars, items) == expected


def test_preview_lines(values):
    lines = "\n".join(str(n) for n in range(15))
    assert values(text.preview_lines, ["", "a\n", lines]) == ["", "a\n", "0\n1\n2\n3\n4\n5\n6\n7\n8\n9"]


def test_html_title(values):
    items = [
        "<p>none</p>",
        "<title></title>",
        "<TITLE lang=x>\n Upper \t</Title>",
        "<title></title><title>second</title>",
    ]
    assert values(html.html_title, items) == ["", "", "Upper", "second"]


def test_html_text(values):
    items = [
        "a<script>var x=1</script>b",
        "a<SCRIPT type=x>var\nx</SCRIPT>b",
        "<style>p{}</style><p>x</p>\n\n<p>y  z</p>",
        "x" * 1500,
        f"<b>a</b>{NBSP}<i>b</i>",
    ]
    assert values(html.html_text, items) == ["ab", "a var x b", "x y z", "x" * 1500, "a b"]
    assert values(lambda c: html.html_text(c, 1000), items)[3] == "x" * 1000


def test_html_links_and_images(values):
    many_links = "".join(f'<a href="/{n}">' for n in range(60))
    many_images = "".join(f"<img src='/{n}'>" for n in range(25))
    links = values(html.html_links, [many_links, '<a href=/x>', '<A class="b" HREF=\'/y\'>t</A><area href="/z">'])
    assert links == [[f"/{n}" for n in range(60)], [], ["/y", "/z"]]
    assert len(values(lambda c: html.html_links(c, 50), [many_links])[0]) == 50
    images = values(html.html_images, [many_images, '<IMG alt="" SRC="a.png"><img src="a.png">'])
    assert images == [[f"/{n}" for n in range(25)], ["a.png", "a.png"]]
    assert len(values(lambda c: html.html_images(c, 20), [many_images])[0]) == 20


def test_html_pattern(values):
    page = "<b>x</b><B></B><i>y</i>"
    assert values(lambda c: html.html_pattern(c, "<b>[^<]*</b>"), [page]) == [["<b>x</b>", "<B></B>"]]
    assert values(lambda c: html.html_pattern(c, "<b>([^<]*)</b>"), [page]) == [["x", "<B></B>"]]
    assert values(lambda c: html.html_pattern(c, "<b>(q)?"), [page]) == [["<b>", "<B>"]]


def test_valid_pattern(spark):
    assert html.valid_pattern(spark, "a(b)?")
    assert not html.valid_pattern(spark, "([")
    assert not html.valid_pattern(spark, "a)(b")


def test_paths(values):
    assert values(paths.normalize_path, ["/a/./b/../c//d", "../x", "", "/..", "a/../../b", "/"]) == [
        "/a/c/d", "x", "", "/", "b", "/",
    ]
    assert values(paths.base_name, ["/a/b.txt", "b", "/a/"]) == ["b.txt", "b", ""]
    assert values(paths.parent_path, ["/a/b/c.txt", "c.txt", "/c"]) == ["/a/b", "", ""]
    assert values(paths.url_filename, ["http://h/x.zip", "http://h/"]) == ["x.zip", "download.txt"]
    assert values(paths.file_extension, ["a.tar.gz", "Makefile", "x."]) == ["gz", "Makefile", ""]
    assert values(lambda c: paths.has_extension(c, [".js", ".cpp"]), ["a.js", "b.cpp", "c.json"]) == [True, True, False]


@pytest.mark.parametrize(
    ("number", "rounded"),
    [(-2.5, -2.0), (2.5, 3.0), (0.49999999999999994, 0.0), (-0.2, 0.0), (1e300, 1e300), (4503599627370497.0,) * 2],
)
def test_round_half_up(values, number, rounded):
    assert values(numbers.round_half_up, [number], "double") == [rounded]


def test_number_text(values):
    items = [0.0, 5.0, 6.55, -2.5, 12345678.5, 1e20, 1e21, 1.5e-7, 0.001, 1e-6, 0.1, 1e7, -1e25, 123.0]
    assert values(numbers.number_text, items, "double") == [
        "0", "5", "6.55", "-2.5", "12345678.5", "100000000000000000000", "1e+21", "1.5e-7", "0.001", "0.000001",
        "0.1", "10000000", "-1e+25", "123",
    ]


def test_text_to_number(values):
    items = ["", "  ", " 12 ", "1e3", ".5", "5.", "0x1F", "1d", "NaN", "many", "-7", None]
    assert values(numbers.text_to_number, items) == [0, 0, 12, 1000, 0.5, 5, 31, None, None, None, -7, None]


def test_hexadecimal_of_any_length(values):
    items = ["0xFFFFFFFFFFFFFF", "0x" + "f" * 40, "0x20000000000001", "0x20000000000001" + "0" * 20 + "1", "0x" + "0" * 50 + "a"]
    assert values(numbers.text_to_number, items) == [float(int(x, 16)) for x in items]
    assert values(numbers.text_to_number, ["0x", "0x" + "f" * 300]) == [None, float("inf")]


def test_numbers_that_json_cannot_say(spark):
    df = spark.sql("SELECT named_struct('i', 1e308D * 100, 'm', -1e308D * 100, 'n', double('NaN'), 'k', 2.5D) AS s")
    assert df.select(jsontext.stringify(F.col("s"), df.schema["s"].dataType).alias("t")).first().t == (
        '{\n  "i": null,\n  "m": null,\n  "n": null,\n  "k": 2.5\n}'
    )


def test_json_of_any_size(spark):
    texts = {
        "string": """concat('{"a":"', repeat('x', 30000000), '","b":7}')""",
        "nested": "concat(repeat('[', 1100), repeat(']', 1100))",
        "number": "concat('[', repeat('9', 1500), ']')",
        "broken": """concat('{"a":"', repeat('x', 30000000), '"')""",
        "unclosed": "concat(repeat('[', 1100), repeat(']', 1099))",
        "rest": """concat('{"a":"', repeat('x', 30000000), '"} x')""",
    }
    got = {}
    for name, text in texts.items():
        df = jsontext.with_json(spark.range(1).select(F.expr(text).alias("t")), "v", F.col("t"))
        row = df.select(
            F.col("v").isNotNull().alias("ok"),
            F.try_variant_get("v", "$.b", "int").alias("b"),
            jsontext.json_error(F.col("v"), F.col("t")).alias("error"),
        ).first()
        got[name] = tuple(row)
    bad = (False, None, jsontext.PARSE_ERROR)
    assert got == {
        "string": (True, 7, None), "nested": (True, None, None), "number": (True, None, None),
        "broken": bad, "unclosed": bad, "rest": bad,
    }


def test_json_beyond_a_variant(spark):
    text = F.expr("concat('{\"b\":[', repeat('1234567,', 18000000), '1]}')")
    df = jsontext.with_json(spark.range(1).select(text.alias("t")), "v", F.col("t"))
    row = df.select(
        F.col("v").isNull().alias("none"),
        jsontext.json_error(F.col("v"), F.col("t")).alias("error"),
        (jsontext.json_object_or_empty(F.col("t")) == F.col("t")).alias("same"),
    ).first()
    assert tuple(row) == (True, jsontext.TOO_LARGE, True)


def test_repeated_names_without_settings(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    df = jsontext.with_json(spark.createDataFrame([('{"a":1,"a":2}',)], "t string"), "v", F.col("t"))
    assert df.select(F.to_json("v").alias("j")).first().j == '{"a":2}'


def test_parse_json(values):
    good = ['{"a":1}', "null", "[1,2]", '"s"', " 1\n", '{"a":1,"a":2}', "[]"]
    bad = ['{"a":1} x', '{"a":1}{"b":2}', "1,2", "1],[2", "1] x", "", " ", "01", "{a:1}", "{'a':1}", '{"a":', None]
    parsed = values(lambda c: F.to_json(jsontext.parse_json(c)), good)
    assert parsed == ['{"a":1}', "null", "[1,2]", '"s"', "1", '{"a":2}', "[]"]
    assert values(lambda c: jsontext.parse_json(c).isNull(), bad) == [True] * len(bad)


def test_value_text_and_number(values):
    items = ["null", "true", '"x"', "5.0", "1e3", '{"a":1}', '[1,"b",null,[2]]', "[]", "[7]", '" 8 "']
    assert values(lambda c: jsontext.value_text(jsontext.parse_json(c)), items) == [
        "null", "true", "x", "5", "1000", "[object Object]", "1,b,,[2]", "", "7", " 8 ",
    ]
    assert values(lambda c: jsontext.value_number(jsontext.parse_json(c)), items) == [
        0, 1, None, 5, 1000, None, None, 0, 7, 8,
    ]


def test_json_body(values):
    body = '{"a":1}'
    for media, parsed in [("application/json; x", body), ("text/html", None), ("Application/JSON", None), (None, None)]:
        assert values(lambda c: F.to_json(jsontext.json_body(F.lit(media), c)), [body]) == [parsed]
    assert values(lambda c: F.to_json(jsontext.json_body(F.lit("application/json"), c)), ["{"]) == [None]


def test_json_object_or_empty(values):
    assert values(jsontext.json_object_or_empty, ['{"b":1}', "[1]", "null", "{", None]) == ['{"b":1}', "{}", "{}", "{}", "{}"]


def test_stringify(spark):
    df = spark.sql(
        """SELECT named_struct('i', 1, 'd', 2.0D, 's', 'q"\\\\', 'a', array(1.5D, 2D), 'e', array(), 'm', map('k', true),
        'n', CAST(NULL AS STRING), 't', TIMESTAMP '2024-01-02 03:04:05.678') AS v"""
    )
    printed = df.select(jsontext.stringify(F.col("v"), df.schema["v"].dataType).alias("r")).first().r
    assert printed == (
        '{\n  "i": 1,\n  "d": 2,\n  "s": "q\\"\\\\",\n  "a": [\n    1.5,\n    2\n  ],\n  "e": [],\n'
        '  "m": {\n    "k": true\n  },\n  "n": null,\n  "t": "2024-01-02T03:04:05.678Z"\n}'
    )
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        moment = spark.sql("SELECT timestamp_millis(1704164645678) AS v")
        printed = moment.select(jsontext.stringify(F.col("v"), moment.schema["v"].dataType).alias("r")).first().r
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert printed == '"2024-01-02T03:04:05.678Z"'
    short = df.select(jsontext.stringify(F.col("v"), df.schema["v"].dataType, absent_null=True).alias("r")).first().r
    assert '"n"' not in short
