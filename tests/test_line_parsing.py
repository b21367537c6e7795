import re

import pytest

from cohortlab.operators.line_parsing import parse_label_lines, split_lines

SCHEMA = "line_id long, raw_line string"


def expected(line):
    """A character automaton, independent of the patterns: a row, a reason, or None for a blank line."""
    line = (line or "").strip(" \t\r")
    if not line:
        return None
    fields, i = [], 0
    while i < len(line):
        if line[i] in " \t":
            i += 1
            continue
        if line[i] == '"':
            value, i = "", i + 1
            while True:
                if i >= len(line):
                    return "quoting"
                if line[i] == '"' and line[i + 1 : i + 2] == '"':
                    value, i = value + '"', i + 2
                elif line[i] == '"':
                    i += 1
                    break
                else:
                    value, i = value + line[i], i + 1
            if i < len(line) and line[i] not in " \t":
                return "quoting"
        else:
            value = ""
            while i < len(line) and line[i] not in " \t":
                if line[i] == '"':
                    return "quoting"
                value, i = value + line[i], i + 1
        fields.append(value)
    if len(fields) != 2:
        return "column_count"
    name, label = fields
    good = re.fullmatch(r"(?s)[^/\\]+\.(jpg|jpeg|png)", name, re.I) and label in list("01234567")
    return (name, int(label)) if good else "invalid_value"


LINES = [
    "1.jpg 0", " 2.JPG\t7\r", "", "   ", "\t\r", None, '"a b.png" 3', '"a ""b"".png" 3', '"a.png 3', '"a.png"x 3', 'a".png 3', '"" 3', '".png" 3', ".png 3", "a.png", "a.png 1 2", "a.png 8", "a.png １", 'a.png "3"', 'a.png " 3"',
    "x/a.png 1", "x\\a.png 1", "a.gif 1", "a.PnG 1", "a.b.jpeg 7", '"', '""', '"""', '"""" 3', 'a.png ""', "a.png 7.", '"a.png" "4', "é.png 2", "a.png\r 3", ' .jpg 1', '" .jpg" 1', "a.jpg\x0b1",
]


def test_lines_against_automaton(spark):
    clean, rejected = parse_label_lines(spark.createDataFrame(list(enumerate(LINES)), SCHEMA))
    got = {r.line_id: (r.filename, r.label) for r in clean.collect()} | {r.line_id: r.reason for r in rejected.collect()}
    want = {i: e for i, line in enumerate(LINES) if (e := expected(line)) is not None}
    assert got == want


def test_generated_lines(spark):
    hypothesis = pytest.importorskip("hypothesis")
    strategy = hypothesis.strategies.text(alphabet='ab" \t.jpg07/', max_size=14)
    lines = []

    @hypothesis.settings(max_examples=400, database=None, derandomize=True)
    @hypothesis.given(strategy)
    def gather(text):
        lines.append(text)

    gather()
    clean, rejected = parse_label_lines(spark.createDataFrame(list(enumerate(lines)), SCHEMA))
    got = {r.line_id: (r.filename, r.label) for r in clean.collect()} | {r.line_id: r.reason for r in rejected.collect()}
    assert got == {i: e for i, line in enumerate(lines) if (e := expected(line)) is not None}


def test_null_and_repeated_keys_extra_columns(spark):
    rows = [(None, "a.png 1", "x"), (None, "bad", "y"), (7, "c.png 2", "z"), (7, "c.png 2", "z"), (7, "broken", "w")]
    clean, rejected = parse_label_lines(spark.createDataFrame(rows, "line_id long, raw_line string, filename string"))
    assert sorted((r.filename, r.label) for r in clean.collect()) == [("a.png", 1), ("c.png", 2), ("c.png", 2)]
    assert sorted((str(r.line_id), r.filename, r.reason) for r in rejected.collect()) == [("7", "w", "column_count"), ("None", "y", "column_count")]


def test_empty_and_very_long(spark):
    clean, rejected = parse_label_lines(spark.createDataFrame([], SCHEMA))
    assert clean.count() == 0 and rejected.count() == 0
    long = ["a" * 300_000 + ".png 1", '"' + '""' * 200_000, "a " * 200_000, '"' + '""' * 100_000 + '.png" 2', "a.png" + " " * 300_000 + "5"]
    clean, rejected = parse_label_lines(spark.createDataFrame(list(enumerate(long)), SCHEMA))
    assert sorted(r.line_id for r in clean.collect()) == [0, 3, 4]
    assert sorted((r.line_id, r.reason) for r in rejected.collect()) == [(1, "quoting"), (2, "column_count")]


def test_other_fields(spark):
    lines = spark.createDataFrame([(1, "x 1 2020"), (2, "x y 2020")], SCHEMA)
    clean, rejected = split_lines(lines, "raw_line", "line_id", ("a", "b", "c"), {"b": r"\A[0-9]\z"}, {"b": "int"})
    assert [(r.a, r.b, r.c) for r in clean.collect()] == [("x", 1, "2020")]
    assert [r.reason for r in rejected.collect()] == ["invalid_value"]
