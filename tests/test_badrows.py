from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanline.operators import badrows as B

LAYOUT = {"title": 0, "artist": 1, "isrc": 2, "duration": 3, "year": 4, "position": 5}


def brute(line, delim):
    """The rules of a cell, read character by character: cells, or None for broken quoting."""
    cells, i, n = [], 0, len(line)
    while True:
        while i < n and line[i] == " " and delim != " ":
            i += 1
        cell = ""
        if i < n and line[i] == '"':
            i += 1
            while True:
                if i >= n:
                    return None
                if line[i] == '"' and line[i + 1 : i + 2] == '"':
                    cell += '"'
                    i += 2
                elif line[i] == '"':
                    i += 1
                    break
                else:
                    cell += line[i]
                    i += 1
            if i < n and line[i] != delim:
                return None
        else:
            while i < n and line[i] != delim:
                cell += line[i]
                i += 1
        cells.append(cell)
        if i >= n:
            return cells
        i += 1


@given(st.text(alphabet='ab ",;\r', min_size=1, max_size=14), st.sampled_from(",;"))
def test_reader_follows_the_rules(line, delim):
    if line.strip():
        assert B.read_row(line, delim) == brute(line, delim)


def test_values():
    assert B.valid("isrc", "aa-bbb-12-34567") and not B.valid("isrc", "AAB12345")
    assert B.valid("duration", "3:07") and B.valid("duration", "187.5") and not B.valid("duration", "0") and not B.valid("duration", "3:77") and not B.valid("duration", "-3")
    assert B.valid("year", "1860") and B.valid("year", "2200-01-02") and not B.valid("year", "1859") and not B.valid("year", "20101") and not B.valid("year", "in 1999")
    assert B.valid("position", "1") and not B.valid("position", "0") and not B.valid("position", "1.5")
    assert all(B.valid(f, "  ") for f in LAYOUT) and B.valid("title", "anything")


def cases(spark, rows):
    return spark.createDataFrame(rows, "case_no bigint, text string")


def specs(spark, rows):
    return spark.createDataFrame(rows, "case_no bigint, delim string, header_row int, column_map map<string,int>, ambiguous boolean")


def test_rows_and_reasons(spark):
    text = 'Title,Artist,ISRC,Time,Year,No\r\nA,B,QZA120000001,3:10,1999,1\r\n\r\n"A,B,,,,\nA,B\nA,"B" x,,,,\nA,B,,x,,\nA,"B ""C""",,,2001-02-03,2'
    rows = B.parse_rows(cases(spark, [(1, text)]).withColumn("line", F.lit(1)), specs(spark, [(1, ",", 0, LAYOUT, False)] * 2).withColumn("text", F.lit("x"))).collect()
    assert {(r.line_no, r.reason) for r in rows} == {(1, None), (3, "quoting"), (4, "column_count"), (5, "quoting"), (6, "invalid_value"), (7, None)}
    assert len(rows) == 6
    good = {r.line_no: r.cells for r in rows if r.reason is None}
    assert good[7]["artist"] == 'B "C"'


def test_loaded_types(spark):
    rows = B.parse_rows(cases(spark, [(1, "A,B,qz-a12-00-00001,3:10,1999-05,7\nA,,,187000,,")]), specs(spark, [(1, ",", None, LAYOUT, False)]))
    got = [tuple(r) for r in B.loaded(rows).orderBy("line_no").collect()]
    assert got == [(1, 0, "A", "B", None, "QZA120000001", 190000, 1999, 7), (1, 1, "A", None, None, None, 187000, None, None)]


def test_edges(spark):
    texts = cases(spark, [(1, None), (2, ""), (3, " \n\t\n"), (4, "a|" + "x" * 300000), (5, "no spec"), (6, "a")])
    layout = specs(spark, [(1, "|", None, {"title": 0}, None), (2, "|", 0, {"title": 0}, None), (3, "|", None, {"title": 0}, None), (4, "|", None, {"title": 0, "artist": 1}, None), (6, None, None, {"title": 0}, None), (7, "|", None, None, None)])
    got = [(r.case_no, r.line_no, r.reason) for r in B.parse_rows(texts, layout).collect()]
    assert got == [(4, 0, None)]
    assert B.parse_rows(cases(spark, []), specs(spark, [])).count() == 0
