import csv

import pytest
from pyspark.sql import functions as F

from gleanline.operators import extract as X
from gleanline.operators import lines as L
from gleanline.operators import parse as P
from gleanline.operators import tables as TB


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")


def items(spark, text, **more):
    rows = X.extract(docs(spark, text), **more).items.orderBy("first_start").collect()
    return [(r.title, r.artist) for r in rows]


def test_lines_and_offsets(spark):
    text = "a🎵\n\nbc\n"
    rows = [(r.line_no, r.line, r.line_offset) for r in L.split_lines(docs(spark, text, None, "")).where("doc_id = 1").orderBy("line_no").collect()]
    assert rows == [(0, "a🎵", 0), (1, "", 3), (2, "bc", 4), (3, "", 7)]
    assert all(text[o : o + len(t)] == t for _, t, o in rows)
    assert L.split_lines(docs(spark, None, "")).count() == 1


@pytest.mark.parametrize("line", ["", "---", "## Head", "```", "| --- | --- |", "https://x.org/a", "<br>", "Encore:", "… !"])
def test_noise(spark, line):
    assert spark.range(1).select(L.is_noise(F.lit(line))).first()[0]


@pytest.mark.parametrize(("line", "prose"), [("Mr. Brightside and Vol. 2", False), ("We went there. It was fine", True), ("R.E.M. Play Songs Tonight", False), ("one two three four five six seven eight nine ten eleven twelve thirteen", True), ("Stop! Now", False)])
def test_prose(spark, line, prose):
    assert spark.range(1).select(L.is_prose(F.lit(line))).first()[0] is prose


CASES = [
    ("1. Daft Punk - One More Time", "One More Time", "Daft Punk", "dash", 1, None), ("12) A – B", "B", "A", "dash", 12, None), ("[4] A - B", "B", "A", "dash", 4, None), ("0. A - B", "B", "A", "dash", None, None),
    ("03:15 A - B", "B", "A", "dash", None, 195), ("• A — B", "B", "A", "dash", None, None), ('"Midnight City" by M83', "Midnight City", "M83", "quoted", None, None), ('M83 - "Midnight City"', "Midnight City", "M83", "quoted", None, None),
    ("Midnight City by M83", "Midnight City", "M83", "by", None, None), ("A\tB", "B", "A", "tab", None, None), ("Song (Live) - The Band", "Song", "The Band", "dash", None, None), ("A - B - C", "B - C", "A", "dash", None, None),
]


@pytest.mark.parametrize("case", CASES)
def test_parsers(spark, case):
    line, title, artist, parser, position, stamp = case
    r = P.parse_lines(L.triage(L.split_lines(docs(spark, line)))).select("strict.*", "position", "timestamp_s").first()
    assert (r.title, r.artist, r.parser, r.position, r.timestamp_s) == (title, artist, parser, position, stamp)


@pytest.mark.parametrize("line", ["Our picks, compiled by the editors", "Produced by Someone", "A song by my mother", "This list was made by us and by them", "Just a line of words"])
def test_lines_that_name_no_song(spark, line):
    assert P.parse_lines(L.triage(L.split_lines(docs(spark, line)))).where("strict is not null").count() == 0


def test_suffixes(spark):
    r = P.parse_lines(L.triage(L.split_lines(docs(spark, "A - B (3:45) [GBAYE-00-00001]")))).first()
    assert (r.strict.title, r.duration_s, r.isrc) == ("B", 225.0, "GBAYE0000001")


def test_row_splitting_follows_the_reader(spark):
    rows = ['a,"b,c",d', 'a, "b ""q""" ,d', "plain,x,", '"open,x']
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, line string")
    got = [r.cells for r in frame.select("i", TB.split_row(F.col("line"), F.lit(",")).alias("cells")).orderBy("i").collect()]
    assert got == [[c.strip() for c in next(csv.reader([r], skipinitialspace=True))] for r in rows]


def test_table_with_header(spark):
    text = "Artist,Title,Album,ISRC,Time\nDaft Punk,One More Time,Discovery,GBDUW0000059,320000\nM83,Midnight City,,bad,4:03"
    e = X.extract(docs(spark, text))
    got = [(r.title, r.artist, r.isrc, r.duration_s, r.parser, r.position) for r in e.items.orderBy("first_start").collect()]
    assert got == [("One More Time", "Daft Punk", "GBDUW0000059", 320.0, "csv", 2), ("Midnight City", "M83", None, 243.0, "csv", 3)]
    assert e.residual.count() == 0


def test_headerless_table_finds_the_artist_by_repetition(spark):
    text = "\n".join(f"Song {i};Band {i % 2}" for i in range(8))
    assert items(spark, text)[0] == ("Song 0", "Band 0")


def test_bare_titles_only_on_lists(spark):
    assert items(spark, "Bohemian Rhapsody\nHeroes\nRespect") == [("Bohemian Rhapsody", None), ("Heroes", None), ("Respect", None)]
    assert items(spark, "Bohemian Rhapsody\nWe went there. It was fine and long\nWe liked it. It was good to hear") == []


def test_duplicates_and_absorption(spark):
    e = X.extract(docs(spark, "Aphex Twin - Xtal\nSomeone - Other\nAPHEX TWIN - XTAL!\nXtal\nA - Heroes\nB - Heroes\nHeroes\nx\ny\nz\nu\nv"))
    got = {(r.title, r.artist): [tuple(s) for s in r.duplicates] for r in e.items.collect()}
    assert got[("Xtal", "Aphex Twin")] == [(34, 52), (53, 57)]
    assert ("Heroes", None) in got


def test_grounding_reasons(spark):
    rows = [("a b c", "a b c", None, None, "a b c", 0, 5, 9), ("x y", "x y", None, None, "a b c", 0, 5, 9), ("a", "a", "zz", "zz", "a b", 0, 3, 9), (" ", "", None, None, "a", 0, 1, 9), ("t" * 301, "t", None, None, "t", 0, 1, 9), ("a", "a", None, None, "a", 0, 99, 9), ("a", "a", None, None, "a", 0, 401, 999)]
    frame = spark.createDataFrame(rows, "title string, ftitle string, artist string, fartist string, fspan string, span_start int, span_end int, n_chars int")
    got = [r.reason for r in X.reject_reason(frame).collect()]
    assert got == [None, "span_text_mismatch", "span_text_mismatch", "empty_title", "title_too_long", "span_out_of_range", "span_out_of_range"]


def test_orientation_by_cue_repetition_and_kind(spark):
    kinds = spark.createDataFrame([(1, "paste"), (2, "paste"), (3, "scan_print"), (4, None)], "doc_id bigint, source_kind string")
    texts = docs(spark, 'x - y\n"T" by A', "Song A - Oasis\nSong B - Oasis\nSong C - Oasis", "T - A", "T - A")
    e = X.extract(texts, kinds)
    got = {(r.doc_id, r.title, r.artist) for r in e.items.collect()}
    assert {(1, "x", "y"), (2, "Song A", "Oasis"), (2, "Song C", "Oasis"), (3, "T", "A"), (4, "A", "T")} <= got
    assert {r.doc_id for r in e.items.where("alternate is not null").collect()} == {3}


def test_numbering_does_not_hide_a_repetition(spark):
    kinds = spark.createDataFrame([(1, "paste")], "doc_id bigint, source_kind string")
    assert X.extract(docs(spark, "1. X - Oasis\n2. Y - Oasis"), kinds).items.where("artist = 'Oasis'").count() == 2


def test_edges(spark):
    e = X.extract(docs(spark, None, "", "   ", "A - B\n" * 500, "x" * 200000).withColumns({"line": F.lit(1), "title": F.lit("t"), "n_chars": F.lit(3)}))
    assert [(r.doc_id, r.title) for r in e.items.collect()] == [(4, "B")]
    stats = {r.doc_id: r for r in e.stats.collect()}
    assert set(stats) == {2, 3, 4} and stats[4].items_before_dedupe == 500 and stats[4].items_after_dedupe == 1 and stats[2].coverage == 1.0
    assert X.extract(docs(spark, *[]).limit(0)).items.count() == 0


def test_lines_stay_in_the_partition_of_their_document(spark, monkeypatch):
    from gleanline import session

    seen, cut = [], session.cut
    monkeypatch.setattr(session, "cut", lambda frame: seen.append(frame._jdf.queryExecution().executedPlan().toString().count("Exchange")) or cut(frame))
    X.extract(docs(spark, "A - B\nC - D\nE - F", "t,a\nx,y\nz,w", 'title,artist\n"x, y",z'))
    # The texts, what Python split or folded (shapes by delimiter, cells of tables, items): nothing else is moved.
    assert 0 < len(seen) and sum(seen) <= 9


def test_counts_move_no_lines(spark):
    stats = X.extract(docs(spark, "A - B\nC - D\nplain words, not a song. No.", "title,artist\nx,y\nz,w")).stats
    assert stats._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    assert [(r.lines_total, r.lines_parsed, r.lines_residual, r.items_after_dedupe) for r in stats.orderBy("doc_id").collect()] == [(3, 2, 1, 2), (3, 2, 0, 2)]


def test_counts_are_those_of_the_items_without_making_them(spark, monkeypatch):
    made, dedupe = [], X.dedupe
    monkeypatch.setattr(X, "dedupe", lambda items: made.append(1) or dedupe(items))
    texts = ["Aphex Twin - Xtal\nAPHEX TWIN - XTAL!\nXtal\nA - Heroes\nB - Heroes\nHeroes\nx\ny\nz\nu\nv", "A - " + "t" * 301 + "\nC - D\nE - F", "", "!!! - Song\nB - C\nSong\nD - E\nF", "title,artist\nx,y\nX,Y\nx,"]
    e = X.extract(docs(spark, *texts))
    stats = {r.doc_id: r for r in e.stats.collect()}
    assert not made
    left = {r.doc_id: r["count"] for r in e.items.groupBy("doc_id").count().collect()}
    assert made and {d: r.items_after_dedupe for d, r in stats.items()} == {d: left.get(d, 0) for d in range(1, 6)}
    refused = {r.doc_id: r["count"] for r in e.rejected.groupBy("doc_id").count().collect()}
    assert refused == {2: 1} and {d: r.rejected for d, r in stats.items() if r.rejected} == refused
    assert all(r.items_before_dedupe + r.rejected == r.lines_parsed for r in stats.values()) and stats[5].items_before_dedupe == 3 and stats[5].items_after_dedupe == 1
