"""Texts and lines of any length: queries take every row of their table."""

import pytest

import __spark_entry__ as entry
from gleanline.operators import lines as L


@pytest.fixture
def run(spark, tmp_path):
    """A query's rows over a table of these texts, numbered from 1."""

    def rows(name, *texts):
        spark.createDataFrame(list(enumerate(texts, 1)), "case_no bigint, text string").write.mode("overwrite").parquet(f"{tmp_path}/printed_case.parquet")
        return entry.queries()[name](spark, str(tmp_path)).collect()

    return rows


def test_lines_left_over_of_texts_beyond_the_size_cap(run):
    prose = [f"line {i} holds far too many words to be an entry of any list of songs" for i in range(2000)]
    assert len("\n".join(prose)) > L.MAX_BYTES
    got = {(r.doc_id, r.line_no): (r.line, r.line_offset) for r in run("f8_residual", "\n".join(prose), prose[0])}
    starts = [sum(len(line) + 1 for line in prose[:i]) for i in range(len(prose))]
    assert got == {(1, i): (line, starts[i]) for i, line in enumerate(prose)} | {(2, 0): (prose[0], 0)}


def test_items_of_texts_beyond_the_size_cap(run):
    entries = [f"{i % 900 + 1}. Band of {i} - Song of {i}" for i in range(5000)]
    table = ["artist,title", *(f"Group {i},Tune {i}" for i in range(7000))]
    assert min(len("\n".join(entries)), len("\n".join(table))) > L.MAX_BYTES
    got = {(r.doc_id, r.title, r.artist, r.parser) for r in run("x0_extract_items", "\n".join(entries), "\n".join(table), "A - B")}
    assert got == {(1, f"Song of {i}", f"Band of {i}", "dash") for i in range(5000)} | {(2, f"Tune {i}", f"Group {i}", "csv") for i in range(7000)} | {(3, "B", "A", "dash")}


def test_counts_of_texts_beyond_the_size_cap(run):
    entries = "\n".join(f"Band of {i % 4000} - Song of {i % 4000}" for i in range(5000))
    accents = "é - è\n" * 17000
    assert L.MAX_BYTES < len(entries) and len(accents) <= L.MAX_BYTES < len(accents.encode())
    got = {r.doc_id: (r.lines_total, r.lines_parsed, r.lines_residual, r.items_before_dedupe, r.items_after_dedupe, r.rejected, r.coverage) for r in run("x0_extract_stats", entries, accents, "A - B", "x" * 200000, None)}
    assert got == {1: (5000, 5000, 0, 5000, 4000, 0, 1.0), 2: (17000, 17000, 0, 17000, 1, 0, 1.0), 3: (1, 1, 0, 1, 1, 0, 1.0), 4: (1, 0, 1, 0, 0, 0, 0.0)}


LONG = {
    "one word after a dash": ("A - " + "x" * 120000, (1, 1, 0, 0, 0, 1)), "words after a dash": ("A - " + "word " * 24000, (1, 0, 1, 0, 0, 0)), "bullets": ("- " * 60000 + "x", (1, 0, 1, 0, 0, 0)),
    "annotations in brackets": ("A - B " + "(live) " * 18000, (1, 1, 0, 0, 0, 1)), "annotations after dashes": ("A" + " - live" * 18000, (1, 1, 0, 0, 0, 1)), "few words, one long": ("a b c d " + "x" * 120000, (1, 0, 1, 0, 0, 0)),
    "brackets never closed": ("A - B " + "(" * 120000, (1, 1, 0, 0, 0, 1)), "empty lines": ("A - B" + "\n" * 600000 + "C - D", (600001, 2, 0, 2, 2, 0)),
}


def test_long_lines_end(run):
    """Patterns that loop over alternatives end the process by Java's stack at a few thousand characters, and the session with it."""
    got = {r.doc_id: (r.lines_total, r.lines_parsed, r.lines_residual, r.items_before_dedupe, r.items_after_dedupe, r.rejected) for r in run("x0_extract_stats", *[text for text, _ in LONG.values()])}
    assert {what: got[i] for i, what in enumerate(LONG, 1)} == {what: counts for what, (_, counts) in LONG.items()}
