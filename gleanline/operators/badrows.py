"""Delimited text rows: good rows loaded, bad ones set apart with the reason."""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTING, COLUMNS, VALUE, DELIMITER = "quoting", "column_count", "invalid_value", "delimiter"
FIELDS = ["title", "artist", "album", "isrc", "duration", "year", "position"]
# What a cell of a typed field may hold.
PATTERNS = {
    "isrc": re.compile(r"[A-Za-z]{2}[A-Za-z0-9]{3}[0-9]{7}"),
    "duration": re.compile(r"(?:[0-9]{1,2}:)?[0-9]{1,3}:[0-5][0-9](?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?|\.[0-9]+"),
    "year": re.compile(r"(?:18[6-9][0-9]|19[0-9]{2}|2[01][0-9]{2}|2200)(?![0-9])(?:[-/. T].*)?"),
    "position": re.compile(r"0*[1-9][0-9]*"),
}
_INNER_RETURN = ""  # stands for a carriage return inside a line, which the reader would take for a line end


def valid(field: str, cell: str) -> bool:
    """Whether a cell's text is a value of its field; an empty cell is."""
    cell = cell.strip()
    if not cell or field not in PATTERNS:
        return True
    if field == "isrc":
        cell = cell.replace("-", "")
    if not PATTERNS[field].fullmatch(cell):
        return False
    return field != "duration" or ":" in cell or float(cell) > 0


def read_row(line: str, delim: str) -> list[str] | None:
    """The cells of one line by the strict reader, or None where its quoting is broken."""
    try:
        rows = list(csv.reader([line.replace("\r", _INNER_RETURN)], delimiter=delim, skipinitialspace=True, strict=True, doublequote=True))
    except csv.Error:
        return None
    return [cell.replace(_INNER_RETURN, "\r") for cell in (rows[0] if rows else [])]


def judge(line: str, delim: str, width: int, column_map: dict[str, int]) -> tuple[str | None, dict[str, str]]:
    """The first reason against a row and, for a good row, its cells by field."""
    if len(delim) != 1:
        return DELIMITER, {}
    cells = read_row(line, delim)
    if cells is None:
        return QUOTING, {}
    if len(cells) != width:
        return COLUMNS, {}
    values = {field: cells[at] for field, at in column_map.items() if 0 <= at < width}
    if not all(valid(field, cell) for field, cell in values.items()):
        return VALUE, {}
    return None, values


def table_lines(cases: DataFrame, specs: DataFrame) -> DataFrame:
    """``case_no, line_no, line`` and the layout of every row of every text that has one.

    Lines are split at line feeds; a closing carriage return, blank lines, and lines up to the header
    are no rows.  Rows whose delimiter is longer than a character can't be read and are set apart for it.  Texts without a spec, null and empty texts and specs without a delimiter or columns
    have no rows.  A spec repeated for a case counts once.
    """
    layout = specs.where("delim is not null and delim <> '' and column_map is not null").select(
        F.col("case_no").alias("spec_case"), "delim", F.coalesce("header_row", F.lit(-1)).alias("header_row"),
        F.array_sort(F.map_entries("column_map")).alias("layout"),
    ).distinct()
    # Texts find their spec before they are split, so texts without one are never taken apart.
    known = cases.select("case_no", "text").join(layout, F.col("case_no") == F.col("spec_case"))
    lines = known.select("case_no", "delim", "header_row", "layout", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", "\r$", "")).where(F.col("line").rlike(r"[^\s]"))
    return lines.where("line_no > header_row").select("case_no", "line_no", "line", "delim", "layout")


def parse_rows(cases: DataFrame, specs: DataFrame) -> DataFrame:
    """Every row of every delimited text: ``case_no, line_no, reason`` (null for good rows) and ``cells`` by field.

    Cells of fields beyond the known ones are kept too.  Empty tables give no rows.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            reasons, cells = [], []
            for line, delim, layout in zip(batch["line"], batch["delim"], batch["layout"], strict=True):
                columns = {entry["key"]: entry["value"] for entry in layout}
                reason, values = judge(line, delim, len(columns), columns)
                reasons.append(reason)
                cells.append(values)
            yield pd.DataFrame({"case_no": batch["case_no"], "line_no": batch["line_no"], "reason": reasons, "cells": cells})

    return table_lines(cases, specs).mapInPandas(parse, "case_no bigint, line_no int, reason string, cells map<string,string>")


def found(rows: DataFrame) -> DataFrame:
    """The rows that cannot be loaded."""
    return rows.where("reason is not null").select("case_no", "line_no", "reason")


def clock_ms(cell: Column) -> Column:
    """Milliseconds of a valid duration cell: a clock time or seconds, or milliseconds from 1,000 up."""
    parts = F.split(cell, ":")
    clock = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x.try_cast("double")) * 1000
    number = cell.try_cast("double")
    return F.rint(F.when(F.size(parts) > 1, clock).when(number >= 1000, number).otherwise(number * 1000)).cast("long")


def loaded(rows: DataFrame) -> DataFrame:
    """The good rows in typed columns; an empty cell is null."""
    cell = lambda name: F.nullif(F.trim(F.try_element_at("cells", F.lit(name))), F.lit(""))
    return rows.where("reason is null").select(
        "case_no", "line_no", cell("title").alias("title"), cell("artist").alias("artist"), cell("album").alias("album"),
        F.upper(F.regexp_replace(cell("isrc"), "-", "")).alias("isrc"), clock_ms(cell("duration")).alias("duration_ms"),
        F.substring(cell("year"), 1, 4).try_cast("int").alias("release_year"), cell("position").try_cast("int").alias("list_pos"),
    )
