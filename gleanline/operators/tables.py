"""Whole documents recognised as delimited tables, and their rows read."""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gleanline.functions import text as T
from gleanline.functions.normalize import fold, peel_title
from gleanline.session import merged, placed

# Fixed values of table detection.
DELIMITERS = [",", "\t", ";", "|"]
ALIASES = {
    "title": ["title", "track", "song", "name", "track name", "song title", "track title", "song name", "titel"],
    "artist": ["artist", "artists", "performer", "band", "artist name", "album artist", "artiste", "by"],
    "album": ["album", "release", "album name"],
    "isrc": ["isrc", "isrc code"],
    "duration": ["duration", "length", "time", "runtime", "duration ms", "duration s", "track duration"],
    "year": ["year", "released", "release year", "release date", "date"],
}
MIN_ROWS, MAX_COLUMNS, TYPED_SHARE, INFER_ROWS, MARGIN, MS_FROM = 2, 24, 0.8, 5, 0.2, 1000
TYPED = {
    "isrc": r"^[A-Za-z]{2}[A-Za-z0-9]{3}[-\s]?\d{2}[-\s]?\d{5}$",
    "duration": r"^(?:\d{1,2}:)?\d{1,2}:[0-5]\d$",
    "year": r"^(?:1[89]\d{2}|20\d{2}|21\d{2})$",
}
YEAR = r"(?<![\p{L}\p{N}_])(1[89]\d{2}|20\d{2}|21\d{2})(?![\p{L}\p{N}_])"


def split_row(line: Column, delimiter: Column) -> Column:
    """Cells of one physical line by lenient CSV rules, without white space around them.

    Lines without a quote are split in the JVM; the others by the CSV reader, in Arrow batches.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        csv.field_size_limit(sys.maxsize)
        for lines, delimiters in batches:
            yield pd.Series([None if l is None else [c.strip() for c in next(csv.reader([l.replace("\r", " ")], delimiter=d, skipinitialspace=True), [])] for l, d in zip(lines, delimiters, strict=True)], dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    quoted = F.contains(line, F.lit('"'))
    pieces = F.transform(F.split(line, F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E")), -1), T.strip)
    return F.when(line.isNull(), None).when(~quoted, pieces).otherwise(F.pandas_udf(run, ArrayType(StringType()))(F.when(quoted, line), delimiter))


def alias_table(spark) -> DataFrame:
    """Header labels and the fields they name; a fixed table of some thirty rows."""
    return spark.createDataFrame([(label, field) for field, labels in ALIASES.items() for label in labels], "label string, field string")


def header_fields(cells: Column) -> Column:
    """map<field, index> of a row's folded labels; the first label of a field counts."""
    names = F.create_map(*[F.lit(x) for field, labels in ALIASES.items() for label in labels for x in (label, field)])
    numbered = F.transform(cells, lambda c, i: F.struct(F.try_element_at(names, T.fold_ascii(c)).alias("field"), i.alias("at")))
    hits = F.filter(numbered, lambda h: h["field"].isNotNull())
    first = F.filter(hits, lambda h: F.array_position(F.transform(hits, lambda x: x["field"]), h["field"]) == F.array_position(hits, h))
    return F.map_from_entries(first)


def candidate_rows(triaged: DataFrame) -> DataFrame:
    """Content lines by each delimiter they hold: ``doc_id, line_no, rank, delim, width``."""
    tries = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(d).alias("delim")) for i, d in enumerate(DELIMITERS)])
    # A line without the delimiter is one cell, and no document with such a line is a table by it: it needs no row.
    held = F.filter(tries, lambda t: F.contains(F.col("line"), t["delim"]))
    rows = triaged.where("not noise").select("doc_id", "line_no", "line", F.inline(held))
    return rows.select("doc_id", "line_no", "rank", "delim", F.size(split_row(F.col("line"), F.col("delim"))).alias("width"))


def table_rows(triaged: DataFrame, layout: DataFrame) -> DataFrame:
    """Content lines of the documents in ``layout`` with its columns and their ``cells``, split by the document's ``delim``."""
    return triaged.where("not noise").join(merged(layout), "doc_id").withColumn("cells", split_row(F.col("line"), F.col("delim")))


def detect(triaged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layouts and rows of the documents that are tables.

    Layout: ``doc_id, delim, width, header_line, columns map<field,int>, ambiguous``; a document is a
    table by the first delimiter that gives all its content lines the same width of 2 to 24 cells.
    Rows: ``doc_id, line_no, cells``.
    """
    rows = candidate_rows(triaged)
    shapes = rows.groupBy("doc_id", "rank", "delim").agg(F.count("*").alias("n"), F.min("width").alias("width"), F.max("width").alias("widest"), F.min("line_no").alias("first"))
    content = triaged.where("not noise").groupBy("doc_id").agg(F.count("*").alias("content"))
    # No equality beyond that of documents, else the joins would shuffle by it: there are no more rows than content lines, and none before the first.
    fits = shapes.join(merged(content), "doc_id").where((F.col("n") >= MIN_ROWS) & (F.col("n") >= F.col("content")) & (F.col("width") == F.col("widest")) & F.col("width").between(2, MAX_COLUMNS))
    chosen = placed(fits.groupBy("doc_id").agg(F.min(F.struct("rank", "delim", "width", "first")).alias("c")).select("doc_id", "c.delim", "c.width", "c.first"))
    own = table_rows(triaged.select("doc_id", "line_no", "line", "noise"), chosen)
    heads = own.where("line_no <= first").select("doc_id", header_fields(F.col("cells")).alias("head"))
    has_title = F.map_contains_key("head", F.lit("title")) | (F.map_contains_key("head", F.lit("artist")) & (F.size("head") >= 2))
    heads = heads.withColumn("is_header", F.coalesce(has_title, F.lit(False)))
    cells = own.select("doc_id", F.posexplode("cells").alias("at", "cell")).where("cell <> ''")
    stats = cells.withColumn("key", fold(F.col("cell"))).groupBy("doc_id", "at").agg(
        F.count("*").alias("n"), F.countDistinct("key").alias("distinct_n"), *[F.avg(F.col("cell").rlike(p).cast("int")).alias(f"is_{f}") for f, p in TYPED.items()]
    )
    columns = stats.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "n", "distinct_n", "is_isrc", "is_duration", "is_year"))).alias("cols"))  # at most 24 a document
    at_type = lambda f: F.element_at(F.transform(F.filter("cols", lambda c: c[f"is_{f}"] >= TYPED_SHARE), lambda c: c["at"]), 1)
    first_of = lambda f: F.when(F.exists("cols", lambda c: c[f"is_{f}"] >= TYPED_SHARE), at_type(f))
    spec = chosen.join(merged(heads), "doc_id").join(merged(columns), "doc_id", "left")
    spec = spec.withColumns({f"at_{f}": first_of(f) for f in TYPED})
    free = F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda i: ~F.coalesce(i == F.col("at_isrc"), F.lit(False)) & ~F.coalesce(i == F.col("at_duration"), F.lit(False)) & ~F.coalesce(i == F.col("at_year"), F.lit(False)))
    spec = spec.withColumn("free", free)
    one = lambda k: F.try_element_at("free", F.lit(k))
    stat = lambda at: F.try_element_at(F.filter("cols", lambda c: c["at"] == at), F.lit(1))
    a, b = stat(one(1)), stat(one(2))
    spread = lambda s: s["distinct_n"] / s["n"]
    enough = F.coalesce(F.least(a["n"], b["n"]) >= INFER_ROWS, F.lit(False))
    second_artist = enough & (spread(b) + MARGIN < spread(a))
    first_artist = enough & (spread(a) + MARGIN < spread(b))
    pair = one(2).isNotNull()
    inferred = F.map_from_entries(F.filter(F.array(
        *[F.struct(F.lit(f).alias("k"), F.col(f"at_{f}").alias("v")) for f in TYPED],
        F.struct(F.lit("artist").alias("k"), F.when(pair, F.when(second_artist, one(2)).otherwise(one(1))).alias("v")),
        F.struct(F.lit("title").alias("k"), F.when(pair, F.when(second_artist, one(1)).otherwise(one(2))).otherwise(F.coalesce(one(1), F.lit(0))).alias("v")),
        F.struct(F.lit("album").alias("k"), one(3).alias("v")),
    ), lambda e: e["v"].isNotNull()))
    layout = spec.select(
        "doc_id", "delim", "width", F.when(F.col("is_header"), F.col("first")).alias("header_line"),
        F.when(F.col("is_header"), F.col("head")).otherwise(inferred).alias("columns"),
        (~F.col("is_header") & ~(pair & (first_artist | second_artist))).alias("ambiguous"),
    )
    return layout, own.select("doc_id", "line_no", "cells")


def cell_seconds(cell: Column) -> Column:
    """Seconds of a length cell: a clock time, milliseconds from 1,000 up, or seconds."""
    number = cell.try_cast("double")
    return F.coalesce(T.clock_seconds(cell), F.when(number > 0, F.when(number >= MS_FROM, number / 1000.0).otherwise(number)))


def read_rows(layout: DataFrame, rows: DataFrame) -> DataFrame:
    """Matches of table rows: ``doc_id, line_no, m`` with a struct like a line parser's, and the row's hints.

    The header line and rows without a title are none.
    """
    return read_cells(rows.join(merged(layout), "doc_id"))


def read_cells(rows: DataFrame, *keep: str) -> DataFrame:
    """As ``read_rows``, of rows that have their layout's columns already; columns in ``keep`` stay."""
    joined = rows.where("header_line is null or line_no <> header_line")
    cell = lambda f: F.nullif(F.try_element_at("cells", F.try_element_at("columns", F.lit(f)) + 1), F.lit(""))
    read = joined.select("doc_id", "line_no", *keep, "header_line", "ambiguous", *[cell(f).alias(f) for f in ALIASES]).where("title is not null")
    # By a generator of one row, as in parse: named further up, the peeling would be repeated.
    peeled = F.inline(F.array(F.struct(peel_title(F.col("title")).alias("p"), T.credits(F.col("artist")).alias("c"))))
    read = read.select("*", peeled).where("p.base <> ''")
    none = F.array().cast("array<string>")
    return read.select(
        "doc_id", "line_no", *keep, F.col("p.base").alias("title"), F.nullif(F.col("c.primary"), F.lit("")).alias("artist"),
        F.when(F.col("header_line").isNotNull() | ~F.col("ambiguous"), "csv").otherwise("csv_headerless").alias("parser"), "ambiguous",
        F.array_distinct(F.concat("p.featured", F.coalesce("c.featured", none))).alias("featured"), "p.qualifiers", "p.version_label",
        "album", T.isrc(F.col("isrc")).alias("isrc"), cell_seconds(F.col("duration")).alias("duration_s"),
        F.nullif(F.regexp_extract("year", YEAR, 1), F.lit("")).try_cast("int").alias("release_year"), (F.col("line_no") + 1).alias("position"),
    )
