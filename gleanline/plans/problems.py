"""Queries of the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanline.operators import badrows, units
from gleanline.session import table


def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    recorded = units.recorded_lengths(table(spark, folder, "seed_row"), table(spark, folder, "candidate"), table(spark, folder, "list_line"))
    return units.resolve_lengths(recorded)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return units.found(_lengths(spark, folder))


def p1_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return _lengths(spark, folder).select("tbl", "rec_id", "length_ms", "unit", "how", "uncertain")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return badrows.parse_rows(table(spark, folder, "printed_case"), table(spark, folder, "table_spec"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return badrows.found(_rows(spark, folder))


def p5_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return badrows.loaded(_rows(spark, folder))


QUERIES = {f.__name__: f for f in (p1_found, p1_lengths, p5_found, p5_loaded)}
ORACLES: dict[str, str] = {}
