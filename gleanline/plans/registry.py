"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanline.plans import entities, lines, more, problems

FLAGSHIP = "g1_daily_rollup"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (lines, entities, more, problems):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
