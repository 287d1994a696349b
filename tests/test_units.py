import math
import random

import pytest
from pyspark.sql import functions as F

from gleanline.operators import units as U

SCHEMA = "tbl string, rec_id bigint, source string, period string, home string, number double, unit_text string, label string"


def labels(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "i int, t string")
    return [r[0] for r in frame.select("i", U.stated_ms(F.col("t")).alias("ms")).orderBy("i").select("ms").collect()]


def test_worded_lengths(spark):
    cases = {
        "4:05": 245000, "1:02:03": 3723000, "PT4M55S": 295000, "PT1H2M": 3720000, "119,5 s": 119500, "216,674 ms": 216674, "4 Min. 53 Sek.": 293000,
        "1 minutes, 36 seconds": 96000, "4m43s": 283000, "4min23": 263000, "1′59″": 119000, "4'50\"": 290000, "210\"": 210000, "5½ min": 330000, "0h 45m": 2700000,
        "2.75 h": 9900000, "12183 frames": 162440, "13397 fr (75/s)": 178626.667, "10495800 samples @ 44.1 kHz": 238000, "~5:05": 305000, "approx 3:19": 199000, "ca. 5:27": 327000,
    }
    for text, got in zip(cases, labels(spark, cases), strict=True):
        assert got == pytest.approx(cases[text], abs=0.01), text


def test_unreadable_words_are_no_lengths(spark):
    assert labels(spark, ["soon", "", "12 parsecs", "5:99:99:1", "217", None]) == [None] * 6


def recorded(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_units_found_per_source_and_over_time(spark):
    rng = random.Random(5)
    rows, truth = [], {}
    for i in range(3000):
        s = math.exp(rng.gauss(math.log(215), 0.33))
        source, month = rng.choice("abcd"), rng.choice(["2025-01", "2025-09"])
        unit = {"a": "ms", "b": "cs", "c": "min", "d": "s" if month < "2025-05" else "ms"}[source]
        rows.append(("t", i, source, month, "ms", round(s * 1000 / U.UNIT_MS[unit], 2), None, None))
        truth[i] = unit
    got = {r.rec_id: r.unit for r in U.resolve_lengths(recorded(spark, rows)).collect()}
    assert len(got) == len(rows) and sum(got[i] != truth[i] for i in truth) <= 3


def test_edges(spark):
    rows = [
        ("t", 1, None, None, "ms", None, None, None), ("t", 2, None, None, "ms", float("nan"), "s", None), ("t", 3, None, None, "ms", 0.0, None, None), ("t", 4, None, None, "ms", -5.0, None, None),
        ("t", 5, None, None, "ms", 200.5, "Sek.", "9:99"), ("t", 5, None, None, "ms", 200.5, "Sek.", "9:99"), ("t", 6, "x", None, "s", None, None, "4:00"), ("t", 7, "x", None, "s", None, None, "x" * 100000), ("t", 8, "x", None, "s", 1e300, None, None),
    ]
    out = U.resolve_lengths(recorded(spark, rows).withColumns({"unit": F.lit(1), "weights": F.lit(2), "value": F.lit("v")}))
    got = sorted((r.rec_id, r.length_ms, r.as_named) for r in out.collect())
    assert got == [(5, 200500, False), (5, 200500, False), (6, 240000, False)]


def test_empty(spark):
    assert U.resolve_lengths(recorded(spark, [])).count() == 0


def test_plain_numbers_in_the_fields_unit_are_no_cases(spark):
    rows = [("t", i, "f", "m", "s", 200.0 + i, None, None) for i in range(60)] + [("t", 100, "f", "m", "s", 210000.0, None, None)]
    lengths = U.resolve_lengths(recorded(spark, rows))
    assert [(r.rec_id, r.length_ms) for r in U.found(lengths).collect()] == [(100, 210000)]
