import pytest
from pyspark.sql import functions as F

from gleanline.operators import catalog as C
from gleanline.operators import extract as X

DOCS = [(1, "1. Ann Lee - Blue Room\n2. Bo Ray - Red Door\nand that was all of it"), (2, "Title,Artist\nBlue Room,Ann Lee\nRed Door,Bo Ray"), (3, "")]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, tmp_path_factory):
    """Plans of an extraction, those of its stored steps included, as Spark's default settings make them."""
    # Files have sizes from which joins are planned; rows made in memory have none.
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{folder}/docs")
    spark.createDataFrame([(1, "paste")], "doc_id long, source_kind string").write.parquet(f"{folder}/kinds")
    seen = {}
    cut = X.cut
    X.cut = lambda frame: (seen.setdefault("steps", []).append(plan_of(frame)), cut(frame))[1]
    try:
        out = X.extract(spark.read.parquet(f"{folder}/docs"), spark.read.parquet(f"{folder}/kinds"))
    finally:
        X.cut = cut
    return seen | {name: [plan_of(getattr(out, name))] for name in ("items", "rejected", "residual", "stats")}


def test_residual_broadcasts_no_table_that_grows_with_the_texts(plans):
    assert any("SortMergeJoin" in p for p in plans["residual"]) and not any("Broadcast" in p for p in plans["residual"])


def test_items_broadcast_no_table_that_grows_with_the_texts(plans):
    assert not any("Broadcast" in p for p in plans["steps"] + plans["items"] + plans["rejected"])


def test_covered_never_broadcasts_the_characters_of_the_texts(spark, tmp_path):
    spark.createDataFrame([(1, "ab"), (2, "aя"), (3, "я"), (4, ""), (5, None)], "text_id long, text string").write.parquet(f"{tmp_path}/texts")
    fonts = spark.createDataFrame([("latin", 32, 383), ("cyrillic", 32, 126), ("cyrillic", 1024, 1279)], "font string, low int, high int")
    got = C.covered_by(spark.read.parquet(f"{tmp_path}/texts"), fonts)
    joins = [line for line in plan_of(got).splitlines() if "Join [" in line and "Join [block#" not in line]
    assert len(joins) == 2 and not any("Broadcast" in line for line in joins)
    assert {tuple(r) for r in got.collect()} == {(1, "latin"), (1, "cyrillic"), (2, "cyrillic"), (3, "cyrillic")}


def test_stats_broadcast_no_table_that_grows_with_the_texts(plans):
    assert any("SortMergeJoin" in p for p in plans["stats"]) and not any("Broadcast" in p for p in plans["stats"])
