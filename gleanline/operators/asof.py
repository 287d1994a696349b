"""Joins by position: the nearest row before, and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_before(left: DataFrame, right: DataFrame, key: str, at: str, value: str, step: float) -> DataFrame:
    """``left`` with ``value`` of the right row of the same key at the same position or the nearest before; null where there is none.

    Rows meet within stretches of ``step`` positions; a stretch's carry-in is the last value of an earlier
    one, from a table with a row a stretch.  So a hot key is as many tasks as it has stretches.  Of right
    rows at one position the greatest value counts; left rows keep their number.
    """
    none = F.lit(None)
    right = right.where(F.col(at).isNotNull()).groupBy(key, at).agg(F.max(value).alias(value))
    bin_of = F.floor(F.col(at) / step)
    l = left.withColumns({"_bin": bin_of, "_side": F.lit(1), "_v": none.cast(dict(right.dtypes)[value])})
    r = right.select(key, at, F.col(value).alias("_v"), bin_of.alias("_bin"), F.lit(0).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    inside = Window.partitionBy(key, "_bin").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1")
    ends = r.groupBy(key, "_bin").agg(F.max_by("_v", at).alias("_last"))
    bins = l.select(key, "_bin").distinct().join(ends, [key, "_bin"], "full_outer")
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).select(key, "_bin", "_carry")
    joined = seen.join(carried, [key, "_bin"], "left")
    return joined.withColumn(value, F.coalesce("_seen", "_carry")).select(*left.columns, value)
