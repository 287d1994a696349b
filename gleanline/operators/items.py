"""What is done with extracted items and match results: review, alternates, views, batches, wire form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanline.functions import score as S

#: Confidence below which an image's reading is taken again elsewhere.
FALLBACK = 0.6
#: Items of one batch of a map over stored items.
BATCH = 200


def below(items: DataFrame, threshold: float = S.REVIEW) -> DataFrame:
    """Items surer than nothing but less sure than ``threshold``; a missing confidence is not below."""
    return items.where(F.col("confidence") < threshold)


def with_alternates(items: DataFrame, unsure: Column) -> DataFrame:
    """Items with ``alternate``: title and artist in each other's place where the reading is unsure and there is an artist."""
    swapped = F.struct(F.col("artist").alias("title"), F.col("title").alias("artist"))
    return items.withColumn("alternate", F.when(unsure & F.col("artist").isNotNull(), swapped))


def needs_fallback(documents: DataFrame, items: DataFrame, key: str, floor: float = FALLBACK) -> DataFrame:
    """``key, fallback`` of every document: no item at all, or one below the floor.  Items are aggregated before they meet."""
    least = items.groupBy(key).agg(F.min("confidence").alias("least"))
    return documents.select(key).join(least, key, "left").select(key, F.coalesce(F.col("least") < floor, F.lit(True)).alias("fallback"))


def view(items: DataFrame) -> DataFrame:
    """Items with ``item_key`` (their span) and ``shown`` (confidence as text); items without a span have no key."""
    at = lambda name: F.col(f"span.{name}").cast("string")
    key = F.when(F.col("span").isNotNull(), F.concat_ws("-", at("span_start"), at("span_end")))
    return items.withColumns({"item_key": key, "shown": F.when(F.col("confidence").isNotNull(), F.format_string("%.2f", "confidence"))})


def joined_text(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """``key, residual``: the lines of each text in their order, one below the other; a text's lines came from one row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return lines.where(F.col(text).isNotNull()).groupBy(key).agg(F.array_join(parts, "\n").alias("residual"))


def autonomous(results: DataFrame) -> DataFrame:
    """Match results with ``autonomous``: accepted outright and not unresolved between two readings."""
    return results.withColumn("autonomous", F.coalesce((F.col("verdict") == "auto_accept") & (F.col("outcome") != "unresolved"), F.lit(False)))


def wire(items: DataFrame, fields: list[str], sorted_lists: list[str]) -> DataFrame:
    """Items with ``wire``: the fields as JSON in order of name, lists that are sets in order of value, nulls kept."""
    none = F.array().cast("array<string>")
    shaped = [F.array_sort(F.array_distinct(F.coalesce(F.col(f), none))).alias(f) if f in sorted_lists else F.col(f) for f in sorted(fields)]
    return items.withColumn("wire", F.to_json(F.struct(*shaped), {"ignoreNullFields": "false"}))


def batches(rows: DataFrame, key: str, order: str, size: int = BATCH) -> DataFrame:
    """Rows with ``batch``: the number, from zero, of the ``size`` rows of their key that they go with.

    A window's rows are read in order, not held, so a hot key costs one sorted pass.
    """
    turn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("batch", F.floor((turn - 1) / size).cast("int"))


def beyond(rows: DataFrame, key: str, order: list[str], allowed: int) -> DataFrame:
    """The rows of each key after the first ``allowed``, with ``nth``."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") > allowed)


def first_where(rows: DataFrame, key: str, order: str, test: Column) -> DataFrame:
    """``key, first, n``: where in its order the first row of each key stands that passes; null if none does."""
    return rows.groupBy(key).agg(F.min(F.when(test, F.col(order))).alias("first"), F.count("*").alias("n"))


def census(rows: DataFrame, key: str, allowance: int) -> DataFrame:
    """``key, n, over``: rows of each key, and how many are beyond the allowance."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("over", F.greatest(F.lit(0), F.col("n") - allowance))


def truth_of(expected: Column) -> Column:
    """The expected pairs that say something: those with a title."""
    return F.filter(expected, lambda x: x["title"].isNotNull() & (x["title"] != ""))


def first_of(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key for a report, with ``nth``; Spark keeps only those while it sorts."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= n)


def sampled(rows: DataFrame, key: str, identity: str, n: int, seed: str = "sample") -> DataFrame:
    """``n`` rows of each key drawn without replacement, the same every time: those with the least digests of seed and identity."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(identity).cast("string")).cast("binary"))
    return first_of(rows.withColumn("drawn", digest), key, ["drawn", identity], n).drop("drawn")
