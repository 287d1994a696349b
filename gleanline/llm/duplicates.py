"""Duplicates hidden by formatting: one record each, with its number of copies.

Byte-identical raw rows collapse first, with counts; only distinct survivors are brought to
canonical text, and they are grouped again on all of it, summing the counts.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleanline.session import cut

#: Text that the built-in functions can't compose: combining marks and compatibility forms.
_COMPOSE = r"[\p{M}\x{FB00}-\x{FB4F}\x{FF00}-\x{FFEF}\x{2100}-\x{218F}\x{2460}-\x{24FF}\x{1D400}-\x{1D7FF}]"


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def compact(text: Column) -> Column:
    """Letters and digits of a text in order, without case: 'Grüße, Straße!' and 'GRÜSSE STRASSE' are one."""
    bare = F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}]+", "")  # stands between the two, which the optimizer would make one
    return F.translate(F.lower(bare), "ς", "σ")


def canonical(rows: DataFrame) -> DataFrame:
    """``rows`` with ``key``, the canonical text of ``title`` and ``artist``.

    Both present: the two in sorted order, so that changed places are one record.  One missing: it stays
    in its place, so a missing artist equals only a missing artist.  An empty text is not a missing one.
    One pass: only texts with characters to compose leave the JVM, the others go as nulls.
    """
    odd = lambda name: F.coalesce(F.col(name).rlike(_COMPOSE), F.lit(False))
    text = lambda name: F.coalesce(_composed(F.when(odd(name), F.col(name))), F.col(name))
    bare = rows.withColumns({"a": text("title"), "b": text("artist")}).withColumns({"a": compact(F.col("a")), "b": compact(F.col("b"))})
    cell = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    key = F.when(both, F.concat_ws("\u0001", F.least("a", "b"), F.greatest("a", "b"))).otherwise(F.concat_ws("\u0001", cell(F.col("a")), F.lit("-"), cell(F.col("b"))))
    return bare.withColumn("key", key).drop("a", "b")


def collapse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw survivors (``list_id, title, artist, key, first_id, copies``) and records (``list_id, key, first_line_id, copies``).

    Null lists are one list; null titles and artists are values of their own; repeated rows count as copies.
    """
    raw = lines.groupBy("list_id", "title", "artist").agg(F.min("line_id").alias("first_id"), F.count("*").alias("copies"))
    survivors = canonical(raw)
    records = survivors.groupBy("list_id", "key").agg(F.min("first_id").alias("first_line_id"), F.sum("copies").alias("copies"))
    return survivors, records


def found(lines: DataFrame) -> DataFrame:
    """``first_line_id, copy_line_id``: a row for each further copy of a record.

    Only survivors have a canonical text: they find their record by list and key, and the raw lines find
    their survivor by list, title and artist as they stand.  Survivors that are the only line of their
    record take no part in the joins.  A hot list or record is a skewed join side, which adaptive execution
    splits, not a group in one task.
    """
    survivors, _ = collapse(lines)
    survivors = cut(survivors.select("list_id", "title", "artist", "key", "first_id", "copies"))
    records = survivors.groupBy("list_id", "key").agg(F.min("first_id").alias("first_line_id"), F.sum("copies").alias("n"))
    repeated = records.where("n > 1").select(F.col("list_id").alias("of_list"), F.col("key").alias("of_key"), "first_line_id")
    homes = survivors.join(repeated, F.col("list_id").eqNullSafe(F.col("of_list")) & (F.col("key") == F.col("of_key")))
    single = homes.where("copies = 1").select("first_line_id", F.col("first_id").alias("copy_line_id"))
    several = homes.where("copies > 1").select(F.col("list_id").alias("of_l"), F.col("title").alias("of_t"), F.col("artist").alias("of_a"), "first_line_id")
    raw = lines.select("line_id", "list_id", "title", "artist")
    same = F.col("list_id").eqNullSafe(F.col("of_l")) & F.col("title").eqNullSafe(F.col("of_t")) & F.col("artist").eqNullSafe(F.col("of_a"))
    of_several = raw.join(several, same).select("first_line_id", F.col("line_id").alias("copy_line_id"))
    return single.unionByName(of_several).where("first_line_id <> copy_line_id")
