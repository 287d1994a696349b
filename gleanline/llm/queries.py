"""Queries of this subpackage's operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanline.llm import confusables, duplicates, linkage, mixture, mojibake, names, tokens
from gleanline.session import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.found(table(spark, folder, "typed_artist"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return names.classes(table(spark, folder, "typed_artist"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.found(table(spark, folder, "list_line"))


def p3_records(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.collapse(table(spark, folder, "list_line"))[1].select("list_id", "first_line_id", "copies")


def _fields(spark: SparkSession, folder: str) -> DataFrame:
    return confusables.fields(table(spark, folder, "seed_row"), table(spark, folder, "printed_case"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return confusables.found(_fields(spark, folder))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return confusables.groups(_fields(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return linkage.found(table(spark, folder, "match_input"), table(spark, folder, "candidate"))


def p6_links(spark: SparkSession, folder: str) -> DataFrame:
    return linkage.link(table(spark, folder, "match_input"), table(spark, folder, "candidate"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p8_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.corpus(table(spark, folder, "documents"), table(spark, folder, "mix_target"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.shares(table(spark, folder, "documents"), table(spark, folder, "mix_target"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.found(table(spark, folder, "documents"))


def p9_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.repaired(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p2_found, p2_classes, p3_found, p3_records, p4_found, p4_groups, p6_found, p6_links, p7_ids, p8_corpus, p8_shares, p9_found, p9_repaired)
}

# What counts as equal for problem 3, in SQL: letters and digits without case.
_BARE = "regexp_replace(lower(upper(replace({0}, 'ß', 'ss'))), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_KEYED = f"""
keyed as (
  select line_id, list_id, replace({_BARE.format('title')}, 'ς', 'σ') as a, replace({_BARE.format('artist')}, 'ς', 'σ') as b from list_line
), recs as (
  select line_id, list_id,
    case when a is not null and b is not null then least(a, b) || chr(1) || greatest(a, b)
         else coalesce('=' || a, '-') || chr(1) || '-' || chr(1) || coalesce('=' || b, '-') end as rec
  from keyed
), firsts as (
  select list_id, rec, min(line_id) as first_line_id, cast(count(*) as bigint) as copies from recs group by list_id, rec
)"""

ORACLES: dict[str, str] = {
    "p3_found": f"with {_KEYED} select f.first_line_id, r.line_id as copy_line_id from recs r join firsts f on r.list_id is not distinct from f.list_id and r.rec = f.rec where r.line_id <> f.first_line_id",
    "p3_records": f"with {_KEYED} select list_id, first_line_id, copies from firsts",
}
