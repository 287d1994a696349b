"""Queries of the line, parser and extraction operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.functions import normalize as N
from gleanline.functions import text as T
from gleanline.operators import extract as X
from gleanline.operators import lines as L
from gleanline.operators import parse as P
from gleanline.operators import tables as TB
from gleanline.plans.sql import fold
from gleanline.session import table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "printed_case").select(F.col("case_no").alias("doc_id"), "text")


def s1_admit(spark: SparkSession, folder: str) -> DataFrame:
    good, big = L.admit(_docs(spark, folder), 2000)
    return good.select("doc_id", F.lit(True).alias("admitted"), T.utf8_length(F.col("text")).alias("n_bytes")).unionByName(big.select("doc_id", F.lit(False).alias("admitted"), "n_bytes"))


def f1_split_lines(spark: SparkSession, folder: str) -> DataFrame:
    return L.split_lines(_docs(spark, folder))


def f2_noise(spark: SparkSession, folder: str) -> DataFrame:
    return L.split_lines(_docs(spark, folder)).select("doc_id", "line_no", L.is_noise(F.col("line")).alias("noise"))


def f3_sentence_break(spark: SparkSession, folder: str) -> DataFrame:
    return L.split_lines(_docs(spark, folder)).select("doc_id", "line_no", L.has_sentence_break(F.col("line")).alias("breaks"))


def f5_list_shape(spark: SparkSession, folder: str) -> DataFrame:
    return L.list_shape(L.triage(L.split_lines(_cases(spark, folder))))


def f7_first_content(spark: SparkSession, folder: str) -> DataFrame:
    lines = L.split_lines(_docs(spark, folder)).withColumn("noise", L.is_noise(F.col("line")))
    return lines.groupBy("doc_id").agg(F.coalesce(F.min(F.when(~F.col("noise"), F.col("line_no"))), F.lit(0)).alias("first_content"))


def n1_normalized(spark: SparkSession, folder: str) -> DataFrame:
    text = N.normalize_document(F.col("text"))
    return _docs(spark, folder).select("doc_id", F.char_length("text").alias("raw_length"), F.sha2(text, 256).alias("digest"), F.char_length(T.strip(text)).alias("length"))


def n4_fold(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "seed_row").select("row_id", N.fold(F.col("title")).alias("ftitle"), N.fold(F.col("artist")).alias("fartist"))


def n5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    folded = table(spark, folder, "customer").select("c_custkey", T.fold_ascii(F.col("c_name")).alias("f"))
    return folded.select("c_custkey", "f", F.size(T.tokens(F.col("f"))).alias("n"))


def n6_split_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidate").select("candidate_id", F.posexplode(T.split_names(F.col("artist"))).alias("pos", "name"))


def n7_peeled(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidate").select("candidate_id", N.peel_title(F.col("title")).alias("p"))
    return rows.select("candidate_id", "p.base", F.array_join("p.qualifiers", ",").alias("qualifiers"), F.array_join("p.featured", ",").alias("featured"), "p.version_label")


def n9_artist(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "list_line").select("line_id", T.artist(F.col("artist")).alias("artist"))


def n12_isrc(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "list_line").select("line_id", T.isrc(F.col("hints.isrc")).alias("isrc"))


def n13_clock(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "list_line").select("line_id", T.clock_seconds(F.col("hints.duration_s")).alias("seconds"))


def _recording_key(rows: DataFrame, fold: Callable[[Column], Column]) -> DataFrame:
    return rows.select("line_id", T.recording_key(fold(F.col("title")), fold(F.col("artist")), F.col("hints.qualifiers")).alias("key"))


def n14_recording_key(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of every line with a title."""
    return _recording_key(table(spark, folder, "list_line").where("title is not null"), N.fold)


def n19_copies(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "list_line").select("line_id", (1 + F.size(F.coalesce("duplicates", F.array().cast("array<struct<span_start:int,span_end:int>>")))).alias("mentions"))


def n21_non_latin(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "seed_row").select("row_id", T.has_non_latin(F.col("title")).alias("non_latin"))


def n25_words(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).where("text is not null").select("doc_id", T.word_count(F.col("text")).alias("n_words"), F.char_length(T.collapse(F.col("text"))).alias("n_collapsed"))


def _keys(rows: DataFrame, fold: Callable[[Column], Column]) -> DataFrame:
    key = F.coalesce(T.isrc_key(F.col("isrc")), T.text_key(fold(F.col("title")), fold(F.col("artist"))))
    return rows.select("input_id", key.alias("cache_key")).distinct().withColumn("neutral", T.is_neutral_key(F.col("cache_key")))


def n26_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of every input with a title or a code."""
    return _keys(table(spark, folder, "match_input").where(F.col("title").isNotNull() | T.isrc(F.col("isrc")).isNotNull()), N.fold)


def n34_month(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", T.month_start(F.col("ts")).cast("date").alias("month"))


def a10_parsed_lines(spark: SparkSession, folder: str) -> DataFrame:
    parsed = P.parse_lines(L.triage(L.split_lines(_cases(spark, folder))))
    return parsed.select("doc_id", "line_no", "position", "timestamp_s", "duration_s", "isrc", "strict.title", "strict.artist", "strict.parser", "strict.ambiguous", F.col("bare.title").alias("bare_title"))


def a6_dash_sides(spark: SparkSession, folder: str) -> DataFrame:
    lines = L.split_lines(_docs(spark, folder)).select("doc_id", "line_no", P.dash_sides(F.col("line")).alias("sides")).where("sides is not null")
    return lines.select("doc_id", "line_no", F.element_at("sides", 1).alias("left_side"), F.element_at("sides", 2).alias("right_side"))


def t3_tables(spark: SparkSession, folder: str) -> DataFrame:
    layout, _ = TB.detect(L.triage(L.split_lines(_cases(spark, folder))))
    return layout.select("doc_id", "delim", "width", "header_line", F.to_json("columns").alias("columns"), "ambiguous")


def t7_table_rows(spark: SparkSession, folder: str) -> DataFrame:
    layout, rows = TB.detect(L.triage(L.split_lines(_cases(spark, folder))))
    return TB.read_rows(layout, rows).select("doc_id", "line_no", "title", "artist", "parser", "isrc", "duration_s", "release_year", "position")


def x0_extract_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items of every text, whatever its size."""
    return X.extract(_cases(spark, folder), limit=None).items.select("doc_id", "title", "artist", "parser", "confidence", "position", "isrc", "duration_s", "first_start", F.size("duplicates").alias("n_duplicates"))


def f8_residual(spark: SparkSession, folder: str) -> DataFrame:
    """Lines left over of every text, whatever its size."""
    return X.extract(_cases(spark, folder), limit=None).residual


def x0_extract_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every text, whatever its size."""
    return X.extract(_cases(spark, folder), limit=None).stats


def r4_orientation(spark: SparkSession, folder: str) -> DataFrame:
    cases = table(spark, folder, "printed_case")
    matches = P.parse_lines(L.triage(L.split_lines(_cases(spark, folder)))).where("strict is not null").select("doc_id", "line_no", "strict.*")
    kinds = cases.select(F.col("case_no").alias("doc_id"), F.when(F.col("source") == "exported CSV", "file").otherwise("paste").alias("source_kind"))
    return X.orientation(matches, kinds)


def g3_dedupe_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of parsed lines deduplicated: one item a recording."""
    rows = table(spark, folder, "list_line")
    none = F.array().cast("array<string>")
    items = rows.where("title is not null").select(
        F.col("list_id").alias("doc_id"), "title", "artist", N.fold(F.col("title")).alias("ftitle"), N.fold(F.col("artist")).alias("fartist"), "parser", "confidence",
        F.col("span.span_start").alias("span_start"), F.col("span.span_end").alias("span_end"), F.lit(False).alias("emit_alternate"),
        F.col("hints.album").alias("album"), T.isrc(F.col("hints.isrc")).alias("isrc"), T.clock_seconds(F.col("hints.duration_s")).alias("duration_s"), F.col("hints.release_year").alias("release_year"),
        F.col("hints.version_label").alias("version_label"), F.col("hints.list_pos").alias("position"), F.col("hints.timestamp_s").cast("int").alias("timestamp_s"),
        F.coalesce("hints.featured_artists", none).alias("featured"), F.array_sort(F.array_distinct(F.coalesce("hints.qualifiers", none))).alias("qualifiers"),
    )
    return X.dedupe(items).select("doc_id", "title", "artist", "confidence", "isrc", "span_start", "first_start", F.size("duplicates").alias("n_duplicates"))


QUERIES = {
    f.__name__: f
    for f in (
        s1_admit, f1_split_lines, f2_noise, f3_sentence_break, f5_list_shape, f7_first_content, n1_normalized, n4_fold, n5_token_counts, n6_split_names, n7_peeled, n9_artist, n12_isrc,
        n13_clock, n14_recording_key, n19_copies, n21_non_latin, n25_words, n26_keys, n34_month, a10_parsed_lines, a6_dash_sides, t3_tables, t7_table_rows, x0_extract_items,
        x0_extract_stats, f8_residual, r4_orientation, g3_dedupe_lines,
    )
}

_LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from documents where text is not null)"
_SP = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_SP}]+', ' ', 'g'))"


_NOISE = (
    "(not regexp_matches(line, '[\\p{L}\\p{N}]') or regexp_matches(line, '^\\s*[-=*_~]{3,}\\s*$') or regexp_matches(line, '^\\s*#{1,6}\\s+\\S') or regexp_matches(line, '^\\s*(?:```|~~~)')"
    " or regexp_matches(line, '^\\s*\\|?[\\s:|-]*\\|[\\s:|-]*$') or regexp_matches(line, '(?i)^\\s*<?(?:https?://|www\\.)\\S+>?\\s*$') or regexp_matches(line, '^\\s*<[^>]+>\\s*$')"
    " or regexp_matches(line, '^\\s*\\S[^:]{0,40}:\\s*$'))"
)

ORACLES = {
    "s1_admit": "select doc_id, octet_length(encode(text)) <= 2000 as admitted, cast(octet_length(encode(text)) as int) as n_bytes from documents where text is not null",
    "f1_split_lines": f"with {_LINES} select doc_id, cast(line_no as int) as line_no, line, cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as bigint) as line_offset from lines",
    "f2_noise": f"with {_LINES} select doc_id, cast(line_no as int) as line_no, {_NOISE} as noise from lines",
    "f7_first_content": f"with {_LINES} select doc_id, cast(coalesce(min(line_no) filter (where not {_NOISE}), 0) as int) as first_content from lines group by doc_id",
    "n4_fold": f"select row_id, {fold('title')} as ftitle, {fold('artist')} as fartist from seed_row",
    "n5_token_counts": f"select c_custkey, {fold('c_name')} as f, cast(len(string_split({fold('c_name')}, ' ')) as int) as n from customer",
    "n12_isrc": r"select line_id, case when regexp_full_match(upper(regexp_replace(hints.isrc, '[\s\-]+', '', 'g')), '[A-Z]{2}[A-Z0-9]{3}[0-9]{7}') then upper(regexp_replace(hints.isrc, '[\s\-]+', '', 'g')) end as isrc from list_line",
    "n13_clock": r"with d as (select line_id, trim(hints.duration_s) as d from list_line) select line_id, case when regexp_full_match(d, '(?:\d{1,2}:)?\d{1,3}:[0-5]\d') then case when len(string_split(d, ':')) = 3 then cast(string_split(d, ':')[1] as double) * 3600 else 0 end + cast(string_split(d, ':')[-2] as double) * 60 + cast(string_split(d, ':')[-1] as double) end as seconds from d",
    "n14_recording_key": f"select line_id, {fold('title')} || '|' || coalesce({fold('artist')}, '') || '|' || coalesce(array_to_string(list_sort(list_distinct(hints.qualifiers)), ','), '') as key from list_line where title is not null",
    "n19_copies": "select line_id, cast(1 + coalesce(len(duplicates), 0) as int) as mentions from list_line",
    "n21_non_latin": r"select row_id, regexp_matches(title, '[^\x{0}-\x{36f}\x{2000}-\x{2bff}\x{fe00}-\x{fe0f}]') as non_latin from seed_row",
    "n25_words": f"select doc_id, cast(case when {_flat('text')} = '' then 0 else len(string_split({_flat('text')}, ' ')) end as int) as n_words, cast(length({_flat('text')}) as int) as n_collapsed from documents where text is not null",
    "n26_keys": f"""with k as (select input_id, coalesce('isrc#' || case when regexp_full_match(upper(regexp_replace(isrc, '[\\s\\-]+', '', 'g')), '[A-Z]{{2}}[A-Z0-9]{{3}}[0-9]{{7}}') then upper(regexp_replace(isrc, '[\\s\\-]+', '', 'g')) end,
        'q#' || sha256({fold('title')} || '|' || coalesce({fold('artist')}, ''))) as cache_key from match_input where title is not null or regexp_full_match(upper(regexp_replace(isrc, '[\\s\\-]+', '', 'g')), '[A-Z]{{2}}[A-Z0-9]{{3}}[0-9]{{7}}'))
        select distinct input_id, cache_key, regexp_full_match(cache_key, '(?:q#[0-9a-f]{{64}}|isrc#[A-Z]{{2}}[A-Z0-9]{{3}}[0-9]{{7}})') as neutral from k""",
    "n34_month": "select event_id, cast(date_trunc('month', ts) as date) as month from events",
}
