"""Documents to lines, and what a line is: noise, prose or an entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanline.functions import text as T
from gleanline.session import spread

# Fixed values of line triage.
PROSE_WORDS, BARE_WORDS, SENTENCE_WORDS, LIST_LINES, PROSE_SHARE = 12, 10, 3, 3, 0.3
ABBREVIATIONS = [
    "mr", "mrs", "ms", "dr", "st", "jr", "sr", "prof", "rev", "gen", "sgt", "vs", "feat", "ft", "no", "vol", "pt", "op", "ch", "fig", "inc", "ltd", "co", "corp", "etc", "ca", "approx", "orig", "rec",
]
_S, _NS = f"[{T.SPACE}]", f"[^{T.SPACE}]"
NOISE = [
    f"^{_S}*[-=*_~]{{3,}}{_S}*$",
    f"^{_S}*#{{1,6}}{_S}+{_NS}",
    f"^{_S}*(?:```|~~~)",
    f"^{_S}*\\|?[{T.SPACE}:|-]*\\|[{T.SPACE}:|-]*$",
    f"(?i)^{_S}*<?(?:https?://|www\\.){_NS}+>?{_S}*$",
    f"^{_S}*<[^>]+>{_S}*$",
    f"^{_S}*{_NS}[^:]{{0,40}}:{_S}*$",
]
SENTENCE = r"(?:(?<![\p{L}\p{N}_'])([\p{L}\p{N}_']++)|(?<![.!?]))[.!?]++[)\"'”]?\s+(?=[A-Z0-9\"“])"
MAX_BYTES = 100 * 1024


def admit(documents: DataFrame, limit: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents within the size cap, and those beyond it with their size; null texts are neither."""
    size = T.utf8_length(F.col("text"))
    return documents.where(size <= limit), documents.where(size > limit).withColumn("n_bytes", size)


def running_offsets(sizes: Column) -> Column:
    """Sums of the numbers before each one of an array, within the row: in blocks of about the root of its length, so that no array grows one by one to its whole length."""
    # As lambda variables, sizes and blocks are computed once, not for every block.
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    block = lambda numbers: F.ceil(F.sqrt(F.size(numbers))).cast("int")
    cut = lambda numbers, length: F.transform(F.sequence(F.lit(0), F.ceil(F.size(numbers) / length).cast("int") - 1), lambda k: F.slice(numbers, k * length + 1, length))
    total = lambda numbers: F.aggregate(numbers, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    grown = lambda first, numbers: F.slice(F.aggregate(numbers, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), 1, F.size(numbers))
    offsets = lambda blocks: F.flatten(F.zip_with(grown(F.lit(0).cast("bigint"), F.transform(blocks, total)), blocks, grown))
    return let(sizes, lambda numbers: let(cut(numbers, block(numbers)), offsets))


def split_lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, line_no, line, line_offset`` of every line; an empty text is one empty line, a null one none.

    Offsets count code points.  Narrow: lines and offsets come from their text's own row, without a shuffle.
    """
    lines = spread(documents.where(F.col(text).isNotNull()).select("doc_id", text)).select("doc_id", F.split(text, "\n", -1).alias("parts"))
    placed = lines.select("doc_id", "parts", running_offsets(F.transform("parts", lambda l: F.char_length(l).cast("bigint") + 1)).alias("offsets"))
    rows = placed.select("doc_id", F.posexplode(F.arrays_zip("parts", "offsets")).alias("line_no", "at"))
    return rows.select("doc_id", "line_no", F.col("at.parts").alias("line"), F.col("at.offsets").alias("line_offset"))


def is_noise(line: Column) -> Column:
    """Blank, without a letter or digit, or only a rule, heading, fence, table line, link, tag or section label."""
    test = ~line.rlike(r"[\p{L}\p{N}]")
    for pattern in NOISE:
        test = test | line.rlike(pattern)
    return test


def has_sentence_break(line: Column) -> Column:
    """Whether a sentence ends inside the line; abbreviations and initials don't end one."""
    ends = F.regexp_extract_all(line, F.lit(SENTENCE), 1)
    short = F.array(*[F.lit(a) for a in ABBREVIATIONS])
    return F.exists(ends, lambda w: (w == "") | ((F.char_length(w) > 1) & ~F.array_contains(short, F.regexp_replace(F.lower(w), "'+$", ""))))


def is_prose(line: Column) -> Column:
    """Too many words for an entry, or more than a few with a sentence break."""
    count = T.word_count(line)
    return (count > PROSE_WORDS) | ((count > SENTENCE_WORDS) & has_sentence_break(T.strip(line)))


def triage(lines: DataFrame) -> DataFrame:
    """Lines with ``noise, prose, n_words``; prose and words are of the line without white space around it."""
    return lines.withColumns({"noise": is_noise(F.col("line")), "n_words": T.word_count(F.col("line")), "prose": is_prose(F.col("line"))})


def list_shape(triaged: DataFrame, *more: Column) -> DataFrame:
    """``doc_id, content, median_words, prose_share, list_shaped, first_content`` of every document with lines, and ``more`` aggregates.

    The median is exact.  Documents of noise only have no median and are no lists; their first content line is 0.
    """
    real = ~F.col("noise")
    grouped = triaged.groupBy("doc_id").agg(
        F.count_if(real).alias("content"),
        F.median(F.when(real, F.col("n_words"))).alias("median_words"),
        F.avg(F.when(real, F.col("prose").cast("int"))).alias("prose_share"),
        F.coalesce(F.min(F.when(real, F.col("line_no"))), F.lit(0)).alias("first_content"), *more,
    )
    shaped = (F.col("content") >= LIST_LINES) & (F.col("median_words") <= BARE_WORDS) & (F.col("prose_share") < PROSE_SHARE)
    return grouped.withColumn("list_shaped", F.coalesce(shaped, F.lit(False)))
