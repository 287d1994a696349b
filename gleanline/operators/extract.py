"""The whole extraction: documents to items, rejects, residual lines and counts.

Every step is keyed by document and line number, so lines find their document's verdicts by an equi
join and nothing is searched by offset.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanline.functions import score as S
from gleanline.functions import text as T
from gleanline.functions.normalize import fold, normalize_document
from gleanline.operators import lines as L
from gleanline.operators import parse as P
from gleanline.operators import tables as TB
from gleanline.session import dealt, merged
from gleanline.session import placed as cut

# Fixed values of grounding, orientation and rescue.
TITLE_COVERAGE, ARTIST_COVERAGE, MAX_SPAN, MAX_TITLE = 0.7, 0.6, 400, 300
EXPLICIT, CONVENTION, PRIOR, ALTERNATE_BELOW, RESCUE_BELOW = 0.95, 0.85, 0.6, 0.8, 0.5
TITLE_FIRST_KINDS = ["scan_handwriting", "scan_print", "screenshot"]


@dataclass
class Extraction:
    """The result star: four tables keyed by ``doc_id``, each made when it is first asked for.

    ``triaged`` are all lines, ``modes`` what was found of each document, ``matches`` what lines and cells say.
    """

    triaged: DataFrame
    modes: DataFrame
    matches: DataFrame

    @cached_property
    def checked(self) -> DataFrame:
        return cut(grounded(self.matches))

    @cached_property
    def items(self) -> DataFrame:
        # Folded in Python, which leaves no mark of the partitions.
        items = cut(dedupe(dealt(self.checked.where("reason is null"), "doc_id")))
        swapped = F.when(F.col("emit_alternate") & F.col("artist").isNotNull(), F.struct(F.col("artist").alias("title"), F.col("title").alias("artist")))
        return items.withColumn("alternate", swapped).drop("emit_alternate")

    @cached_property
    def rejected(self) -> DataFrame:
        return self.checked.where("reason is not null").select("doc_id", "line_no", "title", "artist", "parser", "reason", "detail", "span_start", "span_end")

    @cached_property
    def residual(self) -> DataFrame:
        headers = self.modes.where("is_table and header_line is not null").select("doc_id", F.col("header_line").alias("line_no"))
        claimed = self.checked.select("doc_id", "line_no").unionByName(headers).distinct()
        return self.triaged.where("not noise").join(merged(claimed), ["doc_id", "line_no"], "left_anti").select("doc_id", "line_no", "line", "line_offset")

    @cached_property
    def stats(self) -> DataFrame:
        # Neither checked matches nor items are stored for their counts.
        stats = self.modes.join(merged(cut(counted(grounded(self.matches)))), "doc_id", "left")
        stats = stats.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("lines_parsed", "items_before_dedupe", "items_after_dedupe", "rejected")})
        # A line gives one match at most, so what is left of a document's content needs no look at its lines.
        headers = F.when(F.col("is_table") & F.col("header_line").isNotNull(), 1).otherwise(0)
        stats = stats.withColumn("lines_residual", F.col("content") - F.col("lines_parsed") - headers)
        stats = stats.select("doc_id", "lines_total", "lines_parsed", "lines_residual", "items_before_dedupe", "items_after_dedupe", "rejected")
        claimed_n, left_n = F.col("lines_parsed"), F.col("lines_residual")
        return stats.withColumn("coverage", F.coalesce(claimed_n / F.nullif(claimed_n + left_n, F.lit(0)), F.lit(1.0)))


def coverage(claim: Column, source: Column) -> Column:
    """Share of the claimed tokens found in the source; repeated tokens count, an empty claim is covered."""
    return F.when(F.size(claim) == 0, 1.0).otherwise(F.size(F.filter(claim, lambda t: F.array_contains(source, t))) / F.size(claim))


def reject_reason(matches: DataFrame) -> DataFrame:
    """Matches with ``reason, detail``: the first check of an item against its span that fails, or nulls."""
    source, title, artist = (T.tokens(F.col(c)) for c in ("fspan", "ftitle", "fartist"))
    t, a = coverage(title, source), coverage(artist, source)
    fixed = lambda c: F.format_string("%.2f", c)
    length = F.col("span_end") - F.col("span_start")
    rules = [
        (T.strip(F.col("title")) == "", "empty_title", F.lit("")),
        (F.char_length("title") > MAX_TITLE, "title_too_long", F.concat(F.char_length("title").cast("string"), F.lit(" characters"))),
        (F.col("span_end") > F.col("n_chars"), "span_out_of_range", F.lit("span ends after the document")),
        (length > MAX_SPAN, "span_out_of_range", F.concat(F.lit("span covers "), length.cast("string"), F.lit(" characters"))),
        (t < TITLE_COVERAGE, "span_text_mismatch", F.concat(F.lit("title token coverage "), fixed(t))),
        (F.col("artist").isNotNull() & (a < ARTIST_COVERAGE), "span_text_mismatch", F.concat(F.lit("artist token coverage "), fixed(a))),
    ]
    reason, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, name, said in reversed(rules):
        reason, detail = F.when(test, name).otherwise(reason), F.when(test, said).otherwise(detail)
    return matches.withColumns({"reason": reason, "detail": detail})


def orientation(matches: DataFrame, kinds: DataFrame) -> DataFrame:
    """``doc_id, orientation, confidence, basis, emit_alternate`` of every document with a known source kind.

    Explicit cues ("by", quotes) decide if they agree, else the side that repeats is the artist, else
    the kind's habit.  Sides are compared without list scaffolding, so that numbering can't hide a
    repetition.  Documents without a kind have no verdict.
    """
    cue = F.when(F.col("parser").isin("by", "quoted"), 1)
    seen = matches.where("parser in ('by', 'quoted', 'dash')").withColumns({"l": fold(F.coalesce("left", "title")), "r": fold(F.coalesce("right", "artist"))})
    signals = seen.groupBy("doc_id").agg(F.sum(cue).alias("cues"), F.count("*").alias("n"), F.countDistinct("l").alias("lefts"), F.countDistinct("r").alias("rights"))
    joined = kinds.where("source_kind is not null").join(merged(signals), "doc_id", "left")
    repeats = (F.col("n") >= 2) & (F.col("lefts") != F.col("rights"))
    way = lambda first: F.when(first, "artist_first").otherwise("title_first")
    said = (
        F.when(F.col("cues") > 0, F.struct(F.lit("title_first").alias("orientation"), F.lit(EXPLICIT).alias("confidence"), F.lit("explicit").alias("basis")))
        .when(repeats, F.struct(way(F.col("lefts") < F.col("rights")).alias("orientation"), F.lit(CONVENTION).alias("confidence"), F.lit("convention").alias("basis")))
        .otherwise(F.struct(way(~F.col("source_kind").isin(*TITLE_FIRST_KINDS)).alias("orientation"), F.lit(PRIOR).alias("confidence"), F.lit("prior").alias("basis")))
    )
    return joined.select("doc_id", said.alias("v")).select("doc_id", "v.*", (F.col("v.confidence") < ALTERNATE_BELOW).alias("emit_alternate"))


def oriented(matches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Dash matches whose reading disagrees with their document's verdict are swapped; others stay.

    A title that carries a version mark stays the title, since marks say which side it is.
    """
    joined = matches.join(merged(verdicts.select("doc_id", "orientation", "emit_alternate")), "doc_id", "left")
    now = F.when(F.col("left").isNotNull() & (F.col("parser") == "dash"), F.when(F.col("artist") == F.col("left"), "artist_first").otherwise("title_first"))
    plain = (F.size("qualifiers") == 0) & (F.size("featured") == 0) & F.col("version_label").isNull() & F.col("artist").isNotNull()
    turn = F.coalesce((now != F.col("orientation")) & plain, F.lit(False))
    return joined.withColumns({
        "title": F.when(turn, F.col("artist")).otherwise(F.col("title")), "artist": F.when(turn, F.col("title")).otherwise(F.col("artist")),
        "emit_alternate": F.coalesce("emit_alternate", F.lit(False)), "oriented": turn,
    })


def dedupe(items: DataFrame) -> DataFrame:
    """Repeated songs of a document as one item each: the surest mention, first on ties, with the others' spans and hints.

    An item without an artist joins the one attributed item with its title, if there is exactly one.
    Order is that of first mention (``first_start``).
    """
    scalars, arrays = ["album", "isrc", "duration_s", "release_year", "version_label", "position", "timestamp_s"], ["featured", "qualifiers"]
    span = F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end"))

    def united_by(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Each group's first row by rank, scalars filled from the next ones, arrays united."""
        order = F.struct("rank", "span_start")
        filled = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in scalars]
        united = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "span_start", F.col(c).alias("v")))), lambda x: x["v"]))).alias(c) for c in arrays]
        lead = [F.min_by(F.col(c), order).alias(c) for c in ("title", "artist", "ftitle", "fartist", "parser", "confidence", "span_start", "span_end", "emit_alternate")]
        spans = F.array_distinct(F.array_sort(F.flatten(F.collect_list(F.concat(F.array(span), F.col("duplicates")))))).alias("spans")
        out = rows.groupBy(*keys).agg(*lead, *filled, *united, spans, F.min("first_start").alias("first_start"))
        return out.withColumn("duplicates", F.filter("spans", lambda s: ~((s["start"] == F.col("span_start")) & (s["end"] == F.col("span_end"))))).drop("spans")

    none = F.array().cast("array<struct<start:int,end:int>>")
    ranked = items.withColumns({
        "key": T.recording_key(F.col("ftitle"), F.col("fartist"), F.col("qualifiers")),
        "duplicates": none, "first_start": F.col("span_start"), "rank": -F.col("confidence"),
    })
    single = united_by(ranked, ["doc_id", "key"])
    # Within a document's title, not joined to it: a null is no title.
    same = Window.partitionBy("doc_id", "ftitle")
    named = F.when(F.col("artist").isNotNull() & F.col("doc_id").isNotNull() & F.col("ftitle").isNotNull(), F.col("key"))
    one = single.withColumns({"hosts": F.count(named).over(same), "host": F.min(named).over(same)})
    joins = F.col("artist").isNull() & (F.col("hosts") == 1)
    hosted = one.withColumns({"host": F.when(joins, F.col("host")).otherwise(F.col("key")), "rank": F.when(joins, 1.0).otherwise(0.0)}).drop("hosts")
    hosted = hosted.withColumn("first_start", F.when(F.col("rank") == 0.0, F.col("first_start")))  # the host keeps its own place
    return united_by(hosted, ["doc_id", "host"]).withColumnRenamed("host", "key")


def grounded(matches: DataFrame) -> DataFrame:
    """Matches with their folded texts, ``reason, detail`` as ``reject_reason`` gives them, and ``confidence``."""
    folded = matches.withColumns({"fspan": fold(F.col("span_text")), "ftitle": fold(F.col("title")), "fartist": fold(F.col("artist"))})
    return reject_reason(folded).withColumn(
        "confidence", S.confidence(F.col("parser"), F.col("title"), F.col("artist"), F.col("isrc").isNotNull(), F.col("duration_s") > 0, F.col("ambiguous"), F.col("structured"))
    )


def counted(checked: DataFrame) -> DataFrame:
    """``doc_id, lines_parsed, items_before_dedupe, items_after_dedupe, rejected`` of every document with a match.

    As many items are left as ``dedupe`` gives, without making them: a key each, but for those without an artist that join a host.
    """
    good = F.col("reason").isNull()
    key = T.recording_key(F.col("ftitle"), F.col("fartist"), F.col("qualifiers"))
    named = F.col("artist").isNotNull() & F.col("doc_id").isNotNull() & F.col("ftitle").isNotNull()
    told = checked.select(
        "doc_id", good.alias("good"), F.when(good, F.col("ftitle")).alias("ftitle"), F.when(good, key).alias("key"), F.col("artist").isNull().alias("nameless"), named.alias("named"),
        F.struct((-F.col("confidence")).alias("rank"), "span_start").alias("order"),
    )
    # A key holds its title, so that one sort serves all three steps.
    keys = dealt(told, "doc_id").groupBy("doc_id", "good", "ftitle", "key").agg(F.count("*").alias("n"), *[F.min_by(c, "order").alias(c) for c in ("nameless", "named")])
    titles = keys.groupBy("doc_id", "good", "ftitle").agg(F.sum("n").alias("n"), (F.count("*") - F.when(F.count_if("named") == 1, F.count_if("nameless")).otherwise(0)).alias("items"))
    of = lambda kind, c: F.coalesce(F.sum(F.when(kind, F.col(c))), F.lit(0))
    return titles.groupBy("doc_id").agg(
        F.sum("n").alias("lines_parsed"), of(F.col("good"), "n").alias("items_before_dedupe"), of(F.col("good"), "items").alias("items_after_dedupe"), of(~F.col("good"), "n").alias("rejected")
    )


def extract(documents: DataFrame, kinds: DataFrame | None = None, limit: int | None = L.MAX_BYTES) -> Extraction:
    """``doc_id, text`` to an extraction.

    ``kinds`` (``doc_id, source_kind``) turns the orientation pass on.  Null texts and texts beyond
    ``limit`` bytes (none for None) give nothing; repeated ids are not allowed; extra columns are left out.
    """
    admitted = documents if limit is None else L.admit(documents, limit)[0]
    # A document's lines are in one partition from here on: all that follows groups and joins within it.
    normal = dealt(admitted.select("doc_id", T.strip(normalize_document(F.col("text"))).alias("text")), "doc_id")
    triaged = cut(L.triage(L.split_lines(normal)).sortWithinPartitions("doc_id", "line_no"))
    parsed = cut(P.parse_lines(triaged))
    n_chars = F.max(F.col("line_offset") + F.char_length("line")).cast("int").alias("n_chars")
    shape = L.list_shape(triaged, F.count("*").alias("lines_total"), n_chars)
    layout, _ = TB.detect(triaged)
    strict_n = parsed.where("strict is not null").groupBy("doc_id").agg(F.count("*").alias("strict_n"))
    modes = shape.join(merged(strict_n), "doc_id", "left").join(merged(layout.withColumn("is_table", F.lit(True))), "doc_id", "left")
    rescue = F.col("list_shaped") & (F.col("content") > 0) & (F.coalesce("strict_n", F.lit(0)) / F.col("content") < RESCUE_BELOW)
    modes = cut(modes.select(
        "doc_id", "lines_total", "content", "n_chars", F.coalesce("is_table", F.lit(False)).alias("is_table"), "header_line", F.coalesce(rescue, F.lit(False)).alias("rescue"), "delim", "columns", "ambiguous",
    ))
    null = lambda kind: F.lit(None).cast(kind)
    line = F.coalesce(F.col("strict"), F.when(F.col("rescue"), F.col("bare")))
    lead = F.char_length(F.regexp_extract("line", f"^[{T.SPACE}]*", 0))
    start = (F.col("line_offset") + F.greatest(F.col("consumed"), lead)).cast("int")
    from_lines = parsed.join(merged(modes.where("not is_table").select("doc_id", "rescue", "n_chars")), "doc_id").withColumn("m", line).where("m is not null").select(
        "doc_id", "line_no", "m.*", null("string").alias("album"), "isrc", "duration_s", null("int").alias("release_year"), "position", "timestamp_s",
        (F.col("position").isNotNull() | F.col("timestamp_s").isNotNull()).alias("structured"), start.alias("span_start"), (start + F.char_length("core")).cast("int").alias("span_end"),
        T.slice_span(F.col("line"), (start - F.col("line_offset")).cast("int"), (start - F.col("line_offset") + F.char_length("core")).cast("int")).alias("span_text"), "n_chars",
    )
    bare_line = F.char_length(T.strip(F.col("line")))
    first = F.col("line_offset") + lead
    cells = TB.table_rows(triaged.select("doc_id", "line_no", "line", "line_offset", "noise"), modes.where("is_table").select("doc_id", "n_chars", "header_line", "delim", "columns", "ambiguous"))
    located = cells.withColumns({"span_start": first.cast("int"), "span_end": (first + bare_line).cast("int"), "span_text": T.strip(F.col("line"))})
    from_tables = TB.read_cells(located, "span_start", "span_end", "span_text", "n_chars").select(
        "doc_id", "line_no", "title", "artist", "parser", "ambiguous", "featured", "qualifiers", "version_label", null("string").alias("left"), null("string").alias("right"),
        "album", "isrc", "duration_s", "release_year", "position", null("int").alias("timestamp_s"), F.lit(True).alias("structured"), "span_start", "span_end", "span_text", "n_chars",
    )
    matches = from_lines.unionByName(from_tables)
    if kinds is not None:
        matches = cut(matches)
        matches = oriented(matches, orientation(matches, kinds))
    else:
        matches = matches.withColumns({"emit_alternate": F.lit(False), "oriented": F.lit(False)})
    return Extraction(triaged, modes, matches)
