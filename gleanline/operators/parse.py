"""A line's affixes peeled off and its title and artist told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanline.functions import text as T
from gleanline.functions.normalize import peel_title
from gleanline.operators.lines import BARE_WORDS, is_prose

# List scaffolding before and after an entry.
_ORDINAL = r"(?:\s*#?\s*(\d{1,3})\s*[.)\]:–—-]\s+|\s*[\[(]\s*(\d{1,3})\s*[\])]\s*[.)–—-]?\s+)"
_STAMP = r"\s*[\[(]?\s*((?:\d{1,2}:)?\d{1,2}:[0-5]\d)\s*[\])]?\s*[.)–—-]?\s+"
_LOOSE = r"(?:\s*[-*•‣·◦⁃∙>+|–—]\s+)*+"
PREFIX = f"^{_LOOSE}(?:{_ORDINAL}{_LOOSE}(?:{_STAMP}{_LOOSE})?|{_STAMP}{_LOOSE}(?:{_ORDINAL}{_LOOSE})?)?[{T.SPACE}]*"
LENGTH_END = r"\s*[\[(]\s*((?:\d{1,2}:)?\d{1,2}:[0-5]\d)\s*[\])]\s*$"
ISRC_END = r"\s*[\[(]?\s*(?:ISRC[:\s]*)?([A-Za-z]{2}[A-Za-z0-9]{3}[-\s]?\d{2}[-\s]?\d{5})\s*[\])]?\s*$"
# What tells title and artist apart.
QUOTED_RIGHT = r"^(.+?)\s*[-:–—]\s*[\"“«]([^\"”»]+)[\"”»]\s*$"
QUOTED_LEFT = r"(?i)^[\"“«]([^\"”»]+)[\"”»]\s*(?:[-–—]|(?<![\p{L}\p{N}_])by(?![\p{L}\p{N}_]))\s*(.+)$"
BY = r"(?i)^(.+?)\s+by\s+(.+)$"
SEPARATOR = r"\s+[-~|/•·]\s+|\s*[–—―]\s*"
TAB = r"^([^\t]+?)\t+([^\t]+)$"
ARTIST_WORDS, TITLE_WORDS = 6, 12
DETERMINERS = ["a", "an", "my", "our", "your", "their", "his", "her", "its", "this", "that", "these", "those", "some", "any", "every"]
CREDITS = [
    "written", "produced", "mixed", "mastered", "composed", "arranged", "compiled", "curated", "edited", "published", "released", "uploaded", "posted", "submitted", "recorded", "directed",
    "assembled", "selected", "chosen", "picked", "ranked", "presented", "sourced", "sponsored", "inspired", "brought", "made", "created", "reviewed",
]
CREDIT_START = r"(?i)^(?:written|produced|mixed|mastered|composed|arranged|compiled|curated|edited|published|released|uploaded|posted|submitted|recorded|directed|photos?|images?|artwork|inspired)(?![\p{L}\p{N}_])"


def _group(text: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def strip_prefixes(line: Column) -> Column:
    """``struct<rest, consumed, position, timestamp_s>``: ordinal and time stamp once each, bullets as often as they come.

    An ordinal of zero is taken off but is no position.
    """
    eaten = F.regexp_extract(line, PREFIX, 0)
    number = F.coalesce(*[_group(line, PREFIX, i) for i in (1, 2, 5, 6)]).try_cast("int")
    stamp = T.clock_seconds(F.coalesce(_group(line, PREFIX, 3), _group(line, PREFIX, 4)))
    consumed = F.char_length(eaten)
    return F.struct(
        line.substr(consumed + 1, F.char_length(line)).alias("rest"), consumed.alias("consumed"), F.when(number >= 1, number).alias("position"), stamp.cast("int").alias("timestamp_s")
    )


def strip_suffixes(text: Column) -> Column:
    """``struct<rest, duration_s, isrc>``: a bracketed length and a recording code at the end, in either order."""
    code, length = text.rlike(ISRC_END), text.rlike(LENGTH_END)
    once = F.when(code, F.regexp_replace(text, ISRC_END, "")).when(length, F.regexp_replace(text, LENGTH_END, "")).otherwise(text)
    code_next, length_next = ~code & length & once.rlike(ISRC_END), code & once.rlike(LENGTH_END)
    twice = F.when(code_next, F.regexp_replace(once, ISRC_END, "")).when(length_next, F.regexp_replace(once, LENGTH_END, "")).otherwise(once)
    isrc = T.isrc(F.when(code, _group(text, ISRC_END, 1)).when(code_next, _group(once, ISRC_END, 1)))
    seconds = T.clock_seconds(F.when(~code & length, _group(text, LENGTH_END, 1)).when(length_next, _group(once, LENGTH_END, 1)))
    return F.struct(F.regexp_replace(twice, r"[ \t.,;]+$", "").alias("rest"), seconds.alias("duration_s"), isrc.alias("isrc"))


def dash_sides(text: Column) -> Column:
    """The two sides of the first separator, or null."""
    parts = F.split(text, SEPARATOR, 2)
    sides = F.transform(parts, T.strip)
    return F.when((F.size(parts) == 2) & (F.element_at(sides, 1) != "") & (F.try_element_at(sides, F.lit(2)) != ""), sides)


def _marked(peeled: Column) -> Column:
    """Whether a peeled text carried a version or guest and has a title left."""
    said = (F.size(peeled["qualifiers"]) > 0) | (F.size(peeled["featured"]) > 0) | peeled["version_label"].isNotNull()
    return F.coalesce(said & (peeled["base"] != ""), F.lit(False))


def _match(parser: str, peeled: Column, artist: Column, ambiguous: Column, left: Column | None = None, right: Column | None = None) -> Column:
    """A parser's struct with the artist as written, or null where no title is left or it is too long."""
    text = lambda c: F.lit(None).cast("string") if c is None else c
    made = F.struct(
        peeled["base"].alias("title"), artist.alias("artist"), F.lit(parser).alias("parser"), ambiguous.alias("ambiguous"), peeled["featured"].alias("featured"),
        peeled["qualifiers"].alias("qualifiers"), peeled["version_label"].alias("version_label"), text(left).alias("left"), text(right).alias("right"),
    )
    return F.when((peeled["base"] != "") & (T.word_count(peeled["base"]) <= TITLE_WORDS), made)


def _credited(match: Column, credit: Column) -> Column:
    """A match with its artist's credits told apart."""
    none = F.array().cast("array<string>")
    named = match.withField("artist", F.nullif(credit["primary"], F.lit("")))
    return F.when(match.isNotNull(), named.withField("featured", F.array_distinct(F.concat(match["featured"], F.coalesce(credit["featured"], none)))))


def _once(row: Column) -> Column:
    """A struct's fields as columns, by a generator of one row: filters on them stay above it.

    Pushed further down, a filter would repeat the whole parser's expression wherever a field is named.
    """
    return F.inline(F.array(row))


def parse_lines(triaged: DataFrame) -> DataFrame:
    """Content lines with ``consumed, position, timestamp_s, duration_s, isrc, core, strict, bare``.

    ``strict`` is the first of tab, quoted, by and dash that claims the line, ``bare`` the line as a
    title alone.  Narrow, and in the JVM throughout.
    """
    keys = ("doc_id", "line_no", "line", "line_offset")
    rows = triaged.where("not noise").select(*keys, _once(strip_prefixes(F.col("line"))))
    rows = rows.select(*keys, "consumed", "position", "timestamp_s", _once(strip_suffixes(F.col("rest")))).withColumnRenamed("rest", "core").where("core rlike '\\\\S'")
    core = F.col("core")
    tab = core.rlike(TAB)
    tab_left, tab_right = T.strip(_group(core, TAB, 1)), T.strip(_group(core, TAB, 2))
    right, left = core.rlike(QUOTED_RIGHT), core.rlike(QUOTED_LEFT)
    quoted_title = F.when(right, _group(core, QUOTED_RIGHT, 2)).when(left, _group(core, QUOTED_LEFT, 1))
    quoted_artist = F.when(right, _group(core, QUOTED_RIGHT, 1)).when(left, _group(core, QUOTED_LEFT, 2))
    by_title, by_artist = T.strip(_group(core, BY, 1)), T.artist(_group(core, BY, 2))
    last_word = F.lower(T.strip_chars(F.element_at(F.concat(F.array(F.lit("")), T.words(by_title)), -1), ",;:"))
    by = (
        core.rlike(BY) & ~core.rlike(CREDIT_START) & ~last_word.isin(*CREDITS) & (by_artist != "") & (T.word_count(by_artist) <= ARTIST_WORDS)
        & ~F.lower(F.split(by_artist, " ")[0]).isin(*DETERMINERS) & ~by_artist.rlike(r"(?i)(?<![\p{L}\p{N}_])by(?![\p{L}\p{N}_])")
    )
    sides = dash_sides(core)
    rows = rows.withColumns({
        "tab_title": F.when(tab & (tab_left != "") & (tab_right != ""), tab_right), "tab_artist": tab_left,
        "quoted_title": quoted_title, "quoted_artist": quoted_artist, "by_title": F.when(by, by_title), "by_artist": by_artist,
        "dash_left": F.element_at(sides, 1), "dash_right": F.try_element_at(sides, F.lit(2)),
        "bare_title": F.when(~is_prose(core) & (T.word_count(core) <= BARE_WORDS), T.strip(core)),
    })
    texts = ("tab_title", "quoted_title", "by_title", "dash_left", "dash_right", "bare_title")
    # One expression peels all readings of a line.
    peeled = F.transform(F.array(*[F.col(c) for c in texts]), peel_title)
    rows = rows.withColumn("peeled", peeled).withColumns({f"{c}_p": F.element_at("peeled", i + 1) for i, c in enumerate(texts)}).drop("peeled")
    p = {c: F.col(f"{c}_p") for c in texts}
    left_marked, right_marked = _marked(p["dash_left"]), _marked(p["dash_right"])
    flipped = left_marked & ~right_marked
    dash_artist = F.when(flipped, F.col("dash_right")).otherwise(F.col("dash_left"))
    title_first = _match("dash", p["dash_left"], dash_artist, F.lit(False), F.col("dash_left"), F.col("dash_right"))
    artist_first = _match("dash", p["dash_right"], dash_artist, left_marked & right_marked, F.col("dash_left"), F.col("dash_right"))
    dash = F.when(F.col("dash_left").isNotNull() & (T.word_count(dash_artist) <= ARTIST_WORDS), F.when(flipped, title_first).otherwise(artist_first))
    null = F.lit(None).cast("string")
    strict = F.coalesce(
        _match("tab", p["tab_title"], F.col("tab_artist"), F.lit(True)),
        _match("quoted", p["quoted_title"], F.col("quoted_artist"), F.lit(False)),
        _match("by", p["by_title"], F.col("by_artist"), F.lit(False)),
        dash,
    )
    bare = _match("bare", p["bare_title"], null, F.lit(False))
    hints = (*keys, "consumed", "position", "timestamp_s", "duration_s", "isrc", "core")
    # The winner's artist is cleaned and split once, after the choice.
    chosen = rows.select(*hints, _once(F.struct(strict.alias("strict"), bare.alias("bare"))))
    cleaned = chosen.select(*hints, "strict", "bare", _once(F.struct(T.artist(F.col("strict.artist")).alias("clean"))))
    credited = cleaned.select(*hints, "strict", "bare", _once(F.struct(T.credits_of(F.col("clean")).alias("credit"))))
    return credited.select(*hints, _once(F.struct(_credited(F.col("strict"), F.col("credit")).alias("strict"), F.col("bare").alias("bare"))))
