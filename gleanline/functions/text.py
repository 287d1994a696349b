"""Scalar text functions as columns; all stay in the JVM.

Null in gives null out unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as list texts use it, for inside a character class.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ISRC = r"^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$"
INVISIBLE = r"\xad\x{200b}-\x{200f}\x{2060}-\x{2064}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}"


def strip(text: Column) -> Column:
    """A text without white space at its ends, of any script's kind."""
    # From the start of a run of white space only: from each of its characters, long runs would take the square of their length.
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}](?<![{SPACE}]{{2}})[{SPACE}]*+$", "")


def strip_chars(text: Column, chars: str) -> Column:
    """A text without the given characters at its ends."""
    inside = "".join(f"\\x{{{ord(c):x}}}" for c in chars)
    return F.regexp_replace(text, f"^[{inside}]+|[{inside}]+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def words(text: Column) -> Column:
    """The words between white space; an empty array for blank text."""
    flat = collapse(text)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def word_count(text: Column) -> Column:
    """Number of words between white space."""
    return F.when(text.isNotNull(), F.size(words(text)))


def utf8_length(text: Column) -> Column:
    """Bytes of a text in UTF-8."""
    return F.octet_length(text)


def isrc(text: Column) -> Column:
    """A recording code in its plain form, or null where it is malformed."""
    plain = F.upper(F.regexp_replace(text, f"[{SPACE}\\-]+", ""))
    return F.when(plain.rlike(ISRC), plain)


def clock_seconds(text: Column) -> Column:
    """Seconds of ``mm:ss`` or ``h:mm:ss``; null for anything else."""
    shape = r"^(?:(\d{1,2}):)?(\d{1,3}):([0-5]\d)$"
    bare = strip(text)
    part = lambda i: F.regexp_extract(bare, shape, i).try_cast("double")
    return F.when(bare.rlike(shape), F.coalesce(part(1), F.lit(0.0)) * 3600 + part(2) * 60 + part(3))


def split_names(text: Column) -> Column:
    """The names in a list of credits such as "A, B & C x D"."""
    joints = r"(?i)\s*(?:,|&|(?<![\p{L}\p{N}_])(?:x|vs\.?|and)(?![\p{L}\p{N}_])|\+)\s*"
    parts = F.transform(F.split(text, joints), lambda p: strip_chars(p, " .;"))
    return F.filter(parts, lambda p: p != "")


def artist(text: Column) -> Column:
    """An artist without list punctuation around it and without a leading "by"."""
    bare = strip_chars(strip(text), "-–—,;: \t")
    return collapse(F.regexp_replace(bare, f"(?i)^by[{SPACE}]+", ""))


def credits(text: Column) -> Column:
    """``struct<primary, featured>``: the artist before an inline or bracketed "feat." and those after it."""
    return credits_of(artist(text))


def credits_of(clean: Column) -> Column:
    """As ``credits``, of an artist that is already without list punctuation."""
    inline = r"(?i)^(.*?)\s+(?:feat\.|ft\.|featuring)\s+(.+)$"
    bracket = r"(?i)^(.*?)\s*[(\[]\s*(?:feat\.?|ft\.?|featuring|w\.?/)\s+([^()\[\]]+?)\s*[)\]]\s*$"
    none = F.array().cast("array<string>")
    made = lambda p: F.struct(artist(F.regexp_extract(clean, p, 1)).alias("primary"), split_names(F.regexp_extract(clean, p, 2)).alias("featured"))
    return F.when(clean.isNull(), None).when(clean.rlike(inline), made(inline)).when(clean.rlike(bracket), made(bracket)).otherwise(F.struct(clean.alias("primary"), none.alias("featured")))


def fold_ascii(text: Column) -> Column:
    """Comparison key of a text: lower case, punctuation as blanks, blanks collapsed.

    Built-in part of ``functions.normalize.fold``: accents are left as they are.
    """
    return collapse(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]+", " "))


def tokens(folded: Column) -> Column:
    """Words of a folded text."""
    return F.when(folded == "", F.array().cast("array<string>")).otherwise(F.split(folded, " "))


def recording_key(title: Column, performer: Column, qualifiers: Column) -> Column:
    """Collapse key of folded title and artist and the sorted qualifiers; a missing artist is an empty one."""
    return F.concat_ws("|", title, F.coalesce(performer, F.lit("")), F.array_join(F.array_sort(F.array_distinct(F.coalesce(qualifiers, F.array().cast("array<string>")))), ","))


def text_key(title: Column, performer: Column) -> Column:
    """Neutral cache key that holds no readable text."""
    return F.concat(F.lit("q#"), F.sha2(F.concat_ws("|", title, F.coalesce(performer, F.lit(""))), 256))


def isrc_key(code: Column) -> Column:
    """Cache key of a recording code."""
    return F.concat(F.lit("isrc#"), isrc(code))


def is_neutral_key(key: Column) -> Column:
    """Whether a cache key is one of the two kinds that hold no text."""
    return key.rlike(r"^(?:q#[0-9a-f]{64}|isrc#[A-Z]{2}[A-Z0-9]{3}[0-9]{7})$")


def has_non_latin(text: Column) -> Column:
    """Whether another script than Latin appears; general punctuation and symbols are no evidence."""
    return text.rlike(r"[^\x{0}-\x{36f}\x{2000}-\x{2bff}\x{fe00}-\x{fe0f}]")


def slice_span(text: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) by code point."""
    return F.substring(text, start + 1, end - start)


def within(text: Column, end: Column) -> Column:
    """Whether a span ends inside its text."""
    return end <= F.char_length(text)


def month_start(moment: Column) -> Column:
    """First instant of a moment's UTC month."""
    return F.date_trunc("month", moment)


def redact_mail(text: Column) -> Column:
    """E-mail addresses masked."""
    return F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[redacted]")


def code_point_range(spec: Column) -> Column:
    """``struct<low, high>`` of "U+0041" or "U+0041-005A"; nulls for anything else."""
    shape = r"^U\+([0-9A-Fa-f]{1,6})(?:-(?:U\+)?([0-9A-Fa-f]{1,6}))?$"
    number = lambda i: F.conv(F.nullif(F.regexp_extract(F.trim(spec), shape, i), F.lit("")), 16, 10).cast("int")
    return F.struct(number(1).alias("low"), F.coalesce(number(2), number(1)).alias("high"))


def merge_structs(left: Column, right: Column, scalars: list[str], lists: list[str]) -> Column:
    """Two hint structs merged: the left's scalars first, lists united in order of appearance."""
    none = F.array().cast("array<string>")
    parts = [F.coalesce(left[f], right[f]).alias(f) for f in scalars]
    parts += [F.array_distinct(F.concat(F.coalesce(left[f], none), F.coalesce(right[f], none))).alias(f) for f in lists]
    return F.struct(*parts)


def unicode_checks() -> list[tuple[str, Column]]:
    """What the engine's regular expressions must know of Unicode, by name, each as a condition that has to hold."""
    has = lambda char, pattern: F.lit(char).rlike(pattern)
    return [
        ("a Greek capital is an upper-case letter", has("\u0394", r"\p{Lu}")), ("Cyrillic is a letter", has("\u041f", r"\p{L}")), ("an ideograph is a letter", has("\u4e16", r"\p{L}")),
        ("an Arabic-Indic digit is a number", has("\u0663", r"\p{N}")), ("a separator is a control", has("\x1f", r"\p{Cc}")), ("a hyphen is no letter", ~has("-", r"\p{L}")),
        ("looking behind works", has("x", "(?<![a-z])x") & ~has("ax", "(?<![a-z])x")), ("lengths count code points", F.char_length(F.lit("\U0001f3b5")) == 1),
    ]
