"""Normal forms of texts and titles: in the JVM, but for characters that only Python's tables know, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleanline.functions import text as T

_INVISIBLE = re.compile("[­​-‏⁠-⁤‪-‮⁦-⁩﻿]")
# Letters that decomposition leaves alone, in ASCII.
LATIN = dict(zip("øłđŧħıßæœþðŋ", "o l d t h i ss ae oe th d n".split(), strict=True))
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюя", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch ' y ' e yu ya".split(), strict=True))
GREEK = dict(zip("αβγδεζηθικλμνξοπρστυφχψως", "a v g d e z i th i k l m n x o p r s t y f ch ps o s".split(), strict=True))
_LETTERS = LATIN | CYRILLIC | GREEK
_CLEAN = re.compile(r"[^\w\s]+")


def normalize_text(raw: str) -> str:
    """Line ends as line feeds, compatibility forms composed, invisible and control characters gone."""
    text = unicodedata.normalize("NFKC", raw.replace("\r\n", "\n").replace("\r", "\n"))
    text = "".join(c for c in _INVISIBLE.sub("", text) if c in "\n\t" or unicodedata.category(c) != "Cc")
    return unicodedata.normalize("NFKC", text)  # what was taken out may have kept two marks apart


def fold_text(text: str) -> str:
    """Comparison key: no accents, Latin, Cyrillic and Greek letters in ASCII, lower case, no punctuation."""
    low = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    low = "".join(_LETTERS.get(c, c) for c in low)
    return " ".join(_CLEAN.sub(" ", low).split())


def _arrow(function, kind):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda s: None if s is None else function(s))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def normalize_document(raw: Column) -> Column:
    """The text that spans index into; only texts beyond printable ASCII go through Python."""
    plain = raw.rlike(r"^[\t\n\x20-\x7e]*$")
    return F.when(plain, raw).otherwise(_arrow(normalize_text, StringType())(F.when(~plain, raw)))


def _own_folds() -> dict[str, str]:
    """Small letters and signs beyond ASCII whose fold doesn't depend on their neighbours, with it."""
    out = {}
    for low, high in ((0xA0, 0x250), (0x300, 0x530), (0x1E00, 0x2070), (0x20A0, 0x20C0), (0x2100, 0x2300), (0x2500, 0x2700)):
        for code in range(low, high):
            char = chr(code)
            between = fold_text(f"x{char}y")
            if char.lower() == char and unicodedata.category(char) != "Cn" and between.isascii() and fold_text(f"x{char}{char}y")[1:-1].split() == (between[1:-1] * 2).split():
                out[char] = between[1:-1]
    return out


_FOLDS = _own_folds()
_ONE = {c: f for c, f in _FOLDS.items() if len(f) == 1}
_NONE = [c for c, f in _FOLDS.items() if not f]
_MANY = {c: f for c, f in _FOLDS.items() if len(f) > 1}


def _class(chars: Iterable[str]) -> str:
    """The characters as ranges, for inside a character class."""
    codes, out, start = sorted(map(ord, chars)), [], None
    for i, code in enumerate(codes):
        start = code if start is None else start
        if i + 1 == len(codes) or codes[i + 1] != code + 1:
            out.append(f"\\x{{{start:x}}}-\\x{{{code:x}}}")
            start = None
    return "".join(out)


# Capitals don't occur in lower case; as members they make the ranges fewer.
_BEYOND = f"[^\\x00-\\x7f{_class({*_FOLDS, *(chr(c) for c in range(0xC0, 0x2000) if chr(c).lower() in _FOLDS)})}]"


def fold(text: Column) -> Column:
    """Comparison key of a text: lower case, no accents or punctuation, Latin, Cyrillic and Greek letters in ASCII.

    Only texts with characters of other scripts go through Python.
    """
    low = F.lower(text)
    many = low
    for char, ascii_form in _MANY.items():
        many = F.replace(many, F.lit(char), F.lit(ascii_form))
    whole = F.when(low.rlike(f"[{_class(_MANY)}]"), many).otherwise(low)
    plain = T.fold_ascii(F.translate(whole, "".join(_ONE) + "".join(_NONE), "".join(_ONE.values())))
    odd = text.rlike(r"[^\x00-\x7f]")
    beyond = odd & low.rlike(_BEYOND)
    return F.when(~odd, T.fold_ascii(text)).when(~beyond, plain).otherwise(_arrow(fold_text, StringType())(F.when(beyond, text)))


# What an annotation after a title says of its version.
_W, _E, _S = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])", f"[{T.SPACE}]"
QUALIFIERS = {
    "acoustic": f"{_W}acoustic{_E}|{_W}unplugged{_E}",
    "cover": f"{_W}cover{_E}",
    "demo": f"{_W}demo{_E}",
    "extended": f"{_W}extended{_E}",
    "instrumental": f"{_W}instrumental{_E}",
    "karaoke": f"{_W}karaoke{_E}",
    "live": f"{_W}live{_E}",
    "radio_edit": f"{_W}radio{_S}+(?:edit|mix|version){_E}",
    "remaster": f"{_W}remaster(?:ed)?{_E}",
    "remix": f"{_W}re-?mix(?:ed|es)?{_E}|{_W}[\\p{{L}}\\p{{N}}_]+{_S}+mix{_E}",
}
OWN_MIX = f"(?:extended|original|album|radio|single|main|final|full){_S}+mix"
BARE_VERSION = f"(?:original|single|album|deluxe|explicit|clean|bonus|stereo|mono)(?:{_S}+(?:mix|version|edit|track|master|cut))?"
GUEST = f"(?:feat\\.?|ft\\.?|featuring|w\\.?/){_S}+"
INLINE_GUEST = f"(?i){_S}+(?:feat\\.|ft\\.|featuring){_S}+(.+)$"
DASH = r"\-\x{2010}-\x{2015}\x{2212}"


def _known(inside: str, end: str, ahead: Callable[[str], str]) -> str:
    """Matches an annotation up to ``end`` that says something of version or guests, which ``ahead`` looks for; a guest begins with a character ``inside``."""
    versions = "|".join(pattern for name, pattern in QUALIFIERS.items() if name != "remix")
    own = f"(?!{OWN_MIX}{_S}*{end})"
    said = f"{ahead(versions)}|{own}{ahead(QUALIFIERS['remix'])}|(?={BARE_VERSION}{_S}*{end})|(?={GUEST}{inside})"
    return f"(?:{said})"


# Java's stack grows with the turns of a loop over alternatives, so that a long line ends the process: loops are over one class of characters, or possessive.
_IN_BRACKET, _IN_DASH = r"[^()\[\]]", f"[^{DASH}]"
_BRACKET = f"[(\\[]{_S}*(?:{_known(_IN_BRACKET, '[)\\]]', lambda said: f'(?={_IN_BRACKET}*?(?:{said}))')}{_IN_BRACKET}*)?[)\\]]{_S}*"
# Brackets count as words of a dashed annotation where words follow them.
_PLAIN = f"[^{DASH}()\\[\\]]"
_WORDS_FOLLOW = f"(?={_IN_DASH}*[^{DASH}{T.SPACE})\\]]{_S}*(?:$|{_S}[{DASH}]{_S}))"
_IN_WORDS = f"(?:{_PLAIN}|[()\\[\\]]{_WORDS_FOLLOW})"
# After a dash: up to the next dash, the end or bracketed annotations of its own.
_AFTER_DASH = f"(?<={_S})[{DASH}]{_S}+" + _known(_IN_WORDS, f"(?:$|[(\\[]|{_S}[{DASH}]{_S})", lambda said: f"(?:(?={_PLAIN}*?(?:{said}))|{_WORDS_FOLLOW}(?={_IN_DASH}*?(?:{said})))")
_DASHED = f"{_AFTER_DASH}{_IN_DASH}*?[^{DASH}{T.SPACE})\\]]{_S}*(?=$|[(\\[]|[{DASH}]{_S})"
# Without a bracket there is one end only.
_DASHED_PLAIN = f"{_AFTER_DASH}{_PLAIN}*?[^{DASH}{T.SPACE}()\\[\\]]{_S}*(?=$|[{DASH}]{_S})"
ANNOTATIONS = f"(?i)(?:(?:{_BRACKET})++|(?:{_DASHED_PLAIN})++|{_DASHED})+$"
_OPEN_END = f"[(\\[][^()\\[\\]]*[)\\]]{_S}*$|{_S}[{DASH}]{_S}+[^{DASH}]+$"


def _guest_key(name: Column) -> Column:
    """Equal for spellings of one name that differ in case, accents of Latin letters and punctuation."""
    return T.fold_ascii(F.translate(F.lower(name), "".join(_ONE) + "".join(_NONE), "".join(_ONE.values())))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _states(name: str) -> Callable[[Column], Column]:
    """Whether an annotation states a version; a label's own mix is no remix."""
    pattern, own = f"(?i){QUALIFIERS[name]}", f"(?i)^{OWN_MIX}$"
    return lambda part: part.rlike(pattern) & ~part.rlike(own) if name == "remix" else part.rlike(pattern)


def _annotations(tail: Column) -> Column:
    """The texts of the annotations in a title's tail, from the last to the first: taken apart at spaced dashes, then at brackets."""
    pieces = F.split(tail, f"(?:^|(?<={_S}))[{DASH}]{_S}+")
    in_brackets = lambda brackets: F.regexp_extract_all(brackets, F.lit(r"[(\[]([^()\[\]]*)[)\]]"), 1)
    apart = lambda piece, brackets: F.concat(F.array(piece.substr(F.lit(1), F.char_length(piece) - F.char_length(brackets))), in_brackets(brackets))
    closing = f"((?:[(\\[][^()\\[\\]]*[)\\]]{_S}*)*+)$"
    parts = F.flatten(F.transform(pieces, lambda piece: apart(piece, F.regexp_extract(piece, closing, 1))))
    return F.reverse(F.filter(F.transform(parts, T.strip), lambda part: part != ""))


def _peeled(base: Column, inline: Column, said: Column) -> Column:
    """The result struct of a base, the credits after an inline guest mark and the annotations."""
    guest_of = lambda part: F.regexp_extract(part, f"(?i)^{GUEST}(.+)$", 1)
    versions = F.filter(said, lambda part: guest_of(part) == "")
    stated = F.filter(F.array(*[F.when(F.exists(versions, _states(name)), F.lit(name)) for name in QUALIFIERS]), lambda q: q.isNotNull())
    any_of = "(?i)" + "|".join(pattern for name, pattern in QUALIFIERS.items() if name != "remix")
    label = F.try_element_at(F.filter(versions, lambda part: part.rlike(any_of) | _states("remix")(part)), F.lit(1))
    credited = F.flatten(F.transform(F.concat(F.transform(said, guest_of), F.array(inline)), T.split_names))
    keyed = F.transform(credited, lambda name: F.struct(_guest_key(name).alias("key"), name.alias("name")))
    first = _let(keyed, lambda k: F.filter(k, lambda one, i: ~F.exists(F.slice(k, 1, i), lambda earlier: earlier["key"] == one["key"])))
    names = F.when(F.size(credited) > 1, F.transform(first, lambda k: k["name"])).otherwise(credited)
    return F.struct(T.strip_chars(base, " -–—").alias("base"), stated.alias("qualifiers"), names.alias("featured"), label.alias("version_label"))


def peel_title(title: Column) -> Column:
    """``struct<base, qualifiers, featured, version_label>`` of a title; all in the JVM, null for null.

    The annotations at a title's end are matched in one piece and taken apart afterwards.  The last one that
    states a version is the label.  What no annotation explains belongs to the title, and so does an
    annotation after a dash that ends with a bracket it doesn't open.
    """
    bare = T.strip(title)
    rest = lambda tail: F.regexp_replace(bare.substr(F.lit(1), F.char_length(bare) - F.char_length(tail)), f"{_S}+$", "")
    guests = lambda text: F.when(text.rlike(_OPEN_END), F.lit("")).otherwise(F.regexp_extract(text, INLINE_GUEST, 1))
    before = lambda text, inline: F.when(inline != "", F.regexp_replace(text, INLINE_GUEST, "")).otherwise(text)
    made = lambda tail: _let(rest(tail), lambda text: _let(guests(text), lambda inline: _peeled(before(text, inline), inline, _annotations(tail))))
    peeled = _let(F.regexp_extract(bare, ANNOTATIONS, 0), made)
    marked = title.rlike(f"(?i)[)\\]]{_S}*$|{_S}[{DASH}]{_S}|{_S}(?:feat\\.|ft\\.|featuring){_S}")
    none = F.array().cast("array<string>")
    plain = F.struct(T.strip_chars(bare, " -–—").alias("base"), none.alias("qualifiers"), none.alias("featured"), F.lit(None).cast("string").alias("version_label"))
    return F.when(title.isNull(), None).when(marked, peeled).otherwise(plain)
