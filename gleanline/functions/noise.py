"""Texts put in other dress on purpose, for tests of what should see through it; every draw is a digest, so a text always gets the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys beside each other, characters without a width, emoji.
KEYS = "qwertyuiopasdfghjklzxcvbnm"
BESIDE = "wertyuiopoasdfghjkllxcvbnmn"[:26]
ZERO_WIDTH = ["​", "‌", "‍", "﻿"]
EMOJI = ["🎵", "🔥", "✨", "💯"]
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F))


def draw(text: Column, seed: str, at: Column) -> Column:
    """A number in [0, 1) for a place of a text."""
    head = F.substring(F.md5(F.concat_ws("|", F.lit(seed), text, at.cast("string")).cast("binary")), 1, 6)
    return F.conv(head, 16, 10).cast("double") / 16777216


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _each(text: Column, change) -> Column:
    """A text with ``change(character, place)`` for every character."""
    return F.array_join(F.transform(_characters(text), change), "")


def _lines(text: Column, change) -> Column:
    """A text with ``change(line, number)`` for every line that isn't blank."""
    kept = lambda line, i: F.when(line.rlike(r"^\s*$"), line).otherwise(change(line, i))
    return F.array_join(F.transform(F.split(text, "\n", -1), kept), "\n")


def recase(text: Column, mode: str) -> Column:
    """A text in capitals ('upper'), small letters ('lower') or both by turns ('turns')."""
    if mode != "turns":
        return F.upper(text) if mode == "upper" else F.lower(text)
    return _each(text, lambda c, i: F.when(i % 2 == 0, F.upper(c)).otherwise(F.lower(c)))


def emoji(text: Column, seed: str = "emoji", rate: float = 0.5) -> Column:
    """Emoji at the end of some lines, or at their start."""
    pick = lambda i: F.element_at(F.array(*map(F.lit, EMOJI)), (F.floor(draw(text, f"{seed}-which", i) * len(EMOJI)) + 1).cast("int"))
    put = lambda line, i: F.when(draw(text, f"{seed}-where", i) < 0.7, F.concat_ws(" ", line, pick(i))).otherwise(F.concat_ws(" ", pick(i), line))
    return _lines(text, lambda line, i: F.when(draw(text, seed, i) < rate, put(line, i)).otherwise(line))


def zero_width(text: Column, seed: str = "zero", rate: float = 1 / 60) -> Column:
    """Characters without a width before some others."""
    pick = lambda i: F.element_at(F.array(*map(F.lit, ZERO_WIDTH)), (F.floor(draw(text, f"{seed}-which", i) * len(ZERO_WIDTH)) + 1).cast("int"))
    return _each(text, lambda c, i: F.when(draw(text, seed, i) < rate, F.concat(pick(i), c)).otherwise(c))


def full_width(text: Column, seed: str = "wide", rate: float = 0.4) -> Column:
    """Some printable ASCII characters in their full-width form."""
    return _each(text, lambda c, i: F.when(draw(text, seed, i) < rate, F.translate(c, _NARROW, _WIDE)).otherwise(c))


def typos(text: Column, seed: str = "typo", rate: float = 0.02) -> Column:
    """Some letters dropped, doubled, swapped with the next or hit beside the key; line ends stay."""
    slips = lambda i: draw(text, seed, i) < rate
    kind = lambda i: F.floor(draw(text, f"{seed}-kind", i) * 4)
    at = lambda i: F.coalesce(F.get(_characters(text), i), F.lit("\n"))
    swaps = lambda i: (i >= 0) & slips(i) & (kind(i) == 2) & (at(i) != "\n") & (at(i + 1) != "\n")
    turned = lambda i: swaps(i) & ~swaps(i - 1)
    beside = lambda c: F.translate(c, KEYS + KEYS.upper(), BESIDE + BESIDE.upper())
    slipped = lambda c, i: F.when(kind(i) == 0, "").when(kind(i) == 1, F.concat(c, c)).when(kind(i) == 2, F.when(turned(i), F.concat(at(i + 1), c)).otherwise(c)).otherwise(beside(c))
    return _each(text, lambda c, i: F.when(turned(i - 1), "").when((c != "\n") & slips(i), slipped(c, i)).otherwise(c))


def ragged(text: Column, seed: str = "ragged", rate: float = 0.3) -> Column:
    """Blanks before and after some lines."""
    blanks = lambda name, i: F.when(draw(text, f"{seed}-{name}", i) < rate, F.repeat(F.lit(" "), (F.floor(draw(text, f"{seed}-{name}-n", i) * 3) + 1).cast("int"))).otherwise("")
    return _lines(text, lambda line, i: F.concat(blanks("left", i), line, blanks("right", i)))
