"""Text that looks the same but is made of other characters, brought to one form.

The skeleton decomposes a text, replaces every character by its prototype from the look-alike table
and decomposes again; texts that look alike have equal skeletons.  The table is Unicode's own, read
from the ICU library that Spark ships.  The consistent form uses the same table word by word: a word
keeps the script it is written in, and only its stray characters are replaced.  Spaces become plain,
invisible characters go, accents are composed.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Capital and small letters of everyday Cyrillic and Greek that look exactly like Latin ones.  Only these leave a
# word's script open; any other letter of a script, a look-alike or not, shows it.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜҺаеѕіјорсухһԛԝԁӏү", "ABESIJKMHOPCTYXYGQWHaesijopcyxhqwdly", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονϲ", "ABEZHIKMNOPTYXCjovc", strict=True))
# Letters within the Latin script that look like basic ones.
LATIN = dict(zip("ɑɡɩʏᴏᴠᴡᴢᴄꜱʙɢʜɪʟɴʀ", "agiyovwzcsBGHILNR", strict=True))
EVERYDAY = CYRILLIC | GREEK | LATIN
FROM_LATIN = {"Cyrillic": {}, "Greek": {}}
for _name, _table in (("Cyrillic", CYRILLIC), ("Greek", GREEK)):
    for _own, _latin in _table.items():
        FROM_LATIN[_name].setdefault(_latin, _own)
#: Latin letters that everyday Cyrillic or Greek letters look like; any other Latin letter shows that its word is Latin.
SHARED = frozenset("ABCEHIKMNOPTXYZaceopxyv")
#: Characters without a width that are taken away; joiners and variation selectors stay beside emoji.
_JOINERS = "‌‍︎️"
_FILLERS = "͏ᅟᅠㅤﾠ឴឵᠎"


@lru_cache(maxsize=1 << 16)
def script(char: str) -> str:
    """Latin, Cyrillic, Greek or another script's name by the character's own name; empty for marks and signs."""
    if not char.isalpha():
        return ""
    name = unicodedata.name(char, "").split(" ", 1)[0]
    return {"LATIN": "Latin", "CYRILLIC": "Cyrillic", "GREEK": "Greek"}.get(name, "Latin" if char in "KÅ" else name)


@lru_cache(maxsize=1 << 16)
def plain(char: str) -> str:
    """A character without its presentation: full width, mathematical letters, ligatures, roman numerals, odd spaces, nothing visible."""
    kind = unicodedata.category(char)
    if kind == "Zs":
        return " "
    if kind == "Cf" or char in _FILLERS or kind == "Cc" and char not in "\t\n\r" or "︀" <= char <= "️" or 0xE0100 <= ord(char) <= 0xE01EF:
        return ""
    if char in LATIN:
        return LATIN[char]
    if kind == "Cn" and 0x1D400 <= ord(char) < 0x1D6A4:  # holes in the mathematical alphabets, filled by rule
        at = (ord(char) - 0x1D400) % 52
        return chr((65 if at < 26 else 71) + at)
    shape = unicodedata.decomposition(char)
    if shape.startswith("<"):
        tag = shape[1 : shape.index(">")]
        if tag in ("wide", "narrow", "font") or tag in ("compat", "initial", "medial", "final", "isolated") and kind[0] in "LN":
            return unicodedata.normalize("NFKC", char)
        return char
    return char


def _odd_class(letters: Iterable[str]) -> str:
    """A character class of everything that ``plain`` or composing may change, and of the letters with look-alikes."""
    odd = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and (plain(chr(c)) != chr(c) or unicodedata.normalize("NFC", chr(c)) != chr(c) or unicodedata.combining(chr(c)))]
    odd += [ord(c) for c in letters]
    odd = sorted(set(odd))
    spans, start = [], odd[0]
    for before, now in zip(odd, [*odd[1:], sys.maxunicode + 2]):
        if now != before + 1:
            spans.append((start, before))
            start = now
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
_EMOJI = re.compile(r"[☀-➿⬀-⯿🀀-🫿#*0-9‍️]")


def _verdict(word: str) -> str | None:
    """The script that a word's unmistakable letters are in; None where all letters have look-alikes."""
    votes: dict[str, int] = {}
    for char in unicodedata.normalize("NFD", word):
        own = script(char)
        if not own:
            continue
        if own == "Latin":
            clear = char not in SHARED
        else:
            clear = char not in EVERYDAY
        if clear:
            votes[own] = votes.get(own, 0) + 1
    if not votes:
        return None
    return max(votes, key=lambda s: (votes[s], s == "Latin"))


class Lookalikes:
    """Prototypes by character, and what follows from them: skeletons and consistent forms."""

    def __init__(self, prototypes: dict[str, str] | None = None, pattern: str | None = None) -> None:
        self.prototypes = dict(EVERYDAY if prototypes is None else prototypes)
        basic = {}
        for latin in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
            basic.setdefault((self.prototypes.get(latin, latin), latin.isupper()), latin)
        #: Letters of other scripts and the basic Latin letter of their case that they look like.
        self.to_latin = {}
        for char, prototype in self.prototypes.items():
            if char > "\x7f" and script(char) not in ("", "Latin"):
                cased = char.isupper() or unicodedata.category(char) == "Lo" and prototype.isupper()
                if (prototype, cased) in basic:
                    self.to_latin[char] = basic[prototype, cased]
        self.to_latin |= EVERYDAY
        self._pattern = pattern and re.compile(pattern)

    def __reduce__(self):
        return Lookalikes, (self.prototypes, self.odd().pattern)  # workers needn't work it out again

    def odd(self) -> re.Pattern:
        """Matches text that the consistent form may change."""
        if self._pattern is None:
            other = "\u0370-\u052f"
            self._pattern = re.compile(f"[{_odd_class(self.to_latin)}\x00-\x08\x0b\x0c\x0e-\x1f\x7f\u1100-\u11ff]|[A-Za-z][{other}]|[{other}][A-Za-z]")
        return self._pattern

    def skeleton(self, text: str | None) -> str | None:
        """Equal for texts that look alike: decomposed, replaced by prototypes, decomposed again; null stays null."""
        if text is None:
            return None
        apart = unicodedata.normalize("NFD", "".join(plain(c) for c in unicodedata.normalize("NFD", text)))
        return unicodedata.normalize("NFD", "".join(self.prototypes.get(c, c) for c in apart))

    def consistent(self, text: str | None) -> str | None:
        """The consistent form; null stays null, and text without odd characters is returned as it is."""
        if not text or not self.odd().search(text):
            return text
        out = []
        for i, char in enumerate(text):
            if char < "\x7f" and (char >= " " or char in "\t\n\r"):
                out.append(char)
            elif char in _JOINERS and i and _EMOJI.match(text[i - 1]) and (char in "︎️" or i + 1 < len(text) and _EMOJI.match(text[i + 1])):
                out.append(char)
            elif char in "‌‍" and i and 0x0600 <= ord(text[i - 1]) <= 0x0DFF:
                out.append(char)  # joiners are spelling in these scripts
            else:
                out.append(plain(char))
        lines = unicodedata.normalize("NFC", "".join(out)).split("\n")
        return unicodedata.normalize("NFC", "\n".join(self._words(line) for line in lines))

    def _respell(self, word: str, target: str) -> str:
        if target == "Latin":
            return "".join(self.to_latin.get(c, c) for c in word)
        table = FROM_LATIN.get(target)
        if table is None:
            return word
        return "".join(table.get(EVERYDAY.get(c, c), c) if script(c) != target else c for c in word)

    def _words(self, line: str) -> str:
        """Every word in the letters of its script; an unmistakable word nearby decides for one that could be either."""
        matches = list(_WORD.finditer(line))
        if not matches:
            return line
        found = [{script(c) for c in match.group()} - {""} for match in matches]
        mixed = [bool(s & {"Cyrillic", "Greek"}) or "Latin" in s and len(s) > 1 for s in found]
        verdicts = [_verdict(m.group()) if x or s == {"Latin"} else "other" for m, s, x in zip(matches, found, mixed, strict=True)]
        out, last = [], 0
        for i, match in enumerate(matches):
            word, verdict = match.group(), verdicts[i]
            if mixed[i]:
                if verdict is None:
                    near = [(abs(j - i), v != "Latin", v) for j, v in enumerate(verdicts) if v in ("Latin", "Cyrillic", "Greek")]
                    verdict = min(near)[2] if near else "Latin" if "Latin" in found[i] else min(found[i])
                word = self._respell(word, verdict)
            out += [line[last : match.start()], word]
            last = match.end()
        return "".join(out) + line[last:]


EVERYDAY_ONLY = Lookalikes()


@lru_cache(maxsize=1)
def _icu(jvm) -> Lookalikes:
    chars = [chr(c) for c in range(0x21, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co", "Cc") and (c < 0x3400 or c > 0x4DBF and not 0x4E00 <= c < 0xA000 and not 0xAC00 <= c < 0xD7B0)]
    checker = jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    plains = [unicodedata.normalize("NFD", c) for c in chars]
    whole = checker.getSkeleton(0, "\n".join(chars)).split("\n")
    return Lookalikes({c: p for c, d, p in zip(chars, plains, whole, strict=True) if p != d and len(d) == 1})


def table_of(spark: SparkSession) -> Lookalikes:
    """Unicode's look-alike table as the session's ICU library has it: some thousands of entries, whatever the data."""
    return _icu(spark._jvm)


def _mapped(function):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(function)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, StringType())


def fields(seed: DataFrame, cases: DataFrame) -> DataFrame:
    """``tbl, rec_id, field_name, value`` of the three text fields."""
    titles = seed.select(
        F.lit("seed_row").alias("tbl"), F.col("row_id").alias("rec_id"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(n).alias("value")) for n in ("title", "artist")])).alias("f"),
    ).select("tbl", "rec_id", "f.*")
    texts = cases.select(F.lit("printed_case").alias("tbl"), F.col("case_no").alias("rec_id"), F.lit("text").alias("field_name"), F.col("text").alias("value"))
    return titles.unionByName(texts)


#: Text that may change: anything beyond ASCII, or a control character.
SUSPECT = r"[^\t\n\r\x20-\x7E]"


def cleaned(values: DataFrame) -> DataFrame:
    """``values`` with ``skeleton`` and ``clean`` (consistent form).

    Null stays null and empty stays empty; repeated rows stay repeated.  Plain ASCII is its own clean form,
    and its skeleton is made in the JVM; no shuffle.
    """
    looks = table_of(values.sparkSession)
    suspect = F.coalesce(F.col("value").rlike(SUSPECT), F.lit(False))
    odd = values.where(suspect).withColumns({"skeleton": _mapped(looks.skeleton)("value"), "clean": _mapped(looks.consistent)("value")})
    plain_skeleton = F.col("value")
    for char, prototype in sorted(looks.prototypes.items(), key=lambda e: (len(e[1]) > 1, e[0])):
        if char < "\x7f":
            plain_skeleton = F.replace(plain_skeleton, F.lit(char), F.lit(prototype))
    return odd.unionByName(values.where(~suspect).withColumns({"skeleton": plain_skeleton, "clean": F.col("value")}))


def groups(values: DataFrame) -> DataFrame:
    """Values grouped by equal skeleton: ``skeleton, forms`` (distinct spellings), ``copies`` and ``clean``, the consistent form that most copies have (then the least)."""
    distinct = values.where("value is not null").groupBy("value").agg(F.count("*").alias("copies"))
    forms = cleaned(distinct).groupBy("skeleton", "clean").agg(F.count("*").alias("forms"), F.sum("copies").alias("copies"))
    best = F.min(F.struct((-F.col("copies")).alias("n"), "clean"))["clean"]
    return forms.groupBy("skeleton").agg(F.sum("forms").alias("forms"), F.sum("copies").alias("copies"), best.alias("clean"))


def found(values: DataFrame) -> DataFrame:
    """Fields with a character to be replaced, composed or removed: ``tbl, rec_id, field_name``.

    Candidates are values that their skeleton changes or that aren't composed; the consistent form, which
    leaves genuine letters of other scripts alone, is the exact check after it.
    """
    looks = table_of(values.sparkSession)

    def verdict(value: str) -> bool:
        changed = looks.skeleton(value) != value or unicodedata.normalize("NFC", value) != value
        return changed and looks.consistent(value) != value

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(verdict)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    odd = values.where(F.col("value").rlike(SUSPECT))
    return odd.where(F.pandas_udf(run, "boolean")("value")).select("tbl", "rec_id", "field_name")
