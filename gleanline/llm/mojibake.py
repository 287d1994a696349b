"""Text decoded with the wrong encoding: found and, where no byte was lost, restored.

Round-trip repair: a garbled run is encoded again with the encoding that was wrongly used, decoded
strictly with the one that was meant, and accepted when the garbling cost drops; repeated for
nested layers.  Runs are handled one by one, since a text may be garbled in part only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

# Encodings that were wrongly used on UTF-8 bytes, the likeliest first.
WRONG_FOR_UTF8 = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-15", "cp1253", "cp1254"]
WRONG_WIDE = ["cp932"]
# Fixed values: (encoding wrongly used, encoding meant) where the meant one isn't UTF-8.
OTHER_PAIRS = [
    *[("latin-1", right) for right in ("cp1252", "cp1250", "cp1251", "cp932", "koi8-r")],
    *[(wrong, "cp1251") for wrong in ("cp1252", "mac_roman", "koi8-r", "cp866", "cp850", "cp437", "cp1250")],
    *[(wrong, "koi8-r") for wrong in ("cp1252", "cp1251", "mac_roman", "cp866")],
    *[(wrong, "cp866") for wrong in ("cp1252", "cp1251", "koi8-r", "mac_roman")],
    *[(wrong, "iso8859-5") for wrong in ("cp1252", "cp1251", "koi8-r")],
    *[(wrong, "cp932") for wrong in ("cp1252", "mac_roman", "cp1251", "cp437")],
    *[(wrong, "euc_jp") for wrong in ("cp1252", "mac_roman")],
    *[(wrong, "cp1253") for wrong in ("cp1252", "mac_roman", "cp1251")],
    *[(wrong, "cp1250") for wrong in ("cp1252", "mac_roman", "cp1251")],
    *[(wrong, "cp1252") for wrong in ("mac_roman", "cp437", "cp850", "cp1251", "cp1253", "cp1250", "cp932")],
    *[(wrong, right) for right in ("mac_roman", "cp437", "cp850") for wrong in ("cp1252",)],
]
# Letters that are rare in running text, and frequent ones of Central Europe.
LATIN_ODD = {"ì": 2.5, "ò": 2.0, "Ì": 2.5, "Ò": 2.0, "Ù": 2.0, "ù": 1.2, "ø": 1.2, "Ø": 1.2, "ï": 1.3, "ÿ": 2.0, "ð": 1.4, "þ": 1.4, "Ð": 1.6, "Þ": 1.4, "õ": 1.1, "Ï": 1.8, "Ë": 1.6, "Û": 1.6, "Î": 1.6, "Ý": 1.4, "Å": 1.3, "å": 1.2, "æ": 1.3, "Æ": 1.6}
CENTRAL = frozenset("ěščřžůťďňĚŠČŘŽŤĎŇŮąęłńśźżćőűŁŚŻŹĆŐŰğışœŒ")
#: A line whose characters beyond ASCII cost more than this on average is garbled, even if it can't be restored.
ODD_MEAN = 1.75
#: Symbols that texts mean.
MEANT = frozenset("♭♯→※′″─│┌┐└┘├┤┬┴┼◆℗™…−©®№±×÷°²³½¼¾§")
SCHEMA = StructType([StructField("garbled", BooleanType()), StructField("restored", StringType()), StructField("layers", IntegerType()), StructField("complete", BooleanType())])


@lru_cache(maxsize=None)
def _tables(name: str) -> tuple[dict[int, int], set[str]]:
    """Character to byte of a one-byte encoding, undefined bytes taken as the control of the same number."""
    table = {}
    for byte in range(128, 256):
        try:
            char = bytes([byte]).decode(name)
        except UnicodeDecodeError:
            char = chr(byte)
        if ord(char) >= 128:
            table.setdefault(ord(char), byte)
    return table, {chr(c) for c in table}


def recode(run: str, wrong: str) -> bytes | None:
    """The bytes that gave ``run`` under ``wrong``."""
    if wrong in WRONG_WIDE:
        try:
            return run.encode(wrong)
        except UnicodeEncodeError:
            return None
    table, chars = _tables(wrong)
    if not {c for c in run if c >= "\x80"} <= chars:
        return None
    return run.translate(table).encode("latin-1")


@lru_cache(maxsize=1 << 16)
def char_cost(char: str) -> float:
    """How odd a character is in running text."""
    c = ord(char)
    if c < 0x80:
        return 0.0
    if char in MEANT:
        return 1.0
    if c < 0xA0 or char == "�" or 0xE000 <= c <= 0xF8FF:
        return 6.0
    kind = unicodedata.category(char)
    if c < 0x100:
        return LATIN_ODD.get(char, 1.0) if kind in ("Ll", "Lu") else 1.5 if char in "«»¿¡ª°º·£§©® ½¼¾²³" else 2.5
    if 0x4E00 <= c <= 0x9FFF:
        return 1.5
    if 0x3040 <= c <= 0x30FF or 0xAC00 <= c <= 0xD7AF or 0x3000 <= c <= 0x3002 or c in (0x300C, 0x300D):
        return 1.0
    if char in "–—‘’“”„…•€™":
        return 1.0
    if c < 0x180:
        return 1.0 if char in CENTRAL else 1.4 if kind[0] == "L" else 2.5
    if 0x370 <= c < 0x400 or 0x410 <= c < 0x450 or c in (0x401, 0x451):
        return 1.0
    if 0x400 <= c < 0x530:
        return 1.4 if char in "іїєґІЇЄҐ" else 2.5
    if kind in ("Ll", "Lu", "Lo", "Lt"):
        return 4.0
    if kind in ("So", "Sm", "Sc", "Sk", "Lm", "Po", "Pf", "Pi", "Ps", "Pe", "Pd", "No", "Nl"):
        return 2.5 if c < 0x1F000 else 1.0
    return 4.0


def cost(text: str) -> float:
    """Garbling cost: odd characters, switches of script or to capitals inside words, accents side by side."""
    total, before, last = 0.0, "", ""
    for char in text:
        total += char_cost(char)
        now = _kind(char)
        if before and now:
            if before.lower() != now.lower():
                total += 2.0 if "k" in (before, now) and {before, now} & {"l", "L"} else 0.0 if before + now in ("jk", "kj") else 1.0
            elif now.isupper():
                total += 0.6 if before.islower() else 0.5 if now == "C" else 0.0
            if now in "lL" and last >= "\x80" and char >= "\x80":
                total += 0.8
        elif last and (before and "─" <= char <= "▟" or now and "─" <= last <= "▟"):
            total += 1.5
        elif last and char >= "\x80" and (before or now) and char in SIGNS_INSIDE | {last} & SIGNS_INSIDE:
            total += 0.3
        before, last = now, char
    for word in _CYRILLIC_WORD.findall(text):
        if not _VOWEL.search(word):
            total += 2.0
        total += 1.5 * len(_HARD.findall(word))
    return total


SIGNS_INSIDE = frozenset("‚„ƒ†‡ˆ‰‹›˜¯¸·")
_CYRILLIC_WORD = re.compile("[Ѐ-ӿ]{3,}")
_VOWEL = re.compile("[аеёиоуыэюяіїєАЕЁИОУЫЭЮЯІЇЄ]")
_HARD = re.compile("[бвгджзйклмнпрстфхцчшщъьБВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ]{5,}|[ыъьЫЪЬ](?=[ыъьЫЪЬ])|(?<![а-яёА-ЯЁ])[ыьъЬЪ]")


@lru_cache(maxsize=1 << 16)
def _kind(char: str) -> str:
    if not char.isalpha():
        return ""
    c = ord(char)
    if 0x370 <= c < 0x400:
        return "g"
    if 0x400 <= c < 0x530:
        return "c" if char.islower() else "C"
    if 0x4E00 <= c <= 0x9FFF:
        return "k"
    if c >= 0x2E80:
        return "j"
    return "L" if char.isupper() else "l"


@lru_cache(maxsize=None)
def _utf8_runs(wrong: str) -> re.Pattern:
    """Runs of characters that are well-formed UTF-8 under ``wrong``."""
    table, _ = _tables(wrong)
    by_byte: dict[int, list[str]] = {}
    for code, byte in table.items():
        by_byte.setdefault(byte, []).append(chr(code))

    def some(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for b in range(low, high + 1) for c in by_byte.get(b, [])) + "]"

    tail = some(0x80, 0xBF)
    return re.compile(f"(?:{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{{2}}|{some(0xF0, 0xF4)}{tail}{{3}})+")


_DRAWN = re.compile("[─-▟]+")
# The letters that Cyrillic alphabets have beside the Russian ones (Russian, Ukrainian, Belarusian, Serbian, Macedonian).
CYRILLIC_ALPHABETS = [frozenset(""), frozenset("іїєґ"), frozenset("іў"), frozenset("ђјљњћџ"), frozenset("ѓѕјљњќџ")]
_RUSSIAN = frozenset("абвгдежзийклмнопрстуфхцчшщъыьэюяё")


def _is_spelt(run: str) -> bool:
    """Whether a run reads as part of a Cyrillic word: letters of one alphabet, cased as words are, with a vowel.

    UTF-8 read as a Cyrillic encoding has signs, stray capitals or letters of several alphabets in it; only a lone
    ideograph can come out like this, and then nothing tells it from a word.
    """
    if not run.isalpha() or not (run.islower() or run.isupper() or run.istitle()):
        return False
    others = frozenset(run.lower()) - _RUSSIAN
    return any(others <= alphabet for alphabet in CYRILLIC_ALPHABETS) and bool(_VOWEL.search(run)) and not _HARD.search("а" + run)


def _word_around(text: str, start: int, end: int) -> tuple[str, str]:
    """The letters beside a run, and one character where there are none; a word longer than any language's is seen in part."""
    first, last = start, end
    while first > 0 and start - first < 40 and text[first - 1].isalpha():
        first -= 1
    while last < len(text) and last - end < 40 and text[last].isalpha():
        last += 1
    return text[min(first, max(0, start - 1)) : start], text[end : max(last, end + 1)]


def _better(text: str, start: int, end: int, new: str, share: float = 0.75) -> bool:
    """Whether putting ``new`` for a run lowers the cost, both beside the next characters and in the word around it, whose own cost counts on neither side."""
    own = text[start:end]
    left, right = _word_around(text, start, end)
    near = {_kind(c) for c in left[-1:] + right[:1]} - {""}
    if _is_spelt(own) and near <= {"c", "C"} and (near or not _is_spelt(new)):
        return False
    if cost(left[-1:] + new + right[:1]) >= share * cost(left[-1:] + own + right[:1]):
        return False
    beside = cost(left) + cost(right)
    return cost(left + new + right) - beside < share * (cost(left + own + right) - beside)


def _repair_run(run: str, left: str, right: str) -> tuple[str, int, str]:
    """As ``_run_repaired``; short runs recur and are remembered."""
    return (_run_remembered if len(run) <= 100 else _run_repaired)(run, left, right)


def _run_repaired(run: str, left: str, right: str) -> tuple[str, int, str]:
    """One layer of UTF-8 read as a one-byte encoding undone in a run of characters beyond ASCII, by the encoding that leaves the least cost."""
    text, best, least, done, by = left + run + right, run, float("inf"), 0, ""
    for wrong in WRONG_FOR_UTF8:
        count = 0

        def fix(match: re.Match, wrong: str = wrong) -> str:
            nonlocal count
            own, start, end = match.group(), match.start(), match.end()
            if _DRAWN.fullmatch(own) and not (text[max(0, start - 1) : start].isalpha() or text[end : end + 1].isalpha()):
                return own
            try:
                new = recode(own, wrong).decode("utf-8")
            except UnicodeDecodeError:
                return own
            if not _better(text, start, end, new):
                return own
            count += 1
            return new

        new = _utf8_runs(wrong).sub(fix, text)
        if count and (now := cost(new)) < least - 1e-9:
            best, least, done, by = new[len(left) : len(new) - len(right)], now, count, wrong
    return best, done, by


_run_remembered = lru_cache(maxsize=1 << 16)(_run_repaired)
_LONG_RUN = re.compile(r"[^\x00-\x7f]{2,}")


def _repair_utf8(text: str) -> tuple[str, int]:
    """One layer of UTF-8 read as a one-byte encoding undone, run by run.

    What proved to be the wrong encoding of a run is taken for it in the text's other runs too, however
    little they gain.
    """
    done, used = 0, set()

    def fix(match: re.Match) -> str:
        nonlocal done
        start, end = match.span()
        new, count, by = _repair_run(match.group(), text[max(0, start - 1) : start], text[end : end + 1])
        done += count
        used.update({by} - {""})
        return new

    def take(match: re.Match) -> str:
        try:
            return recode(match.group(), wrong).decode("utf-8")
        except UnicodeDecodeError:
            return match.group()

    new = _LONG_RUN.sub(fix, text)
    if len(used) == 1 and (wrong := used.pop()) in ("cp437", "cp850", "mac_roman"):
        new = _utf8_runs(wrong).sub(lambda m: take(m) if len(m.group()) <= 3 else m.group(), new)
    return new, done


@lru_cache(maxsize=None)
def _pattern_odd() -> re.Pattern:
    return re.compile("[\x80-\x9f\ufffd\ue000-\uf8ff]")


def _repair_wide(text: str) -> tuple[str, int]:
    """UTF-8 read as a two-byte encoding, run by run."""
    done = 0

    def fix(match: re.Match) -> str:
        nonlocal done
        run = match.group()
        for wrong in WRONG_WIDE:
            data = recode(run, wrong)
            try:
                new = data.decode("utf-8") if data else run
            except UnicodeDecodeError:
                continue
            if new != run and _better(match.string, match.start(), match.end(), new):
                done += 1
                return new
        return run

    return _LONG_RUN.sub(fix, text), done


def _repair_line(line: str) -> tuple[str, int]:
    """A line of one encoding read as another, neither of them UTF-8."""
    odd = [c for c in line if c >= "\x80"]
    if len(odd) < 2:
        return line, 0
    best, least = line, 0.75
    before = cost(line)
    if before <= 1.12 * len(odd):
        return line, 0
    encoded: dict[str, bytes | None] = {}
    for wrong, right in OTHER_PAIRS:
        if wrong not in encoded:
            encoded[wrong] = recode(line, wrong)
        data = encoded[wrong]
        if data is None:
            continue
        try:
            new = data.decode(right)
        except UnicodeDecodeError:
            continue
        if new == line or right == "cp1250" and any(a != b and not (a.isalpha() or b in "„“”‚‘’–—…•š žŠŽťŤśŚźŹ") for a, b in zip(line, new)):
            continue
        after = cost(new)
        same = sum(char_cost(a) for a, b in zip(line, new) if a == b) if len(line) == len(new) else 0.0
        share = (after - same) / max(before - same, 0.01)
        if before - after >= 1.5 and share < least:
            best, least = new, share
    return best, int(best != line)


#: A letter lost to a question mark inside a word; one alone may be a slip.
_LOST = re.compile(r"(?<![^\W\d_]/)(?<=[a-zß-ÿа-я])\?(?=[a-zß-ÿа-я]+(?![\w=&/]))")
SUSPECT = r"[^\x00-\x7F]|[a-z]\?[a-z](?s:.*)[a-z]\?[a-z]"


def _layers_undone(line: str) -> tuple[str, int]:
    """A line with all layers undone, and their number.

    Runs of UTF-8 come first; where they leave something odd, the whole line under another pair of
    encodings is weighed against them.
    """
    now, layers = line, 0
    while True:  # ends: every layer undone leaves fewer characters
        now, done = _repair_utf8(now)
        now, more = _repair_wide(now)
        if not done + more:
            break
        layers += 1
    if layers and not _odd_line(now) and not _pattern_odd().search(now):
        return now, layers
    whole, done = _repair_line(line)
    if layers and done and cost(whole) < cost(now):
        return whole, 1
    now, done = _repair_line(now)
    return now, layers + done


_layers_remembered = lru_cache(maxsize=1 << 12)(_layers_undone)


def _repair_layers(line: str) -> tuple[str, int]:
    """As ``_layers_undone``; lines of usual length recur and are remembered."""
    return (_layers_remembered if len(line) <= 1000 else _layers_undone)(line)


#: Lines of these characters alone, without a pair that UTF-8 read wrongly makes, without four accented letters side by
#: side and without one at every other place, show no garbling; most lines are.
_PLAIN = re.compile("[\x00-\x7fáéíóúýàâêôèëîïûœäöüßñçãõÁÉÍÓÚÀÂÊÈÄÖÜÑÇÃÕěščřžůťďň«»¿¡“”„’–—…€♭♯→]*")
_PAIRED = re.compile(r"[À-ÿ][\x80-\xbf‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸ€]|[à-ÿÀ-ß]{4}|([À-ÿ]).\1.\1")


def _is_plain(line: str) -> bool:
    return line.isascii() or _PLAIN.fullmatch(line) is not None and not _PAIRED.search(line)


#: What is left where only part of a run could be restored: the start of a UTF-8 sequence without its end.
_REST = re.compile("[ÃÂ](?![a-zà-ÿ])(?=[^\\x00-\\x7f])|(?<![^\\W\\d_])Ã(?=[^\\W\\d_]?[^\\x00-\\x7f])|â€|[ÐÑ][^\\x00-\\x7fa-zð-ÿ]|ГЂ|вЂ|├[^\\x00-\\x7f─-▟]|‚Ä")


def shows_loss(text: str) -> bool:
    """Whether a text shows bytes that a wrong decoding lost or could not read.

    A rule of its own beside the round trip, which needs every byte: replacement characters, controls and
    private characters, letters inside words that became question marks (two or more), or a line whose
    characters beyond ASCII cost more than ``ODD_MEAN`` on average.
    """
    if len(_LOST.findall(text)) > 1 or _pattern_odd().search(text):
        return True
    return any(_odd_line(line) for line in text.split("\n") if not _is_plain(line))


def repair(text: str | None) -> tuple[bool, str | None, int, bool]:
    """Whether a text is garbled, its best restoration, the layers undone, and whether nothing odd is left.

    A text is garbled when a round trip lowers its cost, or when it shows bytes that were lost
    (``shows_loss``).  Null and empty texts are not garbled.  Characters that no garbling explains are kept.
    """
    if not text or text.isascii() and len(_LOST.findall(text)) < 2:
        return False, text, 0, True
    lines, layers = [], 0
    for line in text.split("\n"):
        new, done = (line, 0) if _is_plain(line) else _repair_layers(line)
        lines.append(new)
        layers = max(layers, done)
    now = "\n".join(lines)
    lost = shows_loss(now)
    return bool(layers or lost), now, layers, not (lost or layers and _REST.search(now))


def _odd_line(line: str) -> bool:
    signs = [c for c in line if c >= "\x80" and c not in MEANT]
    return len(signs) > 1 and cost("".join(c if c < "\x80" or c not in MEANT else " " for c in line)) > ODD_MEAN * len(signs)


def repaired(documents: DataFrame) -> DataFrame:
    """``doc_id, garbled, restored, layers, complete`` of every document.

    ``restored`` equals the text where nothing is garbled; null stays null.  Repeated rows stay
    repeated and other columns are left out.  ASCII texts never reach Python; no shuffle.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([repair(text) for text in batch], columns=SCHEMA.names)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    fix = F.pandas_udf(run, SCHEMA)
    beyond = F.coalesce(F.col("text").rlike(SUSPECT), F.lit(False))
    odd = documents.where(beyond).select("doc_id", fix("text").alias("r")).select("doc_id", "r.*")
    plain = documents.where(~beyond).select("doc_id", F.lit(False).alias("garbled"), F.col("text").alias("restored"), F.lit(0).alias("layers"), F.lit(True).alias("complete"))
    return odd.unionByName(plain)


def found(documents: DataFrame) -> DataFrame:
    """The documents whose text, wholly or in part, shows a wrong decoding."""
    return repaired(documents.where(F.col("text").rlike(SUSPECT))).where("garbled").select("doc_id")
