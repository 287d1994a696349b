"""SQL for what the queries' SQL shares."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from gleanline.functions.normalize import fold_text


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, dict[str, str], str]:
    """Characters that fold to one, what they fold to, those that fold to several, and those that fold to nothing; by the rule that ``fold_text`` states."""
    one, many, none = {}, {}, []
    for code in [*range(0x80, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        char = chr(code)
        if 0xD800 <= code < 0xF900 or 0x4E00 <= code < 0xA000 or char.lower() != char or unicodedata.category(char) in ("Cn", "Co"):
            continue
        form = fold_text(f"x{char}y")[1:-1]
        if len(form) == 1 and form != char:
            one[char] = form
        elif not form:
            none.append(char)
        elif len(form) > 1 and (code < 0x530 or 0xFB00 <= code < 0xFB07):
            many[char] = form
    return "".join(one), "".join(one.values()), many, "".join(none)


def fold(x: str) -> str:
    """The comparison key of an SQL expression, for every text."""
    left, right, many, none = _tables()
    quoted = lambda s: s.replace("'", "''")
    out = f"lower({x})"
    for char, form in many.items():
        out = f"replace({out}, '{quoted(char)}', '{quoted(form)}')"
    out = f"translate({out}, '{quoted(left + none)}', '{quoted(right)}')"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
