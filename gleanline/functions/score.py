"""Scores of parsed items and of match candidates, in the order of addition that gives equal doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the confidence score.
BASE = {"csv": 0.97, "csv_headerless": 0.80, "quoted": 0.95, "by": 0.92, "dash": 0.90, "tab": 0.93, "bare": 0.55}
AMBIGUOUS, NO_ARTIST, SHORT, DEGENERATE, WITH_ISRC, WITH_LENGTH, STRUCTURED = -0.12, -0.25, -0.05, -0.35, 0.03, 0.02, 0.02
CEILING = {"deterministic": 1.0, "hybrid": 1.0, "llm_grounded": 0.85, "llm_ungrounded": 0.0}
REVIEW, NOT_FOUND = 0.8, 0.5
# Fixed values of the match score.
WEIGHTS = {"title": 0.5, "artist": 0.3, "length": 0.1, "qualifiers": 0.1}
TIE = 1e-9


def compensated_sum(values: Column) -> Column:
    """Sum of an array of doubles with the rounding errors carried along."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(acc: Column, x: Column) -> Column:
        total = acc["s"] + x
        lost = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - total) + x).otherwise((x - total) + acc["s"])
        return F.struct(total.alias("s"), (acc["c"] + lost).alias("c"))

    return F.aggregate(values, start, add, lambda acc: acc["s"] + acc["c"])


def confidence(parser: Column, title: Column, artist: Column, has_isrc: Column, has_length: Column, ambiguous: Column, structured: Column, method: str = "deterministic") -> Column:
    """Confidence of a parsed item: its parser's base and the adjustments that hold, within [0, ceiling]."""
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair]), parser), F.lit(BASE["bare"]))
    one = lambda test, value: F.when(test, F.lit(value))
    from gleanline.functions.text import word_count

    changes = F.filter(
        F.array(
            one(ambiguous, AMBIGUOUS), one(F.coalesce(artist, F.lit("")) == "", NO_ARTIST), one(word_count(title) == 1, SHORT),
            one(~title.rlike(r"[\p{L}\p{N}]"), DEGENERATE), one(has_isrc, WITH_ISRC), one(has_length, WITH_LENGTH), one(structured, STRUCTURED),
        ),
        lambda x: x.isNotNull(),
    )
    return F.least(F.greatest(base + compensated_sum(changes), F.lit(0.0)), F.lit(1.0), F.lit(CEILING[method]))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Shared tokens against the smaller set; two empty sets are equal, one empty set shares nothing."""
    x, y = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(x, y))


def artist_similarity(a: Column, b: Column, tokens_a: Column, tokens_b: Column) -> Column:
    """Of folded artists; an unknown one is half alike."""
    return F.when(a.isNull() | b.isNull(), 0.5).when(a == b, 1.0).otherwise(token_set_ratio(tokens_a, tokens_b))


def length_similarity(a: Column, b: Column, tolerance: float = 3.0) -> Column:
    """Of seconds: 1 within the tolerance, falling to 0 at four times it; an unknown one is half alike."""
    gap = F.abs(a - b)
    return F.when(gap.isNull(), 0.5).when(gap <= tolerance, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (gap - tolerance) / (3 * tolerance)))


def qualifier_similarity(wanted: Column, offered: Column) -> Column:
    """Each wanted qualifier that is missing costs a quarter, each unwanted one a half."""
    missing, extra = F.size(F.array_except(wanted, offered)), F.size(F.array_except(offered, wanted))
    return F.greatest(F.lit(0.0), 1 - 0.25 * missing - 0.5 * extra)


def match_score(title: Column, artist: Column, length: Column, qualifiers: Column) -> Column:
    """Weighted sum of the four similarities."""
    return WEIGHTS["title"] * title + WEIGHTS["artist"] * artist + WEIGHTS["length"] * length + WEIGHTS["qualifiers"] * qualifiers


def verdict(score: Column, unwanted: Column) -> Column:
    """What a score allows; an unwanted qualifier keeps a good one for review."""
    return F.when((score >= REVIEW) & ~unwanted, "auto_accept").when(score >= NOT_FOUND, "review").otherwise("not_found")


def best_of(scored: Column) -> Column:
    """The best of an array of ``struct<pos, score, popularity, ...>`` in order of ``pos``.

    Scores that differ by no more than ``TIE`` are equal, and the more popular one wins, else the first;
    the relation isn't transitive, so the array is folded in order.
    """
    ordered = F.array_sort(scored)
    popular = lambda s: F.coalesce(s["popularity"], F.lit(0.0))

    def better(best: Column, x: Column) -> Column:
        gap = x["score"] - best["score"]
        return F.when(gap > TIE, x).when((F.abs(gap) <= TIE) & (popular(x) > popular(best)), x).otherwise(best)

    return F.when(F.size(ordered) > 0, F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.element_at(ordered, 1), better))


def share_pct(used: Column, allowance: Column) -> Column:
    """Percent of an allowance; using any of none is infinite."""
    return F.when(allowance > 0, 100.0 * used / allowance).when(used > 0, F.lit(float("inf"))).otherwise(0.0)


def mark(pct: Column, gate: Column, modelled: Column) -> Column:
    """How a share of an allowance reads in a report: beyond its gate, beyond two thirds of it, or below; a dot where nothing is modelled."""
    return F.when(~modelled, "·").when(pct > gate, "FAIL").when(pct > gate * (2.0 / 3.0), "watch").otherwise("ok")


def shown_number(value: Column) -> Column:
    """A number for a report: thousands without decimals, from one two decimals if any, below that two significant figures."""
    large = F.format_number(value, 0)
    middle = F.regexp_replace(F.format_string("%.2f", value), r"\.00$", "")
    places = F.least(F.lit(12), -F.floor(F.log10(F.abs(value))).cast("int") + 1)
    small = F.format_string("%s", F.round(value * F.pow(F.lit(10.0), places), 0) / F.pow(F.lit(10.0), places))
    return F.when(value == 0, "0").when(F.abs(value) >= 1000, large).when(F.abs(value) >= 1, middle).when(F.abs(value) == float("inf"), "∞").otherwise(small)
