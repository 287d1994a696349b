import math
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanline.functions import normalize as N
from gleanline.functions import score as S
from gleanline.functions import text as T


def column(spark, values, make, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.select("i", make(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_strip_and_words_follow_unicode_spaces(spark):
    texts = ["  a b ", "\x1c\x85　x y\t", "", "   ", None, "﻿a"]
    assert column(spark, texts, T.strip) == [None if t is None else t.strip() for t in texts]
    assert column(spark, texts, T.word_count) == [None if t is None else len(t.split()) for t in texts]


def test_codes_and_clocks(spark):
    assert column(spark, ["us-rc1-76-07839", "USRC17607839 ", "US12", "", None], T.isrc) == ["USRC17607839", "USRC17607839", None, None, None]
    assert column(spark, ["3:07", "1:02:03", "61:00", "3:60", "x", "", None], T.clock_seconds) == [187.0, 3723.0, 3660.0, None, None, None, None]


def test_names_and_credits(spark):
    assert column(spark, ["Doja Cat, SZA & Rosalia", "A x B vs. C", "Malcolm X", " ; ", "and"], T.split_names) == [["Doja Cat", "SZA", "Rosalia"], ["A", "B", "C"], ["Malcolm"], [], []]
    got = column(spark, ["Calvin Harris feat. Dua Lipa", "by  A (ft. B & C)", "- A & B -", None], T.credits)
    assert [None if g is None else (g.primary, g.featured) for g in got] == [("Calvin Harris", ["Dua Lipa"]), ("A", ["B", "C"]), ("A & B", []), None]


def test_spans_count_code_points(spark):
    frame = spark.createDataFrame([("a🎵bc", 1, 3)], "t string, s int, e int")
    assert frame.select(T.slice_span(F.col("t"), F.col("s"), F.col("e")), T.within(F.col("t"), F.col("e"))).first()[:] == ("🎵b", True)


def test_non_latin(spark):
    assert column(spark, ["é — “x”", "Ночь", "夜", "→ ★", "", None], T.has_non_latin) == [False, True, True, False, False, None]


def test_keys_hold_no_text(spark):
    frame = spark.createDataFrame([("t", "a", "us-rc1-76-07839"), ("t", None, "bad")], "t string, a string, i string")
    keys = frame.select(F.coalesce(T.isrc_key(F.col("i")), T.text_key(F.col("t"), F.col("a"))).alias("k")).select("k", T.is_neutral_key(F.col("k"))).collect()
    assert keys[0][0] == "isrc#USRC17607839" and all(r[1] for r in keys)


def test_ranges_and_mail(spark):
    assert column(spark, ["U+0041-005A", "U+20", "x"], T.code_point_range)[:2] == [(65, 90), (32, 32)]
    assert column(spark, ["write to a.b@c.org now"], T.redact_mail) == ["write to [redacted] now"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20))
def test_normalizing_twice_changes_nothing(text):
    once = N.normalize_text(text)
    assert N.normalize_text(once) == once and "\r" not in once


def test_normalizing_moves_marks_together():
    assert N.normalize_text("´\x1f᩿") == " ᩿́"


def test_fold_agrees_on_both_paths(spark):
    texts = ["Héllo,  Wörld!", "plain text (1)", "Søren & Łódź", "Ночь", "Ψυχή", "", None, "ß", "a_b", "ÆŒÞ İstanbul ΣΊΣΥΦΟΣ", "Щука ёж ЖЮЯ", "“q” – … ½ ²", "がっこう Ｗｉｄｅ", "e\u0301", "한국", "𝐀b", "\x1ca\x85b"]
    assert column(spark, texts, N.fold) == [None if t is None else N.fold_text(t) for t in texts]
    assert N.fold_text("Søren & Łódź") == "soren lodz"


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("Song (Live at X) [Remastered 2009]", ("Song", ["live", "remaster"], [], "Remastered 2009")), ("Song - Extended Mix", ("Song", ["extended"], [], "Extended Mix")), ("Song (Original Mix)", ("Song", [], [], None)),
        ("Song (feat. A & B) - Demo", ("Song", ["demo"], ["A", "B"], "Demo")), ("Song (Part 2)", ("Song (Part 2)", [], [], None)), ("Song ft. A", ("Song", [], ["A"], None)), ("Song ()", ("Song", [], [], None)), ("Jay-Z", ("Jay-Z", [], [], None)),
        ("Song (Main Mix)", ("Song (Main Mix)", [], [], None)), ("Song [Foo Mix] – Radio Edit (Live)", ("Song", ["live", "radio_edit", "remix"], [], "Live")), ("Song - Live (at) Home", ("Song", ["live"], [], "Live (at) Home")),
        ("Song ft. zoe (feat. Zoë x B)", ("Song", [], ["Zoë", "B"], None)), ("Song (Part 2) feat. A", ("Song (Part 2)", [], ["A"], None)), ("(Live)", ("", ["live"], [], "Live")), ("", ("", [], [], None)), (" \u2003x -", ("x", [], [], None)),
        ("Song feat. A (Interlude)", ("Song feat. A (Interlude)", [], [], None)), ("Song - Foo", ("Song - Foo", [], [], None)), ("Song - feat. D - Demo", ("Song", ["demo"], ["D"], "Demo")), ("a" * 5000 + " (live)", ("a" * 5000, ["live"], [], "live")),
    ],
)
def test_peeling(spark, title, want):
    got = column(spark, [title], N.peel_title)[0]
    assert (got.base, got.qualifiers, got.featured, got.version_label) == want


def test_confidence_is_exact(spark):
    rng, rows = random.Random(1), []
    for i in range(300):
        rows.append((i, rng.choice([*S.BASE, "other"]), rng.choice(["one", "two words", "..."]), rng.choice([None, "", "x"]), *(rng.random() < 0.5 for _ in range(4))))
    frame = spark.createDataFrame(rows, "i int, p string, t string, a string, c boolean, d boolean, m boolean, s boolean")
    got = frame.select("i", S.confidence(*[F.col(c) for c in "ptacdms"]).alias("v")).collect()
    for r, (i, p, t, a, c, d, m, s) in zip(sorted(got), rows, strict=True):
        parts = [S.AMBIGUOUS] * m + [S.NO_ARTIST] * (not a) + [S.SHORT] * (len(t.split()) == 1) + [S.DEGENERATE] * (not re.search(r"\w", t)) + [S.WITH_ISRC] * c + [S.WITH_LENGTH] * d + [S.STRUCTURED] * s
        assert r.v == min(1.0, max(0.0, S.BASE.get(p, 0.55) + math.fsum(parts))), (i, r.v)


def test_similarities(spark):
    frame = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], []), (["a"], [])], "x array<string>, y array<string>")
    assert [r[0] for r in frame.select(S.token_set_ratio(F.col("x"), F.col("y"))).collect()] == [0.5, 1.0, 0.0]
    assert [r[0] for r in frame.select(S.qualifier_similarity(F.col("x"), F.col("y"))).collect()] == [0.25, 1.0, 0.75]
    gaps = spark.createDataFrame([(320.0, 323.0), (320.0, 326.0), (320.0, 400.0), (320.0, None)], "a double, b double")
    assert [round(r[0], 4) for r in gaps.select(S.length_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.6667, 0.0, 0.5]


@pytest.mark.parametrize(("score", "unwanted", "want"), [(1.0, False, "auto_accept"), (0.8, False, "auto_accept"), (0.79, False, "review"), (0.5, False, "review"), (0.49, False, "not_found"), (0.0, True, "not_found"), (0.9, True, "review")])
def test_verdicts(spark, score, unwanted, want):
    assert spark.range(1).select(S.verdict(F.lit(score), F.lit(unwanted))).first()[0] == want


def test_near_ties_are_folded_in_order(spark):
    rows = [(1, [(1, 0.5, 1.0), (2, 0.5 + 8e-10, 2.0), (3, 0.5 + 16e-10, 1.5)]), (2, [(2, 0.9, None), (1, 0.9, None)]), (3, [])]
    frame = spark.createDataFrame(rows, "i int, s array<struct<pos:int,score:double,popularity:double>>")
    got = {r.i: r.b for r in frame.select("i", S.best_of(F.col("s")).alias("b")).collect()}
    assert got[1].pos == 2 and got[2].pos == 1 and got[3] is None


def test_shares(spark):
    frame = spark.createDataFrame([(5.0, 10.0), (1.0, 0.0), (0.0, 0.0)], "u double, a double")
    assert [r[0] for r in frame.select(S.share_pct(F.col("u"), F.col("a"))).collect()] == [50.0, math.inf, 0.0]


def test_engine_has_the_unicode_it_needs(spark):
    assert unicodedata.normalize("NFKC", "ﬁ") == "fi"
    assert spark.sql(r"select 'éa' rlike '(?<![\\p{L}\\p{N}_])a', 'x a' rlike '(?<![\\p{L}\\p{N}_])a', length('a🎵b')").first()[:] == (False, True, 3)
