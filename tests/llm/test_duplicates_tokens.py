import os
import random

import pytest
from pyspark.sql import functions as F

from gleanline.llm import duplicates as D
from gleanline.llm import tokens as T

LINES = "line_id bigint, list_id bigint, title string, artist string"


def records(spark, rows):
    return {(r.first_line_id, r.copy_line_id) for r in D.found(spark.createDataFrame(rows, LINES).withColumns({"key": F.lit("k"), "copies": F.lit(9), "a": F.lit(1)})).collect()}


def test_dress_and_places(spark):
    rows = [
        (1, 1, "Kühle Straße", "The X"), (2, 1, "the-x!", "KÜHLE STRASSE"), (3, 1, "Kühle  Straße", "The X"), (4, 1, "Kuhle Straße", "The X"),
        (5, 2, "Kühle Straße", "The X"), (6, 1, "Ｋühle Straße", "the x"),
    ]
    assert records(spark, rows) == {(1, 2), (1, 3), (1, 6)}


def test_missing_artist_is_its_own_value(spark):
    rows = [(1, 1, "A", None), (2, 1, "a.", None), (3, 1, "A", ""), (4, 1, "A", "-"), (5, 1, None, "A"), (6, 1, None, None), (7, 1, None, None), (8, None, "A", None), (9, None, "A", None)]
    assert records(spark, rows) == {(1, 2), (3, 4), (6, 7), (8, 9)}


def test_hot_record_and_long_text(spark):
    rows = [(i, 1, "Same" + "!" * (i % 3), "X") for i in range(300)] + [(1000, 1, "z" * 200000, "X"), (1001, 1, "Z" * 200000, "X")]
    got = records(spark, rows)
    assert len(got) == 300 and (1000, 1001) in got and all(a == 0 for a, b in got if b < 1000)


def test_counts(spark):
    frame = spark.createDataFrame([(1, 1, "A", "B"), (2, 1, "a", "b"), (3, 1, "A", "B"), (4, 1, "C", "B")], LINES)
    assert sorted((r.first_line_id, r.copies) for r in D.collapse(frame)[1].collect()) == [(1, 3), (4, 1)]


def test_empty(spark):
    assert D.found(spark.createDataFrame([], LINES)).count() == 0


VOCABULARY = os.path.join(T.vocabulary_folder(), "byte_bpe_50k.tiktoken")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


@needs_vocabulary
def test_fragments_encode_as_the_whole():
    rng, encoding = random.Random(3), T.encoder(VOCABULARY)
    alphabet = " \n\t\r'’sStredmlvABab19.,!-é語の　 🎵_()"
    for _ in range(20000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16)))
        assert T.encode(text, VOCABULARY, None, rng.choice([1, 2, 3])) == encoding.encode_ordinary(text), repr(text)


@needs_vocabulary
def test_fragments_are_cut_where_no_token_spans():
    text = "Hello, world! It's 12 o'clock; don't stop.\n\n" * 50
    pieces = list(T.fragments(text, VOCABULARY, 20))
    assert "".join(pieces) == text and len(pieces) > 20
    joined = T.joined_pairs(VOCABULARY)
    for left, right in zip(pieces, pieces[1:]):
        assert 256 * left.encode()[-1] + right.encode()[0] not in joined


@needs_vocabulary
def test_corpus(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "  \n"), (5, "a" * 200000), (1, "Hello world"), (None, "x"), (7, "<|endoftext|>")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in T.encode_corpus(docs).collect()}
    encoding = T.encoder(VOCABULARY)
    assert got[1] == encoding.encode_ordinary("Hello world") and got[2] == [] and got[3] == []
    assert got[4] == encoding.encode_ordinary("  \n") and encoding.decode(got[5]) == "a" * 200000 and 50256 not in got[7]
    assert T.encode_corpus(docs).count() == 8 and T.encode_corpus(docs.limit(0)).count() == 0


@needs_vocabulary
def test_cuts_beside_characters_of_every_kind():
    rng, encoding = random.Random(5), T.encoder(VOCABULARY)
    alphabet = " \n\t'’sab19.,!-\x85 　́é語のПереход昨日良。、ΩωЖ한국العहिन्€“”–🎵٣４"
    for _ in range(20000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16)))
        assert T.encode(text, VOCABULARY, None, rng.choice([1, 2, 3])) == encoding.encode_ordinary(text), repr(text)
    wide = [chr(c) for c in range(0x80, 0x11000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x1F300, 0x1FAFF)]
    for _ in range(4000):
        text = "".join(rng.choice(wide) for _ in range(12))
        assert T.encode(text, VOCABULARY, None, 1) == encoding.encode_ordinary(text), repr(text)


@needs_vocabulary
@pytest.mark.parametrize("text", ["昨日の演奏はとても良かった。予定では曲のはずが、数えたら曲だった。" * 600, "Переходбылсмелым" * 1300, "é" * 3 + "日本の語" * 5000])
def test_long_texts_beyond_ascii_are_cut(text):
    pieces = list(T.fragments(text, VOCABULARY))
    assert "".join(pieces) == text and len(pieces) > 10 and max(map(len, pieces)) < 2 * T.FRAGMENT
    assert T.encode(text, VOCABULARY) == T.encoder(VOCABULARY).encode_ordinary(text)


def test_survivors_find_their_lines(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 2, None]), rng.choice(["A b", "a-b", "AB", "Ｃ", "c", None, ""]), rng.choice(["X", "x!", None, "a b"])) for i in range(400)]
    homes: dict = {}
    import unicodedata

    bare = lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKC", s).lower() if c.isalnum())
    for i, at, title, artist in rows:
        pair = (bare(title), bare(artist))
        homes.setdefault((at, tuple(sorted(pair)) if None not in pair else pair), []).append(i)
    assert records(spark, rows) == {(min(ids), i) for ids in homes.values() for i in ids if i != min(ids)}
