import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanline.llm import linkage as K
from gleanline.llm import mixture as X
from gleanline.llm import names as N

SAME = [
    ["Abigail Jovavezonne", "A Jovavezonne", "Jovavezonne, A.", "AbigailJovavezonne", "Gail Jovavezonne", "Abigail Jovaveznoone", "Abigail “Sugar” Jovavezonne", "Abigail K. Jovavezonne"],
    ["William Hoziwilanne", "Hoziwilanne, Bill", "Billy Hooziqilanne", "W. Hoziwilanne"], ["José Hoziwilanne", "Jose Hoziwilanne"],
    ["DJ Rimofomesk", "D.J. Rimofomesk", "Deejay Rimofomesk", "Rimofomesk (DJ)", "DjRimofomesk", "Rimofomesk"],
    ["The Lidadelins", "Lidadelins, The", "Thee Lidadelins", "the Lidadelins band", "The Lidadelinz", "Lydadeilns"],
    ["Rosíjovolt & the Weathervanes", "Rosijovolt and the Weathervanes", "Weathervanes, Rosíjovolt and the", "The Weathervanes & Rosíjovolt", "Rosíjovolt w/ the Weathervanes", "Rosíjovolt + Weathervanes"],
    ["Hemözesinne Chamber Orchestra", "Hemözesinne C.O.", "Chamber Orchestra of Hemözesinne", "Hemozesine Chmbr Orchestra", "The Hemözesinne Chamber Orch."], ["Rebecca Fibedobo", "Rebecca Fibdeobo"],
    ["Vincent Pahovenen", "Sparks Pahovenen"], ["Kebihiwird String Quartet", "Kebihiwird Quartet"], ["Zamevenon, Isabella", "Isabella Zamvrnon"],
    ["Richard Giwetomolt", "Dick Giwetomolt"], ["Christopher Giwetomolt", "Chri. Gwyetomolt"],
]


def artists(spark, names):
    rows = [(i, n, 50 if any(n == g[0] for g in SAME) else 2) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "name_id bigint, artist string, uses bigint").withColumns({"core": F.lit(1), "class_id": F.lit(2), "key": F.lit(3)})


def context():
    """Unlike names that show which words are ordinary, as the rest of a table does."""
    rng = random.Random(4)
    surname = lambda: "".join(rng.choice("bdfgklmnprtv") + rng.choice("aeio") for _ in range(4)).capitalize() + rng.choice(["sk", "nne", "lt"])
    shapes = ["{} Chamber Orchestra", "{} String Quartet", "{} & the Weathervanes", "DJ {}", "José {}", "The {}s"]
    return [shape.format(surname()) for shape in shapes for _ in range(12)] + [f"Olga “Sparks” {surname()}"]


def test_spellings_of_one_are_linked_and_namesakes_are_not(spark):
    names = [n for group in SAME for n in group]
    home = {n: g for g, group in enumerate(SAME) for n in group}
    want = {(a, b) for a, b in itertools.combinations(range(len(names)), 2) if home[names[a]] == home[names[b]]}
    got = {tuple(r) for r in N.found(artists(spark, names + context())).collect()}
    every = names + context()
    assert got == want, ([(every[a], every[b]) for a, b in want - got], [(every[a], every[b]) for a, b in got - want])


GIVEN = "Sven Olga Dmitri Marek Ines Aiko Chidi Lorenzo Samuel Andrew Bartholomew Kwame Zeynep Ivo Astrid Mehmet Paola Hiroshi Femke Anselm Radka Tariq Noor Emeka Wilfried Yolanda".split()
SHORT = {"Samuel": "Sam", "Andrew": "Andy", "Bartholomew": "Bart"}
KIND = ["Wind Quintet", "Gospel Choir", "Steel Band", "Baroque Consort", "Mandolin Club"]
PARTNER = ["Harvesters", "Woodcutters", "Locksmiths", "Night Owls", "Glaziers"]


def slip(rng, word):
    i = rng.randrange(1, len(word) - 2)
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + rng.choice("aeioustn") + word[i:], word[:i] + rng.choice("aeioustn") + word[i + 1 :]])


def held_out(rng, n):
    """Spellings of ``n`` entities from a vocabulary that the operator has no list of."""
    syllable = lambda: rng.choice(["br", "k", "st", "v", "m", "gr", "h", "sch", "l", "z", "tr", "n", "d"]) + rng.choice(["a", "e", "i", "o", "u", "au", "ei"])
    out = []
    for entity in range(n):
        core = (syllable() + syllable() + syllable() + rng.choice(["mann", "ez", "ov", "ic", "son", "ard"])).capitalize()
        sort = rng.choice("ppppkb")
        if sort == "p":
            given = rng.choice(GIVEN)
            forms = [f"{given} {core}", f"{core}, {given}", f"{given[0]}. {core}", f"{core} {given}", f"{given}{core}", f"{given} {slip(rng, core)}", f"{slip(rng, given) if len(given) > 4 else given} {core}", f"{SHORT.get(given, given)} {core}", f"{given} {rng.choice('ABCDEFGH')}. {core}"]
        elif sort == "k":
            kind = rng.choice(KIND)
            forms = [f"{core} {kind}", f"The {core} {kind}", f"{kind} of {core}", f"{slip(rng, core)} {kind}", f"{core} {kind.split()[0][0]}.{kind.split()[1][0]}.", f"{core} {slip(rng, kind.split()[0])} {kind.split()[1].lower()}"]
        else:
            partner = rng.choice(PARTNER)
            forms = [f"{core} & the {partner}", f"{core} and {partner}", f"The {partner} & {core}", f"{partner}, {core} and the", f"{slip(rng, core)} & the {partner}"]
        out += [(entity, form, 20 if i == 0 else 1) for i, form in enumerate(dict.fromkeys(forms))]
    return out


def test_recall_on_held_out_vocabulary(spark):
    rows = held_out(random.Random(12), 250)
    frame = spark.createDataFrame([(i, form, uses) for i, (_, form, uses) in enumerate(rows)], "name_id bigint, artist string, uses bigint")
    want = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if rows[a][0] == rows[b][0]}
    got = {tuple(r) for r in N.found(frame).collect()}
    recall, precision = len(got & want) / len(want), len(got & want) / len(got)
    assert recall >= 0.9 and precision >= 0.98, (recall, precision, [(rows[a][1], rows[b][1]) for a, b in list(want - got)[:20]], [(rows[a][1], rows[b][1]) for a, b in list(got - want)[:20]])


def test_name_edges(spark):
    names = [None, "", "  ", "???", "Zed", "Zed", "x" * 50000, "A", "李", "& & &", "DJ", "The The"]
    got = {tuple(r) for r in N.found(artists(spark, names)).collect()}
    assert (4, 5) in got and len(got) == 1
    assert N.found(artists(spark, names).limit(0)).count() == 0


def test_classes_count_links(spark):
    got = {r.name_id: (r.class_id, r.links) for r in N.classes(artists(spark, ["William Hoziwilanne", "Bill Hoziwilanne", "Hoziwilanne, Bill", "W. Hoziwilane", "Ann Other", None])).collect()}
    assert {got[i][0] for i in range(4)} == {0} and got[0][1] == 2 and got[4] == (4, 0) and 5 not in got


@pytest.mark.parametrize("others", [[], ["wiliam"]])
def test_blocking_loses_no_alike_core(spark, others):
    rng, cores = random.Random(9), set()
    while len(cores) < 150:
        cores.add("".join(rng.choice("bdfgklmnprtv") + rng.choice("aeio") for _ in range(rng.randint(3, 5))))
    cores = [N.smooth(c) for c in sorted(cores)]
    once = lambda c, i: rng.choice([c[:i] + c[i + 1 :], c[:i] + c[i + 1] + c[i] + c[i + 2 :], c[:i] + "w" + c[i:], c[:i] + "w" + c[i + 1 :]])
    for c in list(cores[:60]):
        cores.append(once(c, rng.randrange(1, len(c) - 1)))
    for c in list(cores[60:120]):
        cores.append(once(once(c, rng.randrange(0, len(c) // 2)), rng.randrange(len(c) // 2, len(c) - 2)))
    rows = [(i, c, others, False, True, 1, ["w"] if others else [""]) for i, c in enumerate(cores)]
    nodes = spark.createDataFrame(rows, "node bigint, core string, others array<string>, by boolean, certain boolean, uses bigint, refine array<string>")
    got = {(r.a, r.b) for r in N.edges(nodes, N.Lexicon()).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(len(cores)), 2) if N.alike(cores[a], cores[b])}
    one = {(a, b) for a, b in want if N.distance(cores[a], cores[b]) <= 1}
    assert got <= want and len(one & got) >= 0.98 * len(one) and len(got) >= 0.8 * len(want), (len(one & got), len(one), len(got), len(want))


def test_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert N.common(a, b) == table[-1, -1]


NOW = dt.datetime(2026, 1, 1)
INPUT = "input_id bigint, title string, artist string, duration_s double, qualifiers array<string>, alternate struct<title:string,artist:string>"
OFFER = "candidate_id bigint, provider string, title string, artist string, duration_s double, duration_label string, qualifiers array<string>, listed_at timestamp"


def offers(spark, rows):
    return spark.createDataFrame([(c, "p", t, a, d, None, q, NOW) for c, t, a, d, q in rows], OFFER).withColumns({"key": F.lit(1), "odds": F.lit(2), "base": F.lit(3)})


def test_links(spark):
    songs = [(1000 + i, f"Song Number {i} of Kavo{'aeiou'[i % 5]}", f"The Band{chr(97 + i)}ers", 100.0 + 7 * i, []) for i in range(24)]
    extra = [(2000, "Painted Harbour (Live)", "Zoë Tarn", 200.0, ["live"]), (2001, "Painted Harbour", "Zoë Tarn", 240.0, []), (2002, "Painted Harbour", "Other One", 240.0, []), (2003, None, None, None, None), (2004, "", "x", 1.0, [])]
    rows = [(i, f"song number {i} of kavo{'aeiou'[i % 5]}", f"Band{chr(97 + i)}ers", 100.5 + 7 * i, [], None) for i in range(24)]
    rows += [
        (100, "Painted Harbour - Live", "Z. Tarn", 200.5, [], None), (101, "Painted Harbuor", "Zoë Tarn", None, [], None), (101, "Painted Harbuor", "Zoë Tarn", None, [], None), (102, "Tarn, Zoë", "Painted Harbour", 240.0, [], ("Painted Harbour", "Tarn, Zoë")),
        (103, "Painted Harbour", "Zoë Tarn", None, ["remix"], None), (104, None, None, None, None, None), (105, "", None, None, [], None), (106, "x" * 20000, "y", 5.0, [], None), (107, "Painted Harbour - Remastered 2009", "Zoë Tarn", 241.0, [], None),
    ]
    inputs = spark.createDataFrame(rows, INPUT).withColumns({"reading": F.lit(1), "base": F.lit("x"), "length_s": F.lit(1)})
    got = {r.input_id: (r.candidate_id, r.confidence) for r in K.link(inputs, offers(spark, songs + extra)).collect()}
    found = {i: c for i, (c, p) in got.items() if p >= 0.5}
    assert all(found[i] == 1000 + i for i in range(24))
    assert (found[100], found[101], found[102], found[107]) == (2000, 2001, 2001, 2001)
    assert not {103, 104, 105, 106} & set(found)
    assert K.found(inputs.limit(0), offers(spark, [])).count() == 0


def test_title_parts():
    assert K.title_parts("Song, Part 3 (feat. X) - Exetnded Version [Official Video]") == ("song pt 3", "", ["extended"])
    assert K.title_parts("Song & Dance (Window Remix)") == ("song dance", "window", ["remix"])
    assert K.title_parts("Song (Part Two)")[0] == "song pt two" and K.title_parts(None) == ("", "", [])
    assert K.title_parts("Song - Remastered 2009")[2] == [] and K.title_parts("(Live)")[0] == "live"


@pytest.mark.parametrize("n", [1, 2, 3, 50, 2000])
def test_flight_keeps_totals_and_expectation(n):
    rng = np.random.default_rng(n)
    sizes, chance = rng.integers(1, 2000, n).astype(float), np.full(n, 0.37)
    settled = X.flight(chance, sizes, rng.random(5000))
    assert ((settled > X.EPS) & (settled < 1 - X.EPS)).sum() <= 2
    assert np.dot(settled, sizes) == pytest.approx(np.dot(chance, sizes)) and settled.sum() == pytest.approx(chance.sum())
    assert set(np.unique(X.landing(settled, sizes))) <= {0.0, 1.0}


def test_flight_is_unbiased():
    rng = np.random.default_rng(0)
    sizes = np.array([1.0, 5, 9, 9, 20, 3])
    mean = np.mean([X.flight(np.full(6, 0.4), sizes, rng.random(64)) for _ in range(4000)], axis=0)
    assert np.abs(mean - 0.4).max() < 0.04


def documents(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        source = rng.choices(["big", "mid", "tiny"], [8, 3, 1])[0]
        rows.append((i, " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(rng.randint(1, 60))) + f" {i}", source))
    rows += [(900, rows[0][1], "tiny"), (901, rows[0][1], rows[0][2]), (902, None, "big"), (903, "", "big"), (904, "text", None), (0, rows[0][1], rows[0][2]), (905, "lonely", "unlisted")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"digest": F.lit(1), "n_tokens": F.lit("x"), "chance": F.lit(2), "uses": F.lit(3)})


def test_mix(spark):
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "tiny", 0.2, 4), ("n", "big", 0.9, 3), ("n", "ghost", 0.1, 2), ("o", "ghost", 1.0, 1), ("p", "mid", 0.0, 1)], "mix_name string, source string, weight double, max_uses int")
    docs = documents(spark)
    got = {(r.mix_name, r.source): r for r in X.shares(docs, targets).collect()}
    assert len(got) == 7
    for source, weight in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        assert got[("m", source)].share == pytest.approx(weight, abs=0.005) and got[("m", source)].most_uses <= got[("m", source)].max_uses
    assert got[("n", "big")].share == 1.0 and got[("n", "ghost")].tokens == 0 and got[("o", "ghost")].share == 0.0 and got[("p", "mid")].texts_used == 0
    corpus = X.corpus(docs, targets).toPandas()
    uses = corpus.groupby(["mix_name", "text"]).agg(uses=("uses", "sum"), source=("source", "first")).reset_index()
    caps = {("m", "big"): 1, ("m", "mid"): 2, ("m", "tiny"): 4, ("n", "big"): 3}
    assert all(u <= caps[(m, s)] for m, u, s in zip(uses.mix_name, uses.uses, uses.source, strict=True))
    assert not corpus.duplicated(["mix_name", "text"]).any() and (corpus.text != "").all()
    totals = (corpus.uses * corpus.n_tokens).groupby([corpus.mix_name, corpus.source]).sum()
    assert {k: v for k, v in totals.items()} == {k: r.tokens for k, r in got.items() if r.tokens}
    assert X.corpus(docs.limit(0), targets).count() == 0 and X.corpus(docs, targets.limit(0)).count() == 0
    assert isinstance(corpus, pd.DataFrame)


def test_em_finds_its_classes_without_held_probabilities():
    rng = np.random.default_rng(5)
    truth = [
        {"title": [0.8, 0.15, 0.03, 0.02], "artist": [0.85, 0.13, 0.02], "length": [0.6, 0.1, 0.02, 0.01, 0.27], "version": [0.97, 0.01, 0.01, 0.01]},
        {"title": [0.8, 0.15, 0.03, 0.02], "artist": [0.9, 0.08, 0.02], "length": [0.02, 0.05, 0.13, 0.5, 0.3], "version": [0.01, 0.05, 0.64, 0.3]},
        {"title": [0.5, 0.1, 0.2, 0.2], "artist": [0.01, 0.09, 0.9], "length": [0.1, 0.2, 0.2, 0.3, 0.2], "version": [0.7, 0.0, 0.2, 0.1]},
    ]
    draws = pd.concat([pd.DataFrame({k: rng.choice(len(t[k]), n, p=t[k]) for k in K.LEVELS} | {"real": i == 0}) for i, (t, n) in enumerate(zip(truth, (4000, 3000, 6000), strict=True))])
    counts = draws.groupby(list(K.LEVELS)).agg(n=("real", "size"), real=("real", "sum")).reset_index()
    tables, shares = K.fit(counts)
    odds = [shares[c] * np.prod([tables[c][k][counts[k]] for k in K.LEVELS], axis=0) for c in range(len(shares))]
    said = odds[0] > sum(odds[1:])
    right = np.where(said, counts.real, counts.n - counts.real).sum() / counts.n.sum()
    best = np.maximum(counts.real, counts.n - counts.real).sum() / counts.n.sum()
    assert right >= best - 0.01 and abs(shares[0] - 4 / 13) < 0.03
    assert K.fit(counts.head(0))[1].tolist() == K.SHARES


def test_linkage_blocking_against_all_pairs(spark):
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("bdfgklmnprtvs") + rng.choice("aeiou") for _ in range(n))
    songs = [(i, f"{word(3)} {word(rng.randint(2, 4))}", f"{word(4)}son & the {rng.choice(['Harvesters', 'Glaziers', 'Locksmiths'])}", rng.uniform(100, 400)) for i in range(300)]
    inputs, truth = [], {}
    for i, title, artist, length in songs:
        typed = slip(rng, title) if i % 3 else title
        who = None if i % 7 == 0 else slip(rng, artist.split()[0]) + artist[len(artist.split()[0]) :] if i % 5 == 0 else artist
        inputs.append((i, typed, who, None if i % 4 == 0 and who else length + 0.5, [], None))
        truth[i] = 1000 + i
    offered = offers(spark, [(1000 + i, t, a, d, []) for i, t, a, d in songs])
    got = {tuple(r) for r in K.found(spark.createDataFrame(inputs, INPUT), offered).collect()}
    assert len(got & set(truth.items())) >= 0.97 * len(truth) and len(got - set(truth.items())) <= 3
