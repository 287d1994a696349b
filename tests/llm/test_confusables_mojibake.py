import itertools
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from gleanline.llm import confusables as C
from gleanline.llm import mojibake as M


@pytest.mark.parametrize(
    ("odd", "plain"),
    [
        ("Chasing the Enginе", "Chasing the Engine"), ("Mirro‎r", "Mirror"), ("Ｑuiet Ｐａｖｉｌｉｏｎ！", "Quiet Pavilion!"), ("The 𝐊𝐢𝐥𝐞𝐦𝐚", "The Kilema"), ("Beﬁbe", "Befibe"),
        ("Borroweⅾ", "Borrowed"), ("A b　c d", "A b c d"), ("Théâtre", "Théâtre"), ("Lɑ Forêt", "La Forêt"), ("Notopa Ісесар", "Notopa Icecap"), ("Hollow Арех", "Hollow Apex"), ("Tidal Сорѕе", "Tidal Copse"),
        ("Xάρτιvη πόλη", "Χάρτινη πόλη"), ("Зимняя плoщaдь", "Зимняя площадь"), ("\U0001d53aopse", "Copse"), ("Kelvin", "Kelvin"), ("su­per", "super"),
    ],
)
def test_consistent(spark, odd, plain):
    for looks in (C.EVERYDAY_ONLY, C.table_of(spark)):
        assert looks.consistent(odd) == plain
        assert looks.consistent(plain) == plain
        assert looks.skeleton(odd) == looks.skeleton(plain)


@pytest.mark.parametrize(("odd", "plain"), [("Miρror", "Mipror"), ("Hαrbour", "Harbour"), ("Harbօur", "Harbour"), ("Ꭺnchor", "Anchor"), ("Hⲟrizon", "Horizon"), ("ꓮnchor", "Anchor"), ("𐊠nchor", "Anchor"), ("Nightfаll", "Nightfall"), ("Іcecap’s gates", "Icecap’s gates")])
def test_the_whole_table(spark, odd, plain):
    looks = C.table_of(spark)
    assert len(looks.prototypes) > 3000
    assert looks.consistent(odd) == plain and looks.skeleton(odd) == looks.skeleton(plain)


def test_skeletons_join_what_looks_alike(spark):
    looks = C.table_of(spark)
    assert looks.skeleton("O0Il1|") == looks.skeleton("OOlllI") and looks.skeleton("modern") == looks.skeleton("rnodem") and looks.skeleton("a") != looks.skeleton("b")


GENUINE = ["Последняя площадь", "Χάρτινη φωτιά 30", "Ο ήχος της νύχτας και το φως", "ουρανός νυν ρυθμός", "遠いみなと", "“Quoted” – it’s…", "a\tb\r\nc", "• 🎵 👩‍👩‍👧 ❤️", "Žlutá ulička", "½ ™ ²", "", "Ивановна и я", "نسخه‌ای", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "հայերեն լեզու", "ambientをもっと", "O0 Il1 rn m"]


@pytest.mark.parametrize("text", GENUINE)
def test_genuine_text_stays(spark, text):
    assert C.EVERYDAY_ONLY.consistent(text) == text and C.table_of(spark).consistent(text) == text


def test_found(spark):
    seed = spark.createDataFrame([(1, "Οf Time", "plain"), (2, None, "Zoë"), (3, "", "a​b"), (3, "", "a​b"), (4, "x" * 100000 + " ", None)], "row_id bigint, title string, artist string").withColumn("clean", F.lit(1)).withColumn("skeleton", F.lit(1)).withColumn("f", F.lit(1))
    cases = spark.createDataFrame([(9, "1. Αnchor\n2. Ночная река"), (10, None)], "case_no bigint, text string").withColumn("value", F.lit(1))
    got = sorted(tuple(r) for r in C.found(C.fields(seed, cases)).collect())
    assert got == [("printed_case", 9, "text"), ("seed_row", 1, "title"), ("seed_row", 3, "artist"), ("seed_row", 3, "artist"), ("seed_row", 4, "title")]
    assert C.found(C.fields(seed.limit(0), cases.limit(0))).count() == 0


def test_groups(spark):
    values = spark.createDataFrame([("Mirror",), ("Μirror",), ("Mirror",), ("Other",), (None,), ("Corn 10",), ("Com lO",)], "value string")
    got = {(r.forms, r.copies, r.clean) for r in C.groups(values).collect()}
    assert got == {(2, 3, "Mirror"), (1, 1, "Other"), (2, 2, "Com lO")}


TEXTS = ["La liste était effacée, j’ai deviné « Été »", "Schöne Übergänge über Köln", "Последняя площадь была тихой", "昨日の演奏はとても良かった。", "Příště bych rád víc a méně řečí, děkuji", "NÃO TOQUEM ISSO DE MANHÃ, A VIZINHANÇA JÁ RECLAMOU."]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("wrong", ["latin-1", "mac_roman", "cp437", "cp1252"])
def test_utf8_read_wrongly_is_found_and_restored(text, wrong):
    try:
        garbled = text.encode("utf-8").decode(wrong)
    except UnicodeDecodeError:
        garbled = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode("utf-8"))
    found, restored, layers, complete = M.repair(garbled)
    assert found and layers >= 1 and restored == text and complete


@pytest.mark.parametrize(("text", "right", "wrong"), [(TEXTS[2], "cp1251", "cp1252"), (TEXTS[2], "cp1251", "koi8-r"), (TEXTS[2], "cp1251", "mac_roman"), (TEXTS[4], "cp1250", "cp1252"), (TEXTS[3], "cp932", "latin-1")])
def test_other_encodings(text, right, wrong):
    found, restored, _, _ = M.repair(text.encode(right).decode(wrong, "replace"))
    assert found and restored == text


def test_nested_and_partial():
    twice = TEXTS[1].encode().decode("cp1252").encode().decode("latin-1")
    assert M.repair(twice)[:3] == (True, TEXTS[1], 2)
    part = "Fine line é\n" + TEXTS[0].encode().decode("mac_roman") + "\nПоследняя"
    assert M.repair(part)[1] == "Fine line é\n" + TEXTS[0] + "\nПоследняя"


@pytest.mark.parametrize("text", [*TEXTS, "", "plain", "ÂME, SÃO, CANÇÃO, À PART.", "“Ãvora” on side A and “Âvora”", "Room map: ┌──┐ stage, └──┘ bar.", "key C♯ → F♭, level −3 dB, ±2 %.", "½ speed, 10° tilt, £4 or €5", "Søren ? où", "why? not/x?y=z a?b"])
def test_meant_characters_are_no_case(text):
    assert M.repair(text)[0] is False and M.repair(text)[1] == text


def test_lost_bytes_are_found_but_not_restored():
    found, _, _, complete = M.repair("D�j� vu ?")
    assert found and not complete
    assert M.repair("L\x92Été déserte")[:2] == (True, "L’Été déserte")


def test_table(spark):
    rows = [(1, "Ã©tÃ© dÃ©jÃ "), (2, None), (3, ""), (4, "ok"), (5, "été " * 20000), (1, "Ã©tÃ© dÃ©jÃ "), (6, "ÃŸ" * 20000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"garbled": F.lit("clash"), "r": F.lit(1), "restored": F.lit(2)})
    got = M.repaired(docs).collect()
    assert len(got) == 7 and {r.doc_id for r in got if r.garbled} == {1, 6}
    assert next(r.restored for r in got if r.doc_id == 2) is None
    assert sorted(r.doc_id for r in M.found(docs).collect()) == [1, 1, 6]
    assert M.found(docs.limit(0)).count() == 0


def test_normal_forms_are_stable():
    assert all(unicodedata.normalize("NFC", C.EVERYDAY_ONLY.consistent(t)) == C.EVERYDAY_ONLY.consistent(t) for t in TEXTS)


def test_no_spelt_cyrillic_word_is_garbled():
    letters = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
    bad = []
    for first, second, third in itertools.product(letters, repeat=3):
        word = first + second + third
        if M._VOWEL.search(word) and not M._HARD.search(word):
            bad += [text for text in (word, word.title(), word.upper(), "по" + word, f"слово {word} в ряду") if M.repair(text)[0]]
    assert not bad, bad[:20]


@pytest.mark.parametrize("text", ["Переход вышел смелым", "шёл час, ход чем её", "Італії мрії дії надії мої", "БЕРЁТ ТРЁХ ВПЕРЁД", "Її ґанок", "Њујорк, љубав, џеп", "Тихая рыбака мыла"])
def test_cyrillic_words_stay(text):
    assert M.repair(text)[:2] == (False, text)


def test_layers_have_no_limit():
    text = "Déjà vu à l’été"
    for depth in range(1, 8):
        text = text.encode("utf-8").decode("latin-1")
        assert M.repair(text) == (True, "Déjà vu à l’été", depth, True)


def test_wide_and_unaccented_gates():
    wide = "音楽".encode().decode("cp932", "ignore")
    assert wide == "髻ｳ讌ｽ" and M.repair(wide)[:2] == (True, "音楽")
    assert M.repair("никогда никогда".encode("cp1251").decode("cp1252"))[:2] == (True, "никогда никогда")


def test_what_is_half_restored_is_not_complete():
    assert M.repair("Ã©tÃ© â€œlanternâ€ at nine")[3] is False
    assert M.repair("Ã©tÃ© dÃ©jÃ\xa0")[3] is True


def test_loss_is_a_rule_of_its_own():
    assert M.shows_loss("d?j? vu caf?s na?ve gar?on") is True and M.shows_loss("why? not") is False
    assert M.shows_loss("D�j� vu") and M.shows_loss("a\x81\x8db") and not M.shows_loss("Déjà vu")


def test_gates_lose_nothing(monkeypatch):
    texts = set(TEXTS) | {"Überall Größe", "naïve café", "Příliš žluťoučký kůň", "Щука ела ёжика", "Ξύλινη λίμνη της Αθήνας"}
    for text, right, wrong in itertools.product(sorted(texts), ["utf-8", "cp1250", "cp1251", "cp1252", "koi8-r", "cp932"], ["latin-1", "cp1252", "cp1251", "mac_roman", "cp437", "cp932"]):
        try:
            texts.add(text.encode(right).decode(wrong))
        except UnicodeError:
            continue
    texts = sorted(texts | {f"plain line\n{t}\nanother line" for t in texts})
    gated = [M.repair(t) for t in texts]
    assert all(re.search(M.SUSPECT, t) for t, r in zip(texts, gated, strict=True) if r[0])
    monkeypatch.setattr(M, "_is_plain", lambda line: line.isascii())
    assert [t for t, r in zip(texts, gated, strict=True) if M.repair(t) != r] == []
