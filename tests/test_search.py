import json
import random

import pyarrow as pa
import pytest

from gleanline.functions import score as S
from gleanline.operators import match as M
from gleanline.plans import entities as E

ITEM = pa.schema([("item_id", pa.int64()), ("ftitle", pa.string()), ("fartist", pa.string()), ("duration_s", pa.float64()), ("kind", pa.string())])
RECORDING = pa.schema([("recording_id", pa.int64()), *[(f.name, f.type) for f in ITEM][1:], ("popularity", pa.float64()), ("pos", pa.int64())])


def rows(draw, n, more=()):
    words = lambda k, first: " ".join(draw.choices(["the", "of", *(f"{first}{i}" for i in range(12))], [6, 4, *[1] * 12], k=k))
    made = [[i, words(draw.choice([0, 1, 1, 2, 3, 4]), "t"), None if draw.random() < 0.2 else words(draw.choice([0, 1, 2, 2, 3]), "a"), draw.choice([None, 60.0, 64.5, 300.0]), json.dumps(draw.choice([[], ["live"], ["demo", "live"]]))] for i in range(n)]
    return [[*row, *(f(i) for f in more)] for i, row in enumerate(made)]


def similarity(a, b):
    a, b = set(a.split()), set(b.split())
    return 1.0 if not a and not b else len(a & b) / max(1, min(len(a), len(b)))


def best(item, recordings):
    """By the definition, over all pairs; recordings are in order of place."""
    _, title, artist, seconds, wants = item
    found = None
    for rec, t, a, length, kind, popularity, _ in recordings:
        gap = None if seconds is None or length is None else abs(seconds - length)
        near = 0.5 if gap is None else min(1.0, max(0.0, 1 - (gap - 3) / 9))
        w, k = set(json.loads(wants)), set(json.loads(kind))
        score = 0.5 * similarity(title, t) + 0.3 * (0.5 if artist is None or a is None else similarity(artist, a)) + 0.1 * near + 0.1 * max(0.0, 1 - 0.25 * len(w - k) - 0.5 * len(k - w))
        shares = bool(set(title.split(" ")) & set(t.split(" ")))
        if (shares or score >= S.NOT_FOUND - S.TIE) and (found is None or score > found[0] + S.TIE or (abs(score - found[0]) <= S.TIE and popularity > found[1])):
            found = (score, popularity, rec)
    return found and found[2]


@pytest.mark.parametrize("long", [0, 3, 200])
def test_search_that_ends_early_loses_nothing(monkeypatch, long):
    monkeypatch.setattr(M, "LONG", long)
    draw = random.Random(7)
    for n in (1, 5, 40, 400):
        items, listed = rows(draw, 150), rows(draw, n, (lambda i: draw.choice([0.0, 0.25, 0.5]), lambda i: i))
        got = M._best_in_block(pa.Table.from_arrays([pa.array(c) for c in zip(*items)], schema=ITEM), pa.Table.from_arrays([pa.array(c) for c in zip(*listed)], schema=RECORDING))
        want = {item[0]: best(item, listed) for item in items}
        assert dict(zip(*(c.to_pylist() for c in got.columns))) == {i: r for i, r in want.items() if r is not None}


def test_common_tokens_are_not_searched_where_a_rare_one_settles(monkeypatch):
    scored = []
    shared = M._Field.shared
    monkeypatch.setattr(M._Field, "shared", lambda self, tokens, rows, scratch: (scored.append(len(rows)), shared(self, tokens, rows, scratch))[1])
    listed = [(i, f"the {'red' if i % 2 else 'blue'} w{i}", f"the {'bo' if i % 3 else 'ann'} a{i}", None, "[]", 0.5, i) for i in range(5000)]
    items = [(i, *listed[i][1:5]) for i in range(0, 5000, 50)]
    got = M._best_in_block(pa.Table.from_arrays([pa.array(c) for c in zip(*items)], schema=ITEM), pa.Table.from_arrays([pa.array(c) for c in zip(*listed)], schema=RECORDING))
    assert got["recording_id"].to_pylist() == got["item_id"].to_pylist() == [i[0] for i in items]
    assert sum(scored) < 10 * len(items)  # all that share a token: 5,000 an item


def test_an_item_without_artist_ends_early_too(monkeypatch):
    scored = []
    shared = M._Field.shared
    monkeypatch.setattr(M._Field, "shared", lambda self, tokens, rows, scratch: (scored.append(len(rows)), shared(self, tokens, rows, scratch))[1])
    listed = [(i, f"the {'red' if i % 2 else 'blue'} w{i}", f"the {'bo' if i % 3 else 'ann'} a{i}", 100.0 + i, "[]", 0.5, i) for i in range(5000)]
    items = [(i, listed[i][1], None, listed[i][3], "[]") for i in range(0, 5000, 50)]
    got = M._best_in_block(pa.Table.from_arrays([pa.array(c) for c in zip(*items)], schema=ITEM), pa.Table.from_arrays([pa.array(c) for c in zip(*listed)], schema=RECORDING))
    assert got["recording_id"].to_pylist() == [i[0] for i in items]
    assert sum(scored) < 10 * len(items)


def test_rematch_resolves_once(spark, small):
    plan = E.x3_rematch(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in plan.splitlines()) == 1  # of what is stored and what is new; not those of two resolutions


def test_every_pair_of_blocks_has_a_partition_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(M, "CATALOG_BLOCK", 5)
    monkeypatch.setattr(M, "ITEM_BLOCK", 5)
    kinds = "duration_s double, qualifiers array<string>"
    items = spark.createDataFrame([(i, f"t{i}", f"a{i}", None, []) for i in range(40)], f"item_id bigint, ftitle string, fartist string, {kinds}")
    listed = spark.createDataFrame([(i, f"t{i}", f"a{i}", None, [], 0.0, i) for i in range(20)], f"recording_id bigint, ftitle string, fartist string, {kinds}, popularity double, pos bigint")
    assert sorted(map(tuple, M.search(items, listed).where("item_id = recording_id").collect())) == [(i, i) for i in range(20)]
    for n in (1, 6, 32):
        rows = spark.createDataFrame([(k,) for k in M._apart(spark, n)], "block bigint").repartition(n, "block")
        assert [len(part) for part in rows.rdd.glom().collect()] == [1] * n
