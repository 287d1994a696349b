import datetime as dt
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gleanline.operators import catalog as C
from gleanline.operators import match as M
from gleanline.operators import quality as Q
from gleanline.operators import rollup as R
from gleanline.sources import stores
from gleanline.streaming import flows

ITEM = "item_id bigint, title string, artist string, isrc string, duration_s double, qualifiers array<string>, alternate struct<title:string,artist:string>"
RECORDING = "recording_id bigint, title string, artist string, isrc string, duration_s double, qualifiers array<string>, popularity double, pos bigint"


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(1, "One More Time", "Daft Punk", "GBDUW0000059", 320.0, [], 0.9, 1), (2, "One More Time (Live)", "Daft Punk", None, 340.0, ["live"], 0.5, 2), (3, "Aerodynamic", "Daft Punk", None, 212.0, [], 0.1, 3), (4, "Aerodynamic", "Daft Punk", None, 212.0, [], 0.4, 4)]
    return spark.createDataFrame(rows, RECORDING)


def resolved(spark, catalog, rows, **more):
    frame = spark.createDataFrame(rows, ITEM).withColumns({"score": F.lit(9), "block": F.lit("x")})
    return {r.item_id: r for r in M.resolve(frame, catalog, **more).collect()}


def test_stages(spark, catalog):
    rows = [
        (1, "whatever", None, "gb-duw-00-00059", None, None, None), (2, "one more time", "DAFT PUNK", None, 321.0, [], None), (3, "Aerodynamic", "Daft Punk", None, 212.0, None, None),
        (4, "Nothing Like It", "Nobody", None, None, [], None), (5, "Daft Punk", "Aerodynamic", None, 212.0, [], ("Aerodynamic", "Daft Punk")), (6, None, None, None, None, None, None), (7, "One More Time", "Daft Punk", None, 340.0, ["live"], None),
    ]
    got = resolved(spark, catalog, rows)
    assert len(got) == 7
    assert (got[1].recording_id, got[1].source, got[1].verdict) == (1, "isrc", "auto_accept")
    assert (got[2].recording_id, got[2].verdict, got[2].outcome) == (1, "auto_accept", "not_applicable")
    assert got[3].recording_id == 4  # an equal score goes to the more popular
    assert got[4].verdict == "not_found" and got[6].verdict == "not_found" and got[4].source == "none"
    assert (got[5].recording_id, got[5].flipped, got[5].outcome) == (4, True, "resolved")
    assert got[7].recording_id in (1, 2)


def test_unwanted_version_is_only_for_review(spark, catalog):
    got = resolved(spark, catalog.where("recording_id = 2"), [(1, "One More Time Live", "Daft Punk", None, 340.0, [], None)])
    assert got[1].verdict == "review" and got[1].score >= 0.8


def test_cache_and_fallback(spark, catalog):
    from gleanline.functions import text as T

    key = spark.createDataFrame([("one more time", "daft punk")], "t string, a string").select(T.text_key(F.col("t"), F.col("a"))).first()[0]
    cache = spark.createDataFrame([(key, 77, 0.95, "auto_accept", dt.datetime(2030, 1, 1)), (key, 78, 0.9, "review", dt.datetime(2020, 1, 1))], "cache_key string, recording_id bigint, score double, verdict string, expires_at timestamp")
    rows = [(1, "One More Time", "Daft Punk", None, None, [], None), (2, "Aerodynamic", "Daft Punk", None, None, [], None)]
    got = resolved(spark, catalog.where("recording_id < 3"), rows, cache=cache, now=F.lit(dt.datetime(2026, 1, 1)), fallback=catalog)
    assert (got[1].recording_id, got[1].source) == (77, "cache")
    assert (got[2].recording_id, got[2].source) == (4, "fallback")


def test_rematch(spark):
    made = lambda rows: spark.createDataFrame(rows, "item_id bigint, recording_id bigint, verdict string, outcome string")
    stored = made([(1, 5, "review", "not_applicable"), (2, 5, "review", "not_applicable"), (3, None, "not_found", "not_applicable")])
    fresh = made([(1, 5, "review", "not_applicable"), (2, 6, "review", "not_applicable"), (3, None, "not_found", "not_applicable"), (4, 9, "review", "resolved")])
    assert {r.item_id: r.rematch for r in M.rematch(stored, fresh).collect()} == {1: "unchanged", 2: "updated", 3: "still_unmatched", 4: "updated"}


def events(spark, rows):
    return R.payload_events(spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string, env string"))


DAY = dt.datetime(2026, 1, 2, 3)


def test_rollup_counts_sums_and_skips(spark):
    rows = [(1, DAY, 1, "a", 1.0, '{"k": 2}', "dev"), (2, DAY, 1, "a", 1.0, '{"k": 3}', "dev"), (3, DAY, 1, "a", 1.0, "{}", "dev"), (4, DAY, 1, "b", 1.0, None, "dev")]
    got = {r.event_type: (r.events, r.sum_k) for r in R.daily_rollup(events(spark, rows), ["k"]).collect()}
    assert got == {"a": (3, 5), "b": (1, None)}


@pytest.mark.parametrize("bad", ['{"k": true}', '{"k": "2"}', '{"k": 1.5}'])
def test_rollup_refuses_other_kinds(spark, bad):
    with pytest.raises(PySparkException):
        R.daily_rollup(events(spark, [(1, DAY, 1, "a", 1.0, bad, "dev")]), ["k"]).collect()


def test_day_job_overwrites_its_day(spark, tmp_path):
    rows = [(i, DAY + dt.timedelta(days=i % 2), 1, "a", 1.0, '{"k": 1}', "dev") for i in range(6)]
    source_path, sink_path = str(tmp_path / "in"), str(tmp_path / "out")
    events(spark, rows).drop("payload").write.partitionBy("env", "occurred_on").parquet(source_path)
    source = lambda s, j: stores.day_partition(source_path)(s, j).withColumn("payload", F.try_parse_json("props"))
    for day in ("2026-01-02", "2026-01-03", "2026-01-03"):
        stores.run_day(spark, stores.Job(day, "dev", ("k",)), source, stores.day_sink(sink_path))
    assert sorted((str(r.occurred_on), r.events) for r in spark.read.parquet(sink_path).collect()) == [("2026-01-02", 3), ("2026-01-03", 3)]
    with pytest.raises(PySparkException):
        stores.run_day(spark, stores.Job("2026-01-02", "dev"), lambda s, j: source(s, stores.Job("2026-01-03", "dev")), stores.day_sink(sink_path))
    plan = stores.day_partition(source_path)(spark, stores.Job("2026-01-02", "dev"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(env" in plan


def test_departures_equal_the_loop(spark):
    rng, rows = random.Random(2), []
    for i in range(300):
        rows.append((i, rng.randint(0, 3), round(rng.uniform(0, 60), 3)))
    got = {r.request_id: r.slot_s for r in R.departures(spark.createDataFrame(rows, "request_id bigint, caller int, arrival_s double"), 1.0).collect()}
    free = {}
    for i, caller, at in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        slot = max(at, free.get(caller, -1e9))
        free[caller] = slot + 1.0
        assert got[i] == pytest.approx(slot)


def calls(n=200):
    rng = random.Random(4)
    return [(rng.randint(1, 4), i, rng.choice([1, 50, 100])) for i in range(n)]


def ledger_by_loop(rows, cap):
    used, out = {}, {}
    for account, call, cost in sorted(rows, key=lambda r: r[1]):
        fits = used.get(account, 0) + cost <= cap
        used[account] = used.get(account, 0) + (cost if fits else 0)
        out[call] = (fits, used[account])
    return out


def test_refused_calls_are_not_charged(spark):
    rows = calls()
    got = R.quota_ledger(spark.createDataFrame(rows, "account bigint, call_no bigint, cost bigint"), 500).collect()
    assert {r.call_no: (r.accepted, r.used) for r in got} == ledger_by_loop(rows, 500)


def test_ledger_as_a_stream(spark, tmp_path):
    rows = calls(60)
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], "account bigint, call_no bigint, cost bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema("account bigint, call_no bigint, cost bigint").parquet(str(tmp_path / "calls"))
    got = flows.replay(flows.ledger(stream, 500)).collect()
    assert {r.call_no: (r.accepted, r.used) for r in got} == ledger_by_loop(rows, 500)


def test_sessions_and_routing(spark, tmp_path):
    rows = [(i, DAY + dt.timedelta(minutes=m), 1, "a.b.c", 1.0, None) for i, m in enumerate((0, 10, 90, 95))]
    spark.createDataFrame(rows, stores.EVENT_SCHEMA).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(stores.EVENT_SCHEMA).parquet(str(tmp_path / "e"))
    got = flows.replay(flows.sessions(stream), "complete").orderBy("session_start").collect()
    assert [r.events for r in got] == [2, 2]
    assert spark.createDataFrame(rows, stores.EVENT_SCHEMA).select(flows.domain_of(F.col("event_type"))).first()[0] == "b"


def test_stream_sink_is_idempotent(spark, tmp_path):
    batch = spark.createDataFrame([("a",), (None,)], "event_type string")
    sink = flows.write_days(str(tmp_path / "good"), str(tmp_path / "dead"))
    sink(batch, 0)
    sink(batch, 0)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1 and spark.read.parquet(str(tmp_path / "dead")).count() == 1


def test_usage(spark):
    make = spark.createDataFrame
    totals = R.projected_usage(make([("prod", "scan", 10.0)], "env string, operation string, volume double"), make([("scan", "m", 3.0, "measured"), ("scan", "n", 1.0, "estimated")], "operation string, metric string, cost double, confidence string"), make([("prod", "m", 5.0)], "env string, metric string, amount double"))
    assert {(r.metric, r.total, r.confidence) for r in totals.collect()} == {("m", 35.0, "declared"), ("n", 10.0, "estimated")}
    limits = make([("l", "own", "monthly", 50.0), ("q", "own", "monthly", 5.0)], "limit_name string, scope string, basis string, total double")
    splits = make([("l", "prod", 50.0), ("q", "prod", 0.0)], "limit_name string, env string, allowance double")
    meters = make([("m", "l"), ("n", "q")], "metric string, limit_name string")
    got = [(r.limit_name, r.pct, r.breached) for r in R.estimate(totals, meters, limits, splits, {"own": 70.0, "provider": 90.0}).collect()]
    assert got == [("q", float("inf"), True), ("l", 70.0, False)]
    with pytest.raises(PySparkException):
        R.estimate(totals, meters.where("metric = 'm'"), limits, splits, {"own": 70.0, "provider": 90.0}).collect()
    with pytest.raises(PySparkException):
        R.estimate(totals, meters, limits.withColumn("basis", F.lit("fixed")), splits, {"own": 70.0, "provider": 90.0}).collect()


def test_unknown_usage_is_not_zero(spark):
    shares = spark.createDataFrame([("a", "prod", 100.0), ("b", "prod", 100.0)], "limit_name string, env string, allowance double")
    usage = spark.createDataFrame([("a", "prod", 85.0)], "limit_name string, env string, used double")
    assert {(r.limit_name, r.pct, r.tripped, r.unknown) for r in R.readings(shares, usage).collect()} == {("a", 85.0, True, False), ("b", None, False, True)}


def by_hand(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_error_rates(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "bb", "é", "夜", "🎵"]) for _ in range(rng.randint(0, 6))) for _ in range(60)] + ["", "a  b"]
    rows = [(i, rng.choice(texts), rng.choice(texts)) for i in range(120)] + [(999, None, "x")]
    got = {r.i: r for r in Q.error_rates(spark.createDataFrame(rows, "i int, reference string, reading string")).collect()}
    for i, a, b in rows:
        flat = [" ".join((t or "").split()) for t in (a, b)]
        assert got[i].char_errors == by_hand(*flat), rows[i]
        words = [f.split() for f in flat]
        assert got[i].word_errors == by_hand(*words)
        assert got[i].cer == pytest.approx(by_hand(*flat) / max(len(flat[0]), 1)) and got[i].wer == pytest.approx(by_hand(*words) / max(len(words[0]), 1))


def test_f1s(spark):
    make = lambda rows: spark.createDataFrame(rows, "g int, title string, artist string")
    got = Q.multiset_f1(make([(1, "A", None), (1, "a ", None), (2, "B", "x")]), make([(1, "a", ""), (3, "C", "y")]), "g").orderBy("g").collect()
    assert [(r.g, r.tp, r.want, r.got, r.precision, r.recall) for r in got] == [(1, 1, 2, 1, 1.0, 0.5), (2, 0, 1, 0, 1.0, 0.0), (3, 0, 0, 1, 0.0, 1.0)]


def test_regressions_and_unmatched(spark):
    make = lambda rows: spark.createDataFrame(rows, "engine string, class string, metric string, value double, higher_is_better boolean")
    now = make([("e", "c", "f1", 0.80, True), ("e", "c", "cer", 0.2, False), ("e", "new", "f1", 0.0, True)])
    before = make([("e", "c", "f1", 0.82, True), ("e", "c", "cer", 0.195, False)])
    assert [(r.metric, round(r.worse_by, 3)) for r in Q.regressions(now, before).collect()] == [("f1", 0.02)]
    keys = lambda *xs: spark.createDataFrame([(x,) for x in xs], "k int")
    assert {(r.k, r.side) for r in Q.unmatched(keys(1, 2, 2), keys(2, 3), "k").collect()} == {(1, "left"), (3, "right")}


def test_catalog_order_and_problems(spark):
    rows = [(i, f"{(i * 7) % 5}") for i in range(10)] + [(250000, "0"), (400000, "9")]
    got = {r.row_id for r in Q.out_of_order(spark.createDataFrame(rows, "row_id bigint, m string"), "m", "row_id").collect()}
    ordered = sorted(rows)
    assert got == {b[0] for a, b in zip(ordered, ordered[1:]) if b[1] < a[1]}


def test_release_flattening(spark):
    release = {
        "id": "r1", "title": "LP", "date": "1999", "disambiguation": "Remastered", "release-group": {"primary-type": "Album", "secondary-types": ["Live"]},
        "media": [{"tracks": [
            {"title": "Intro", "recording": {"id": "m1", "title": "Real Name", "length": 1000, "isrcs": ["B", "A"], "artist-credit": [{"name": "X", "joinphrase": " feat. ", "artist": {"id": "a", "name": "X"}}, {"name": None, "joinphrase": "", "artist": {"id": "b", "name": "Ночь"}}]}},
            {"title": "No id", "recording": {"title": "x"}}, {"title": " ", "recording": {"id": "m2", "artist-credit": [{"name": "X", "artist": {"id": "a"}}]}}, {"title": "No credit", "recording": {"id": "m3", "artist-credit": []}},
        ]}],
    }
    frame = spark.read.schema(C.RELEASE).json(spark.sparkContext.parallelize([json.dumps(release), json.dumps({"id": "r2"}), json.dumps(release | {"id": "r3", "release-group": {"primary-type": "Single"}})]))
    (row,) = C.flatten_releases(C.seed_worthy(frame)).collect()
    assert (row.recording_mbid, row.title, row.artist, row.isrc, row.tags) == ("m1", "Real Name", "X feat. Ночь", "A", ["live", "remaster", "feat", "non_latin"])
    named = spark.createDataFrame([([("X", " feat. "), ("Y", " & "), ("Z", "")],)], "a array<struct<credit_name:string,join_text:string>>")
    assert named.select(C.primary_artist(F.col("a")), C.featured_artists(F.col("a"))).first()[:] == ("X", ["Y", "Z"])


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1), ("a", 2)], "k string, v int")
    stores.write_json_lines(rows, str(tmp_path / "j"), "k")
    with open(tmp_path / "j2", "w") as f:
        f.write('{"k":"a","v":1}\n\n{"k":"b","v":2}\n')
    assert stores.json_lines(spark, str(tmp_path / "j2"), "k string, v int").count() == 2
    assert [r.k for r in stores.json_lines(spark, str(tmp_path / "j"), "k string, v int").orderBy("k").collect()] == ["a", "b"]
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert stores.text_files(spark, str(tmp_path / "t.txt")).first().text == "one\ntwo"
    progress = stores.Progress(str(tmp_path / "state.json"))
    assert progress.read()["completed"] == []
    progress.write(["x"], {"id": "y", "offset": 100})
    assert progress.read()["in_flight"]["offset"] == 100
    progress.clear()
    assert progress.read()["in_flight"] is None
    maps = spark.createDataFrame([('{"a": 1.5}',), ('{"a": "x"}',), ("nope",), (None,)], "r string")
    assert [r[0] for r in maps.select(stores.number_map(F.col("r"))).collect()] == [{"a": 1.5}, None, None, None]
    lines = spark.createDataFrame([("| e | c | 12.5% | 3 | x |",), ("| --- | --- | --- | --- | --- |",), ("text",)], "line string")
    (r,) = stores.report_rows(lines, 5).collect()
    assert (r.engine, r["class"], r.numbers) == ("e", "c", [0.125, 3.0, None])
    spark.sql(stores.rollup_ddl("gleanline_rollup", str(tmp_path / "ext")))
    assert spark.table("gleanline_rollup").columns == ["event_type", "events", "sum_k", "env", "occurred_on"]
    spark.sql("drop table gleanline_rollup")


def test_cycles(spark):
    rows = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 1), (7, 7), (None, 1), (8, None), (1, 2), (9, 10)]
    edges = spark.createDataFrame(rows, "task_id bigint, dep bigint").withColumns({"s": F.lit(1), "node": F.lit("x")})
    assert {r.node for r in C.cyclic(edges).collect()} == {1, 2, 3, 7}
    assert C.cyclic(edges.limit(0)).count() == 0


def test_quota_of_hot_and_odd_accounts(spark):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.7 else rng.randint(2, 9), i, rng.choice([1, 50, 100])) for i in range(3000)] + [(None, 1, 5), (3, 9999, None)]
    got = R.quota_ledger(spark.createDataFrame(rows, "account bigint, call_no bigint, cost bigint").withColumn("used", F.lit("x")), 5000).collect()
    want, used = {}, {}
    for account, call, cost in sorted((r for r in rows if None not in r)):
        fits = used.get(account, 0) + cost <= 5000
        used[account] = used.get(account, 0) + cost * fits
        want[account, call] = (fits, used[account])
    assert {(r.account, r.call_no): (r.accepted, r.used) for r in got} == want
    assert R.quota_ledger(spark.createDataFrame([], "account string, call_no bigint, cost bigint"), 1).count() == 0


def test_offsets_inside_the_row(spark):
    from gleanline.operators import lines as L

    rng = random.Random(4)
    texts = [None, "", "\n", "a", "é🎵\n\nxyz", *("\n".join("ab🎵"[: rng.randint(0, 3)] * rng.randint(0, 4) for _ in range(rng.randint(1, 400))) for _ in range(30))]
    got = {(r.doc_id, r.line_no): (r.line, r.line_offset) for r in L.split_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("parts", F.lit(1))).collect()}
    want = {}
    for i, text in enumerate(texts):
        at = 0
        for n, line in enumerate(text.split("\n") if text is not None else []):
            want[i, n] = (line, at)
            at += len(line) + 1
    assert got == want


def test_cache_keeps_the_newest_answer_while_it_lives(spark):
    day = dt.datetime(2026, 1, 1)
    key = "isrc#USABC1234567"
    rows = [(key, 1, 0.9, "review", day), (key, 2, 1.0, "auto_accept", day + dt.timedelta(days=1)), ("Title|Artist", 3, 1.0, "review", day), (None, 4, 1.0, "review", day)]
    cache = M.cache_rows(spark.createDataFrame(rows, "cache_key string, recording_id bigint, score double, verdict string, made_at timestamp"))
    items = spark.createDataFrame([(10, key), (11, "Title|Artist"), (12, None)], "item_id bigint, cache_key string")
    at = lambda days: [tuple(r) for r in M.from_cache(items, cache, F.lit(day + dt.timedelta(days=days))).collect()]
    assert at(30) == [(10, 2, 1.0, "auto_accept")] and at(31) == []


def test_items_with_nulls(spark):
    from gleanline.operators import items as I

    rows = [(1, "a", "b", 0.5, "dash"), (2, "c", None, None, "tab"), (3, None, "d", 0.95, "tab"), (3, None, "d", 0.95, "tab")]
    frame = spark.createDataFrame(rows, "id int, title string, artist string, confidence double, parser string").withColumns({"least": F.lit(1), "batch": F.lit("x")})
    assert [r.id for r in I.below(frame).collect()] == [1]
    assert [r.alternate and tuple(r.alternate) for r in I.with_alternates(frame, F.col("parser") == "tab").orderBy("id").collect()] == [None, None, ("d", None), ("d", None)]
    assert {r.id: r.fallback for r in I.needs_fallback(spark.createDataFrame([(1,), (3,), (9,)], "id int"), frame, "id").collect()} == {1: True, 3: False, 9: True}
    assert I.wire(frame.limit(1), ["title", "artist"], []).first().wire == '{"artist":"b","title":"a"}'
    assert [r.batch for r in I.batches(frame, "parser", "id", 2).where("parser = 'tab'").orderBy("id", "batch").collect()] == [0, 0, 1]
    assert I.needs_fallback(frame.limit(0), frame, "id").count() == 0


def test_cache_as_a_stream(spark, tmp_path):
    day = dt.datetime(2026, 1, 1)
    at = lambda days: day + dt.timedelta(days=days)
    parts = [[("k", 1, at(0)), ("k", 2, at(5)), ("m", 9, at(1))], [("k", 3, at(29)), ("k", 4, at(31))], [("k", 5, at(40)), ("m", 8, at(45))]]
    kind = "cache_key string, recording_id bigint, ts timestamp"
    for rows in parts:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "answers"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "answers"))
    got = {(r.cache_key, r.recording_id) for r in flows.replay(flows.first_answers(stream)).collect()}
    assert got == {("k", 1), ("m", 9), ("k", 4), ("m", 8)}


def test_images_are_graded_row_by_row(spark):
    kind = "image_id int, lines array<string>, items array<struct<title:string,artist:string>>"
    truths = spark.createDataFrame([(1, ["One", "Two"], [("a", "b"), ("c", None)]), (2, ["x"], []), (3, [" "], None), (4, None, None), (5, ["abcd"], [("t", "u")])], kind)
    readings = spark.createDataFrame([(1, ["one", "Two"], [("A ", "b")], 0.9), (2, [], [], None), (3, [], None, None), (9, ["z"], [], 1.0), (5, ["abcd"], [("t", "u")], 0.9)], kind + ", least double").withColumn("w", F.lit(1))
    got = {r.image_id: r for r in Q.score_images(truths, stores.paired_readings(truths, readings)).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and (got[1].precision, got[1].recall, got[1].fallback, got[1].empty) == (1.0, 0.5, False, False)
    assert round(got[1].cer, 4) == round(1 / 7, 4) and got[2].empty and not got[3].empty and got[2].fallback and got[5].cer == 0 and got[5].f1 == 1
    with pytest.raises(ValueError, match="no readings"):
        stores.paired_readings(truths, readings.where("image_id = 9"))


def test_small_report_functions(spark):
    from gleanline.functions import score as S
    from gleanline.functions import text as T

    numbers = [(0.0, "0"), (12345.6, "12,346"), (12.0, "12"), (12.345, "12.35"), (0.0077, "0.0077"), (0.51234, "0.51"), (float("inf"), "∞")]
    got = [r[0] for r in spark.createDataFrame([(n,) for n, _ in numbers], "v double").select(S.shown_number(F.col("v"))).collect()]
    assert got == [text for _, text in numbers]
    assert [r[0] for r in spark.createDataFrame([(95.0, True), (61.0, True), (60.0, True), (99.0, False)], "p double, m boolean").select(S.mark(F.col("p"), F.lit(90.0), F.col("m"))).collect()] == ["FAIL", "watch", "ok", "·"]
    assert all(r for r in spark.range(1).select(*[holds for _, holds in T.unicode_checks()]).first())
    frame = spark.createDataFrame([(1, "a")], "id int, name string")
    assert stores.schema_drift(frame, frame.schema.json()) == []
    assert stores.schema_drift(frame.withColumn("id", F.lit("x")).withColumnRenamed("name", "title"), frame.schema.json()) == ["name is gone", "title is new", "id has changed"]


def test_spaced_starts_by_loop(spark):
    rng = random.Random(6)
    rows = [(i, rng.randint(1, 3), float(rng.randint(0, 500)), float(rng.randint(0, 9)) if rng.random() < 0.8 else None) for i in range(200)]
    got = {r.request_id: r.start_s for r in R.spaced(spark.createDataFrame(rows, "request_id int, caller int, arrival_s double, overshoot_s double"), 10.0).collect()}
    last, want = {}, {}
    for i, caller, at, late in sorted(rows, key=lambda r: (r[2], r[0])):
        last[caller] = max(at, last.get(caller, float("-inf")) + 10.0) + (late or 0.0)
        want[i] = last[caller]
    assert got == pytest.approx(want)


def test_noise_keeps_what_it_says(spark):
    from gleanline.functions import noise as Z

    texts = ["Hello wide world", "", "  ", "two\nlines", None, "é🎵x", "a" * 2000]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for change, plain in ((Z.zero_width(F.col("t"), rate=0.5), lambda s: "".join(c for c in s if c not in Z.ZERO_WIDTH)), (Z.recase(F.col("t"), "turns"), str.lower), (Z.ragged(F.col("t"), rate=0.9), lambda s: "\n".join(x.strip() for x in s.split("\n")))):
        got = [r[0] for r in frame.select(change).collect()]
        assert [g is None for g in got] == [t is None for t in texts]
        assert all(plain(g) == plain(t) for g, t in zip(got, texts, strict=True) if t is not None)
    typed = [r[0] for r in frame.select(Z.typos(F.col("t"), rate=0.5)).collect()]
    assert typed[3].count("\n") == 1 and typed[0] != texts[0] and typed[1] == "" and typed == [r[0] for r in frame.select(Z.typos(F.col("t"), rate=0.5)).collect()]
