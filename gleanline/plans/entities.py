"""Queries of matching, roll-ups, usage, grades, the catalog and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanline.functions import score as S
from gleanline.functions import text as T
from gleanline.operators import catalog as C
from gleanline.operators import match as M
from gleanline.operators import quality as Q
from gleanline.operators import rollup as R
from gleanline.operators.units import resolve_lengths
from gleanline.sources import stores
from gleanline.session import cut, table
from gleanline.streaming import flows

ENV = "case user_id % 3 when 0 then 'dev' when 1 then 'stage' else 'prod' end"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return R.payload_events(table(spark, folder, "events").withColumn("env", F.expr(ENV)))


# Roll-ups.


def g1_daily_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return R.daily_rollup(_events(spark, folder), ["k"])


def g2_rollup_keys(spark: SparkSession, folder: str) -> DataFrame:
    rolled = R.daily_rollup(_events(spark, folder), [])
    return rolled.select(R.rollup_key(F.col("env"), F.col("occurred_on"), F.col("event_type")).alias("agg_key"), "events")


def s14_month_to_date(spark: SparkSession, folder: str) -> DataFrame:
    return R.month_to_date(table(spark, folder, "events")).select("event_type", "day", F.round("day_sum", 4).alias("day_sum"), F.round("month_sum", 4).alias("month_sum"))


def w2_departures(spark: SparkSession, folder: str) -> DataFrame:
    requests = table(spark, folder, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("caller"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("arrival_s"))
    return R.departures(requests, 1000.0).select("request_id", "slot_s")


def w7_quota_ledger(spark: SparkSession, folder: str) -> DataFrame:
    calls = table(spark, folder, "events").select(F.col("user_id").alias("account"), F.col("event_id").alias("call_no"), F.when(F.col("event_type") == "purchase", 100).otherwise(50).alias("cost"))
    return R.quota_ledger(calls, 500)


# Usage model: metered volumes against allowances, as small tables.

_VOLUMES = [("prod", "scan", 28000.0), ("prod", "job", 236.0), ("stage", "scan", 2000.0), ("stage", "job", 50.0), ("dev", "scan", 1000.0), ("dev", "job", 16.0)]
_COSTS = [("scan", "requests", 3.0, "estimated"), ("scan", "writes", 2.0, "estimated"), ("job", "requests", 12.0, "measured"), ("job", "units", 800.0, "estimated")]
_BASELINE = [("prod", "traces", 5000.0), ("stage", "traces", 1000.0), ("dev", "traces", 500.0)]
_METERS = [("requests", "requests"), ("writes", "write_rate"), ("units", "units_per_day"), ("traces", "traces")]
_LIMITS = [("requests", "own", "monthly", 1000000.0), ("write_rate", "own", "per_second", 25.0), ("units_per_day", "provider", "per_day", 10000.0), ("traces", "own", "monthly", 100000.0)]
_SPLITS = [
    ("requests", "prod", 500000.0), ("requests", "stage", 120000.0), ("requests", "dev", 80000.0), ("write_rate", "prod", 10.0), ("write_rate", "stage", 4.0), ("write_rate", "dev", 3.0),
    ("units_per_day", "prod", 7000.0), ("units_per_day", "stage", 1500.0), ("units_per_day", "dev", 500.0), ("traces", "prod", 50000.0), ("traces", "stage", 15000.0), ("traces", "dev", 0.0),
]


def _model(spark: SparkSession) -> dict[str, DataFrame]:
    make = spark.createDataFrame
    return {
        "totals": R.projected_usage(make(_VOLUMES, "env string, operation string, volume double"), make(_COSTS, "operation string, metric string, cost double, confidence string"), make(_BASELINE, "env string, metric string, amount double")),
        "meters": make(_METERS, "metric string, limit_name string"), "limits": make(_LIMITS, "limit_name string, scope string, basis string, total double"), "splits": make(_SPLITS, "limit_name string, env string, allowance double"),
    }


def g6_projected_usage(spark: SparkSession, folder: str) -> DataFrame:
    return _model(spark)["totals"]


def g7_estimate(spark: SparkSession, folder: str) -> DataFrame:
    m = _model(spark)
    rows = R.estimate(m["totals"], m["meters"], m["limits"], m["splits"], {"provider": 90.0, "own": 70.0})
    return rows.withColumns({"metrics": F.array_join("metrics", ","), "projected": F.round("projected", 6), "pct": F.round("pct", 6)})


def g8_readings(spark: SparkSession, folder: str) -> DataFrame:
    shares = spark.createDataFrame([(t, e, 100.0 * n) for n, t in enumerate(("click", "view", "purchase", "unseen"), 3) for e in ("dev", "stage", "prod")], "limit_name string, env string, allowance double")
    usage = table(spark, folder, "events").groupBy(F.col("event_type").alias("limit_name"), F.expr(ENV).alias("env")).agg(F.count("*").cast("double").alias("used"))
    return R.readings(shares, usage).withColumn("pct", F.round("pct", 6))


def g21_over_allocated(spark: SparkSession, folder: str) -> DataFrame:
    m = _model(spark)
    return R.over_allocated(m["limits"].withColumn("total", F.when(F.col("limit_name") == "traces", 60000.0).otherwise(F.col("total"))), m["splits"]).select("limit_name", "total", "shared")


# Matching.


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidate")
    none = F.lit(None).cast("string")
    recorded = rows.select(
        F.lit("candidate").alias("tbl"), F.col("candidate_id").alias("rec_id"), F.col("provider").alias("source"), F.date_format("listed_at", "yyyy-MM").alias("period"),
        F.lit("s").alias("home"), F.col("duration_s").alias("number"), none.alias("unit_text"), F.col("duration_label").alias("label"),
    )
    lengths = resolve_lengths(recorded).select(F.col("rec_id").alias("recording_id"), (F.col("length_ms") / 1000.0).alias("duration_s"))
    listed = rows.select(F.col("candidate_id").alias("recording_id"), "title", "artist", none.alias("isrc"), "qualifiers", "popularity", F.col("candidate_id").alias("pos"))
    return listed.join(lengths, "recording_id", "left")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "match_input").select(F.col("input_id").alias("item_id"), "title", "artist", "isrc", "duration_s", "qualifiers", "alternate").dropDuplicates(["item_id"])


def x1_resolve(spark: SparkSession, folder: str) -> DataFrame:
    return M.resolve(_items(spark, folder), _catalog(spark, folder)).withColumn("score", F.round("score", 9))


def x3_rematch(spark: SparkSession, folder: str) -> DataFrame:
    fresh = cut(M.resolve(_items(spark, folder), _catalog(spark, folder)))  # compared with what is stored of it
    stored = fresh.where("item_id % 10 > 0").withColumn("verdict", F.when(F.col("item_id") % 10 == 1, "review").otherwise(F.col("verdict")))
    return M.rematch(stored, fresh)


def j1_isrc_lookup(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "match_input").select(F.col("input_id").alias("item_id"), T.isrc(F.col("isrc")).alias("isrc")).distinct()
    listed = table(spark, folder, "seed_row").select(F.col("row_id").alias("recording_id"), T.isrc(F.col("isrc")).alias("isrc"), F.col("row_id").alias("pos"))
    return M.by_isrc(items, listed)


def k3_token_set_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Each part's name beside that of its brand's next part."""
    after = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = table(spark, folder, "part").select("p_partkey", "p_name", after.alias("next_name")).where("next_name is not null")
    return rows.select("p_partkey", S.token_set_ratio(T.tokens(F.col("p_name")), T.tokens(F.col("next_name"))).alias("ratio"))


def k5_length_similarity(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 400).alias("d"))
    return rows.select("l_orderkey", "l_linenumber", F.round(S.length_similarity(F.col("l_quantity"), F.col("d")), 9).alias("similarity"))


def k6_qualifier_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Each recording's qualifiers as wanted, beside those of the next recording as offered."""
    rows = table(spark, folder, "candidate").select("candidate_id", F.coalesce("qualifiers", F.array().cast("array<string>")).alias("wanted"))
    after = rows.select((F.col("candidate_id") - 1).alias("candidate_id"), F.col("wanted").alias("offered"))
    return rows.join(after, "candidate_id").select("candidate_id", S.qualifier_similarity(F.col("wanted"), F.col("offered")).alias("similarity"))


def _confidence(rows: DataFrame) -> DataFrame:
    conf = S.confidence(F.col("parser"), F.col("title"), F.col("artist"), T.isrc(F.col("hints.isrc")).isNotNull(), F.lit(False), F.lit(False), F.col("hints.list_pos").isNotNull())
    return rows.select("line_id", F.round(conf, 9).alias("confidence"))


def k1_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return _confidence(table(spark, folder, "list_line").where("title is not null"))


def k8_best_candidate(spark: SparkSession, folder: str) -> DataFrame:
    """Most discounted line of an order, near ties going to the larger quantity."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("pos"), F.col("l_discount").alias("score"), F.col("l_quantity").cast("double").alias("popularity")).alias("s"))
    best = rows.groupBy("l_orderkey").agg(S.best_of(F.collect_list("s")).alias("b"))  # an order's lines are few
    return best.select("l_orderkey", F.col("b.pos").alias("l_linenumber"), F.round("b.score", 9).alias("score"))


# Grades.


def g15_edit_distance(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("reference"), F.concat_ws(" ", F.element_at(F.split("p_name", " "), -1), F.element_at(F.split("p_name", " "), 1)).alias("reading"))
    out = Q.error_rates(rows)
    return out.select("p_partkey", "char_errors", "word_errors", F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"))


def g12_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("engine"), F.col("l_linestatus").alias("class"), F.col("l_linenumber").alias("char_errors"), F.col("l_quantity").alias("chars"), F.col("l_linenumber").alias("word_errors"),
        F.lit(10).alias("n_words"), F.col("l_discount").alias("f1"), F.col("l_quantity").alias("ms"), (F.col("l_linenumber") == 1).alias("empty"), (F.col("l_discount") < 0.05).alias("fallback"),
    )
    out = Q.summary(rows, "engine", "class")
    return out.select("engine", "class", "n", *[F.round(c, 6).alias(c) for c in ("cer", "wer", "f1", "median_ms", "fallback_share")], "empties")


def _multiset_f1(lines: DataFrame) -> DataFrame:
    rows = lines.select("list_id", "title", "artist", "line_no")
    out = Q.multiset_f1(rows.where("line_no % 3 < 2"), rows.where("line_no % 3 > 0"), "list_id")
    return out.select("list_id", "tp", "want", "got", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


def g13_multiset_f1(spark: SparkSession, folder: str) -> DataFrame:
    return _multiset_f1(table(spark, folder, "list_line").where("title is not null"))


def g14_set_f1(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "list_line").select(F.col("list_id").alias("doc_id"), "parser", F.lower("title").alias("ftitle"), F.lower("artist").alias("fartist"), "line_no").where("ftitle is not null")
    out = Q.set_f1(rows.where("line_no % 3 < 2"), rows.where("line_no % 3 > 0"), "parser")
    return out.select("parser", "tp", "want", "got", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


def g18_regressions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    metric = lambda f: f.groupBy(F.col("l_returnflag").alias("engine"), F.col("l_linestatus").alias("class"), F.col("l_linenumber").cast("string").alias("metric")).agg(F.avg("l_discount").alias("value"))
    now = metric(rows.where("l_orderkey % 2 = 0")).withColumn("higher_is_better", F.col("metric") < "4")
    out = Q.regressions(now, metric(rows.where("l_orderkey % 2 = 1")), 0.0005)
    return out.select("engine", "class", "metric", F.round("worse_by", 9).alias("worse_by"))


def j9_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    left = table(spark, folder, "orders").select(F.col("o_custkey").alias("cust"))
    return Q.unmatched(left, table(spark, folder, "customer").select((F.col("c_custkey") + 7).alias("cust")), "cust")


# Catalog.


def g19_problems(spark: SparkSession, folder: str) -> DataFrame:
    return Q.catalog_problems(table(spark, folder, "seed_row"))


def g19_floors(spark: SparkSession, folder: str) -> DataFrame:
    return Q.catalog_floors(table(spark, folder, "seed_row"), {"live": 100, "remaster": 50, "feat": 100, "non_latin": 150})


def w8_out_of_order(spark: SparkSession, folder: str) -> DataFrame:
    return Q.out_of_order(table(spark, folder, "seed_row").select("recording_mbid", "row_id"), "recording_mbid", "row_id").select("row_id", "recording_mbid")


def n22_credit_line(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "seed_row").where("artists is not null")
    feats = C.featured_artists(F.col("artists"))
    return rows.select("row_id", C.credit_line(F.col("artists")).alias("credit"), C.primary_artist(F.col("artists")).alias("primary_name"), F.array_join(feats, ";").alias("featured"))


def n23_tags(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "seed_row")
    none = F.array().cast("array<string>")
    made = C.tags(F.col("artists"), F.col("title"), F.col("version_note"), F.col("artist"), none, F.col("release_title"), F.lit(""))
    return rows.select("row_id", F.array_join(made, ",").alias("tags"))


def f14_usable(spark: SparkSession, folder: str) -> DataFrame:
    return C.usable_truth(table(spark, folder, "seed_row")).select("row_id")


def w4_first_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return C.first_by_id(table(spark, folder, "seed_row")).select("row_id")


def w5_capped_harvest(spark: SparkSession, folder: str) -> DataFrame:
    return C.capped_harvest(table(spark, folder, "seed_row").where("artist is not null"), 5, 1).select("row_id")


def x5_flatten_releases(spark: SparkSession, folder: str) -> DataFrame:
    """Seed rows nested into releases, and flattened again."""
    rows = table(spark, folder, "seed_row").where("artists is not null and release_mbid is not null and release_title is not null")
    credit = F.transform("artists", lambda a: F.struct(a["credit_name"].alias("name"), a["join_text"].alias("joinphrase"), F.struct(a["mbid"].alias("id"), a["credit_name"].alias("name")).alias("artist")))
    rec = F.struct(F.col("recording_mbid").alias("id"), "title", F.coalesce("version_note", F.lit("")).alias("disambiguation"), F.lit(None).cast("bigint").alias("length"), "isrcs", credit.alias("artist-credit"))
    track = F.struct(F.lit(None).cast("string").alias("title"), rec.alias("recording"))
    nested = rows.groupBy(F.col("release_mbid").alias("id")).agg(F.min("release_title").alias("title"), F.min("release_date").alias("date"), F.array(F.struct(F.collect_list(track).alias("tracks"))).alias("media"))  # a release's tracks
    nested = nested.withColumns({"disambiguation": F.lit(""), "release-group": F.struct(F.lit("Album").alias("primary-type"), F.array().cast("array<string>").alias("secondary-types"))})
    return C.flatten_releases(C.seed_worthy(nested)).select("recording_mbid", "title", "artist", "isrc", "release_mbid")


def j17_covered(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "candidate").select(F.col("candidate_id").alias("text_id"), F.col("title").alias("text"))
    fonts = spark.createDataFrame([("latin", 32, 383), ("greek", 32, 126), ("greek", 880, 1023), ("cyrillic", 32, 126), ("cyrillic", 1024, 1279)], "font string, low int, high int")
    return C.covered_by(texts, fonts)


def j18_not_ready(spark: SparkSession, folder: str) -> DataFrame:
    tasks = table(spark, folder, "orders").select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"), F.array(F.col("o_orderkey") - 1, F.col("o_orderkey") + 1).alias("deps"))
    return C.not_ready(tasks)


def x17_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as tasks, each depending on the part that a step rule names: those on a cycle."""
    parts = table(spark, folder, "part").select("p_partkey", F.length("p_name").alias("n"))
    return C.cyclic(parts.select("p_partkey", ((F.col("p_partkey") * F.col("n") + 1) % 199 + 1).alias("dep")), "p_partkey").select(F.col("node").alias("p_partkey"))


# Streams, replayed over the events as files.


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def k_stream_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming counterpart of the daily roll-up, replayed to its end."""
    out = flows.tumbling(_stream(spark, folder), "1 day", "3650 days")
    return flows.replay(out, "complete").select(F.to_date("window_start").alias("day"), "event_type", "events", F.round("value_sum", 4).alias("value_sum"))


def k_stream_once(spark: SparkSession, folder: str) -> DataFrame:
    """Redelivered events taken in once."""
    events = _stream(spark, folder)
    twice = events.unionByName(events)
    return flows.replay(flows.once(twice, "event_id", "3650 days").select("event_id", "event_type"))


def f12_routed(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("env", F.expr(ENV))
    return flows.routed(rows, ["purchase", "click"], ["prod"]).select("event_id", "event_type", "env")


def s21_number_map(spark: SparkSession, folder: str) -> DataFrame:
    parsed = stores.number_map(F.col("props"))
    return table(spark, folder, "events").select("event_id", F.element_at(parsed, F.lit("k")).alias("k"), F.size(parsed).alias("n"))


def s22_sharded(spark: SparkSession, folder: str) -> DataFrame:
    """Reading lines trimmed and without blanks, dealt round-robin to workers."""
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", "text").repartition(8)
    lines = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")
    return docs.select("doc_id", F.size(lines).alias("n_lines"), F.array_join(F.slice(lines, 1, 1), "").alias("first_line"))


QUERIES = {
    f.__name__: f
    for f in (
        g1_daily_rollup, g2_rollup_keys, s14_month_to_date, w2_departures, w7_quota_ledger, g6_projected_usage, g7_estimate, g8_readings, g21_over_allocated, x1_resolve, x3_rematch, j1_isrc_lookup,
        k3_token_set_ratio, k5_length_similarity, k6_qualifier_similarity, k1_confidence, k8_best_candidate, g15_edit_distance, g12_summary, g13_multiset_f1, g14_set_f1, g18_regressions, j9_unmatched,
        g19_problems, g19_floors, w8_out_of_order, n22_credit_line, n23_tags, f14_usable, w4_first_by_id, w5_capped_harvest, x5_flatten_releases, j17_covered, j18_not_ready, x17_cycles,
        k_stream_rollup, k_stream_once, f12_routed, s21_number_map, s22_sharded,
    )
}

_ENV = f"({ENV})"


def _values(rows: list[tuple], names: str) -> str:
    return "(values " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"cast({v} as double)" for v in r) + ")" for r in rows) + f") as t({names})"


_TOTALS = f"""volumes as (select * from {_values(_VOLUMES, 'env, operation, volume')}), costs as (select * from {_values(_COSTS, 'operation, metric, cost, confidence')}),
baseline as (select * from {_values(_BASELINE, 'env, metric, amount')}), parts as (select env, metric, volume * cost as amount, confidence from volumes join costs using (operation)
union all select env, metric, amount, 'declared' from baseline), totals as (select env, metric, sum(amount) as total,
case max(case confidence when 'measured' then 0 when 'estimated' then 1 else 2 end) when 0 then 'measured' when 1 then 'estimated' else 'declared' end as confidence from parts group by env, metric)"""
_SPACES = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{_SPACES}]+', ''), '[{_SPACES}]+$', '')"



_FEAT_AT = r"coalesce(list_position(list_transform(artists, lambda a: regexp_matches(a.join_text, '(?i)(^|[^\p{L}\p{N}_])feat')), true), 0)"

ORACLES = {
    "g1_daily_rollup": f"select {_ENV} as env, cast(ts as date) as occurred_on, event_type, count(*) as events, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as sum_k from events group by all",
    "g2_rollup_keys": f"select 'AGG#' || {_ENV} || '#' || cast(cast(ts as date) as varchar) || '/TYPE#' || event_type as agg_key, count(*) as events from events group by 1",
    "s14_month_to_date": "with d as (select event_type, cast(ts as date) as day, sum(value) as s from events group by 1, 2) select event_type, day, round(s, 4) as day_sum, round(sum(s) over (partition by event_type, date_trunc('month', day) order by day), 4) as month_sum from d",
    "w2_departures": """with r as (select event_id, user_id, cast(epoch_us(ts) // 1000 as double) as a, (row_number() over (partition by user_id order by cast(epoch_us(ts) // 1000 as double), event_id) - 1) * 1000.0 as turn from events)
        select event_id as request_id, cast(max(a - turn) over (partition by user_id order by a, event_id rows between unbounded preceding and current row) + turn as double) as slot_s from r""",
    "g6_projected_usage": f"with {_TOTALS} select env, metric, total, confidence from totals",
    "g7_estimate": f"""with {_TOTALS}, meters as (select * from {_values(_METERS, 'metric, limit_name')}), limits as (select * from {_values(_LIMITS, 'limit_name, scope, basis, total_limit')}),
        splits as (select * from {_values(_SPLITS, 'limit_name, env, allowance')}), used as (select env, limit_name, sum(total) as monthly, array_to_string(list_sort(list(distinct metric)), ',') as metrics from totals join meters using (metric) group by 1, 2),
        p as (select u.env, u.limit_name, l.scope, case l.basis when 'monthly' then monthly when 'per_day' then monthly / 30 else monthly / (30 * 86400) end as projected, s.allowance, u.metrics from used u join limits l using (limit_name) left join splits s using (limit_name, env)),
        q as (select *, case when allowance > 0 then 100.0 * projected / allowance when projected > 0 then cast('inf' as double) else 0 end as pct from p)
        select env, limit_name, scope, round(projected, 6) as projected, allowance, round(pct, 6) as pct, pct > case scope when 'provider' then 90 else 70 end as breached, metrics from q""",
    "g8_readings": f"""with shares as (select t as limit_name, e as env, cast(100.0 * n as double) as allowance from (values ('click', 3), ('view', 4), ('purchase', 5), ('unseen', 6)) a(t, n), (values ('dev'), ('stage'), ('prod')) b(e)),
        usage as (select event_type as limit_name, {_ENV} as env, cast(count(*) as double) as used from events group by 1, 2)
        select limit_name, env, allowance, used, used is null as unknown, round(100.0 * used / allowance, 6) as pct, coalesce(100.0 * used / allowance >= 85, false) as tripped from shares left join usage using (limit_name, env)""",
    "g21_over_allocated": f"with limits as (select limit_name, case limit_name when 'traces' then 60000.0::double else total end as total from {_values(_LIMITS, 'limit_name, scope, basis, total')}), s as (select limit_name, sum(allowance) as shared from {_values(_SPLITS, 'limit_name, env, allowance')} group by 1) select limit_name, total, shared from limits join s using (limit_name) where shared > total",
    "j1_isrc_lookup": r"""with i as (select distinct input_id as item_id, upper(regexp_replace(isrc, '[\s\-]+', '', 'g')) as isrc from match_input), c as (select upper(regexp_replace(isrc, '[\s\-]+', '', 'g')) as isrc, min(row_id) as recording_id from seed_row group by 1)
        select item_id, recording_id, 1.0::double as score, 'auto_accept' as verdict from i join c using (isrc) where regexp_full_match(isrc, '[A-Z]{2}[A-Z0-9]{3}[0-9]{7}')""",
    "k3_token_set_ratio": """with p as (select p_partkey, p_name, lead(p_name) over (partition by p_brand order by p_partkey) as n from part), t as (select p_partkey, list_distinct(string_split(p_name, ' ')) as x, list_distinct(string_split(n, ' ')) as y from p where n is not null)
        select p_partkey, cast(len(list_intersect(x, y)) as double) / least(len(x), len(y)) as ratio from t""",
    "k5_length_similarity": "with g as (select l_orderkey, l_linenumber, abs(l_quantity - l_discount * 400) as gap from lineitem) select l_orderkey, l_linenumber, round(case when gap is null then 0.5 when gap <= 3 then 1 else greatest(0, 1 - (gap - 3) / 9) end, 9) as similarity from g",
    "k6_qualifier_similarity": """with c as (select candidate_id, list_distinct(coalesce(qualifiers, [])) as q from candidate), p as (select a.candidate_id, a.q as w, b.q as o from c a join c b on b.candidate_id = a.candidate_id + 1)
        select candidate_id, cast(greatest(0, 1 - 0.25 * len(list_filter(w, lambda x: not list_contains(o, x))) - 0.5 * len(list_filter(o, lambda x: not list_contains(w, x)))) as double) as similarity from p""",
    "k1_confidence": r"""select line_id, round(least(1.0, greatest(0.0, case parser when 'csv' then 0.97 when 'csv_headerless' then 0.8 when 'quoted' then 0.95 when 'by' then 0.92 when 'dash' then 0.9 when 'tab' then 0.93 else 0.55 end
        + case when coalesce(artist, '') = '' then -0.25 else 0 end + case when len(string_split(trim(regexp_replace(title, '\s+', ' ', 'g')), ' ')) = 1 and trim(title) <> '' then -0.05 else 0 end + case when not regexp_matches(title, '[\p{L}\p{N}]') then -0.35 else 0 end
        + case when regexp_full_match(upper(regexp_replace(hints.isrc, '[\s\-]+', '', 'g')), '[A-Z]{2}[A-Z0-9]{3}[0-9]{7}') then 0.03 else 0 end + case when hints.list_pos is not null then 0.02 else 0 end))::double, 9) as confidence from list_line where title is not null""",
    "k8_best_candidate": "select l_orderkey, l_linenumber, round(l_discount, 9) as score from lineitem qualify row_number() over (partition by l_orderkey order by round(l_discount, 6) desc, l_quantity desc, l_linenumber) = 1",
    "g15_edit_distance": """with p as (select p_partkey, p_name as a, string_split(p_name, ' ')[-1] || ' ' || string_split(p_name, ' ')[1] as b from part), e as (select p_partkey, levenshtein(a, b) as c, length(a) as n, case when a = b then 0 when len(string_split(a, ' ')) = 2 then 2 else 0 end as w, len(string_split(a, ' ')) as m from p)
        select p_partkey, cast(c as int) as char_errors, cast(w as int) as word_errors, round(c / greatest(n, 1), 9) as cer, round(w / greatest(m, 1), 9) as wer from e""",
    "g12_summary": """select l_returnflag as engine, l_linestatus as class, count(*) as n, round(sum(l_linenumber) / sum(l_quantity), 6)::double as cer, round(sum(l_linenumber) / (count(*) * 10.0), 6)::double as wer, round(avg(l_discount), 6)::double as f1, round(median(l_quantity), 6)::double as median_ms,
        round(avg(case when l_discount < 0.05 then 1.0 else 0.0 end), 6)::double as fallback_share, count(*) filter (where l_linenumber = 1) as empties from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag))""",
    "g13_multiset_f1": f"""with r as (select list_id, lower({_strip('title')}) || '|' || lower({_strip("coalesce(artist, '')")}) as k, line_no from list_line where title is not null),
        w as (select list_id, k, count(*) as want from r where line_no % 3 < 2 group by 1, 2), g as (select list_id, k, count(*) as got from r where line_no % 3 > 0 group by 1, 2),
        s as (select list_id, cast(sum(least(coalesce(want, 0), coalesce(got, 0))) as bigint) as tp, cast(sum(coalesce(want, 0)) as bigint) as want, cast(sum(coalesce(got, 0)) as bigint) as got from w full join g using (list_id, k) group by 1),
        p as (select *, case when got > 0 then tp / got else 1.0 end as pr, case when want > 0 then tp / want else 1.0 end as rc from s)
        select list_id, tp, want, got, round(pr, 9)::double as precision, round(rc, 9)::double as recall, round(case when tp > 0 then 2 * pr * rc / (pr + rc) else 0 end, 9)::double as f1 from p""",
    "g14_set_f1": """with r as (select list_id, parser, lower(title) as t, coalesce(lower(artist), '') as a, line_no from list_line where title is not null), w as (select distinct list_id, parser, t, a, 1 as w from r where line_no % 3 < 2), g as (select distinct list_id, parser, t, a, 1 as g from r where line_no % 3 > 0),
        s as (select parser, count(*) filter (where w is not null and g is not null) as tp, count(w) as want, count(g) as got from w full join g using (list_id, parser, t, a) group by 1), p as (select *, tp / got as pr, tp / want as rc from s)
        select parser, tp, want, got, round(pr, 9) as precision, round(rc, 9) as recall, round(2 * pr * rc / (pr + rc), 9) as f1 from p""",
    "g18_regressions": """with m as (select l_orderkey % 2 as o, l_returnflag as engine, l_linestatus as class, cast(l_linenumber as varchar) as metric, avg(l_discount) as v from lineitem group by all), j as (select n.engine, n.class, n.metric, case when n.metric < '4' then b.v - n.v else n.v - b.v end as worse from m n join m b using (engine, class, metric) where n.o = 0 and b.o = 1)
        select engine, class, metric, round(worse, 9) as worse_by from j where worse > 0.0005""",
    "j9_unmatched": "with a as (select distinct o_custkey as cust from orders), b as (select distinct c_custkey + 7 as cust from customer) select coalesce(a.cust, b.cust) as cust, case when a.cust is null then 'right' else 'left' end as side from a full join b on a.cust = b.cust where a.cust is null or b.cust is null",
    "g19_problems": f"""with first as (select recording_mbid, min(row_id) as first_row from seed_row group by 1) select row_id, unnest(list_filter([case when coalesce({_strip('recording_mbid')} = '', true) then 'no recording id' end, case when coalesce({_strip('title')} = '', true) then 'empty title' end,
        case when coalesce({_strip('artist')} = '', true) then 'empty artist' end, case when artists is null or len(artists) = 0 then 'no credits' end, case when isrc is not null and not regexp_full_match(isrc, '[A-Z]{{2}}[A-Z0-9]{{3}}[0-9]{{7}}') then 'malformed code' end,
        case when isrc is not null and not coalesce(list_contains(isrcs, isrc), false) then 'code not listed' end], lambda x: x is not null)) as problem from seed_row
        union all select row_id, 'duplicate recording id' from seed_row join first using (recording_mbid) where row_id <> first_row""",
    "g19_floors": """with t as (select count(*) filter (where list_contains(tags, 'live')) as live, count(*) filter (where list_contains(tags, 'remaster')) as remaster, count(*) filter (where list_contains(tags, 'feat')) as feat, count(*) filter (where list_contains(tags, 'non_latin')) as non_latin, avg(case when isrc is null then 0.0 else 1.0 end) as s from seed_row)
        select name, found::double as found, floor::double as floor, coalesce(found >= floor, false) as ok from (select 'live' as name, live::double as found, 100.0::double as floor from t union all select 'remaster', remaster, 50 from t union all select 'feat', feat, 100 from t union all select 'non_latin', non_latin, 150 from t union all select 'isrc_share', s, 0.8 from t)""",
    "w8_out_of_order": "select row_id, recording_mbid from seed_row qualify recording_mbid < lag(recording_mbid) over (order by row_id)",
    "n22_credit_line": f"""with r as (select row_id, artists, {_FEAT_AT} as k from seed_row where artists is not null) select row_id, trim(array_to_string(list_transform(artists, lambda a: coalesce(a.credit_name, '') || coalesce(a.join_text, '')), '')) as credit,
        trim(case when k > 0 then array_to_string(list_transform(artists[1:k - 1], lambda a: coalesce(a.credit_name, '') || coalesce(a.join_text, '')), '') || coalesce(artists[k].credit_name, '')
        else array_to_string(list_transform(artists[1:len(artists) - 1], lambda a: coalesce(a.credit_name, '') || coalesce(a.join_text, '')), '') || coalesce(artists[len(artists)].credit_name, '') end) as primary_name,
        coalesce(case when k > 0 then array_to_string(list_transform(artists[k + 1:], lambda a: a.credit_name), ';') end, '') as featured from r""",
    "n23_tags": r"""select row_id, array_to_string(list_filter([case when contains(lower(concat_ws(' ', release_title, '', version_note)), 'remaster') then 'remaster' end,
        case when coalesce(len(artists) > 1 and len(list_filter(artists, lambda a: regexp_matches(coalesce(a.join_text, ''), '(?i)(^|[^\p{L}\p{N}_])(?:feat\.?|featuring|with)([^\p{L}\p{N}_]|$)'))) > 0, false) then 'feat' end,
        case when coalesce(regexp_matches(title, '[^\x{0}-\x{36f}\x{2000}-\x{2bff}\x{fe00}-\x{fe0f}]'), false) or coalesce(regexp_matches(artist, '[^\x{0}-\x{36f}\x{2000}-\x{2bff}\x{fe00}-\x{fe0f}]'), false) then 'non_latin' end], lambda x: x is not null), ',') as tags from seed_row""",
    "f14_usable": f"""with r as (select row_id, {_strip('title')} as t, {_strip('artist')} as a from seed_row) select row_id from r where t <> '' and a <> '' and length(t) <= 90 and length(a) <= 70 and regexp_matches(t, '\\p{{L}}') and not regexp_matches(t, '[\\n\\r\\t]') and not regexp_matches(a, '[\\n\\r\\t]')
        and not regexp_matches(t, '[(\\[].{{0,40}}[)\\]]\\s*$') and not regexp_matches(t, '\\s[-–—]\\s*\\S{{1,20}}\\s*$') and not regexp_matches(t, '\\s[-–—~|/•·]\\s') and not regexp_matches(a, '\\s[-–—~|/•·]\\s') and not regexp_matches(t, '(?i)\\sby\\s')""",
    "w4_first_by_id": "select row_id from seed_row where recording_mbid is not null qualify row_number() over (partition by recording_mbid order by isrc is null, row_id) = 1",
    "w5_capped_harvest": "with k as (select *, row_number() over (partition by artist, isrc is null order by row_id) as kr from seed_row where artist is not null) select row_id from k where isrc is not null or kr <= 1 qualify row_number() over (partition by artist order by row_id) <= 5",
    "x5_flatten_releases": """with r as (select *, list_filter(artists, lambda a: a.credit_name is not null and a.mbid is not null) as c from seed_row where artists is not null and release_mbid is not null and release_title is not null and recording_mbid is not null and trim(title) <> '')
        select recording_mbid, title, trim(array_to_string(list_transform(c, lambda a: a.credit_name || coalesce(a.join_text, '')), '')) as artist, list_sort(isrcs)[1] as isrc, release_mbid from r where len(c) > 0""",
    "j17_covered": """with c as (select candidate_id, unnest(list_distinct(string_split(title, ''))) as ch from candidate where title is not null), f as (select * from (values ('latin', 32, 383), ('greek', 32, 126), ('greek', 880, 1023), ('cyrillic', 32, 126), ('cyrillic', 1024, 1279)) v(font, low, high)),
        n as (select candidate_id, count(*) as need from c where ch <> '' group by 1), h as (select candidate_id, font, count(distinct ch) as have from c join f on unicode(ch) between low and high where ch <> '' group by 1, 2)
        select candidate_id as text_id, font from h join n using (candidate_id) where have = need""",
    "j18_not_ready": "with d as (select o_orderkey as k from orders where o_orderstatus = 'F'), t as (select o_orderkey as task_id, unnest([o_orderkey - 1, o_orderkey + 1]) as dep from orders) select distinct task_id from t where dep not in (select k from d)",
    "x17_cycles": """with recursive e as (select p_partkey as s, (p_partkey * length(p_name) + 1) % 199 + 1 as t from part),
        walk as (select s as origin, t as node from e union select origin, e.t from walk join e on walk.node = e.s) select distinct origin as p_partkey from walk where origin = node""",
    "k_stream_rollup": "select cast(ts as date) as day, event_type, count(*) as events, round(sum(value), 4) as value_sum from events group by 1, 2",
    "k_stream_once": "select distinct event_id, event_type from events",
    "f12_routed": f"select event_id, event_type, {_ENV} as env from events where event_type in ('purchase', 'click') and {_ENV} = 'prod'",
    "s21_number_map": "select event_id, cast(json_extract(props, '$.k') as double) as k, cast(len(json_keys(props)) as int) as n from events",
    "s22_sharded": f"with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') as ls from documents where text is not null) select doc_id, cast(len(ls) as int) as n_lines, coalesce(ls[1], '') as first_line from l",
}
