"""Queries of the single steps: text, affixes, grounding, joins, sequences, sets and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanline.functions import noise
from gleanline.functions import normalize as N
from gleanline.functions import score as S
from gleanline.functions import text as T
from gleanline.operators import asof, catalog, extract, items, match, parse, quality, rollup
from gleanline.operators import lines as L
from gleanline.operators import tables as TB
from gleanline.plans.sql import fold
from gleanline.session import cut, table
from gleanline.sources import stores


def _list(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "list_line")


# Text and keys.


def n2_strip(spark: SparkSession, folder: str) -> DataFrame:
    return _list(spark, folder).select("line_id", T.strip(F.col("title")).alias("title"), T.strip(F.col("artist")).alias("artist"))


def _document(docs: DataFrame) -> DataFrame:
    text = N.normalize_document(F.col("text"))
    return docs.select("doc_id", F.char_length("text").alias("raw_length"), F.sha2(text, 256).alias("digest"), T.strip(text).alias("text"))


def n3_document(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in its normal form; empty ones too, null ones have none."""
    return _document(table(spark, folder, "documents").where("text is not null"))


def n10_credits(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "seed_row").select("row_id", T.credits(F.col("artist")).alias("c"))
    return rows.select("row_id", F.col("c.primary").alias("primary_name"), F.array_join("c.featured", ";").alias("featured"))


def n11_marked_titles(spark: SparkSession, folder: str) -> DataFrame:
    peeled = N.peel_title(F.col("title"))
    marked = (F.size(peeled["qualifiers"]) > 0) | (F.size(peeled["featured"]) > 0) | peeled["version_label"].isNotNull()
    return table(spark, folder, "candidate").select("candidate_id", (marked & (peeled["base"] != "")).alias("marked"))


def _strip_chars(rows: DataFrame) -> DataFrame:
    return rows.select("line_id", T.strip_chars(F.col("artist"), " -;.*").alias("artist"))


def n15_strip_chars(spark: SparkSession, folder: str) -> DataFrame:
    return _strip_chars(_list(spark, folder))


def n16_sha256(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", F.sha2("p_name", 256).alias("digest"))


def n17_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.select("doc_id", T.slice_span(F.col("text"), F.lit(3), F.lit(11)).alias("cut"), T.within(F.col("text"), F.lit(500)).alias("fits"))


def n18_merged_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Hints of consecutive lines of a list merged, the earlier line's first."""
    rows = _list(spark, folder).select("list_id", "line_no", F.col("hints").alias("h"))
    later = rows.select("list_id", (F.col("line_no") - 1).alias("line_no"), F.col("h").alias("g"))
    merged = T.merge_structs(F.col("h"), F.col("g"), ["album", "isrc", "release_year", "list_pos"], ["featured_artists", "qualifiers"])
    out = rows.join(later, ["list_id", "line_no"]).select("list_id", "line_no", merged.alias("m"))
    return out.select("list_id", "line_no", "m.album", "m.isrc", "m.release_year", "m.list_pos", F.array_join("m.featured_artists", ";").alias("featured"), F.array_join(F.array_sort("m.qualifiers"), ",").alias("qualifiers"))


def n20_canonical_json(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select("n_nationkey", stores.canonical_json("n_regionkey", "n_name").alias("json"))


def n29_share_pct(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.floor(F.col("l_discount") * 50).cast("double").alias("a"))
    return rows.select("l_orderkey", "l_linenumber", F.round(S.share_pct(F.col("q"), F.col("a")), 6).alias("pct"))


def n31_in_basis(spark: SparkSession, folder: str) -> DataFrame:
    basis = F.element_at(F.array(F.lit("monthly"), F.lit("per_day"), F.lit("per_second")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, folder, "orders").select("o_orderkey", F.round(rollup.in_basis(F.col("o_totalprice").cast("double"), basis), 6).alias("rate"))


def n35_field_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Which ids, tokens and type names of the catalog keep to their form."""
    rows = table(spark, folder, "seed_row")
    uuid, token, dotted = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^\S{1,128}$", r"^[a-z_]+(\.[a-z_]+)*$"
    return rows.select("row_id", F.col("recording_mbid").rlike(uuid).alias("id_ok"), F.col("artist").rlike(token).alias("token_ok"), F.col("feed").rlike(dotted).alias("type_ok"))


def n33_large_events(spark: SparkSession, folder: str) -> DataFrame:
    size = F.octet_length(F.to_json(F.struct("event_id", "event_type", "props")))
    return table(spark, folder, "events").select("event_id", (size <= 60).alias("small"))


# Affixes and parsers, one at a time.


def a1_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered lines made from part names, and the numbers taken off again."""
    rows = table(spark, folder, "part").select("p_partkey", F.concat_ws("", (F.col("p_partkey") % 999 + 1).cast("string"), F.lit(". ["), F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0"), F.lit(":30] "), "p_name").alias("line"))
    return rows.select("p_partkey", parse.strip_prefixes(F.col("line")).alias("p")).select("p_partkey", "p.rest", "p.position", "p.timestamp_s")


def a2_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths and codes put after part names, and taken off again."""
    code = F.concat(F.lit("QZA12"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))
    rows = table(spark, folder, "part").select("p_partkey", F.concat_ws("", "p_name", F.lit(" (3:"), F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0"), F.lit(") ["), code, F.lit("]")).alias("line"))
    return rows.select("p_partkey", parse.strip_suffixes(F.col("line")).alias("s")).select("p_partkey", "s.rest", "s.duration_s", "s.isrc")


def a9_truth_first(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of five styles written from parts, parsed back to what they were written from."""
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", F.regexp_replace("p_brand", "#", " ").alias("brand"))
    style = F.col("doc_id") % 5
    line = (
        F.when(style == 0, F.concat_ws(" - ", "brand", "p_name")).when(style == 1, F.concat(F.lit('"'), "p_name", F.lit('" by '), "brand")).when(style == 2, F.concat_ws(" by ", "p_name", "brand"))
        .when(style == 3, F.concat_ws("\t", "brand", "p_name")).otherwise(F.concat(F.lit("7. "), "brand", F.lit(" – "), "p_name", F.lit(" (Live)")))
    )
    parsed = parse.parse_lines(L.triage(L.split_lines(rows.select("doc_id", line.alias("text")))))
    return parsed.select("doc_id", "strict.title", "strict.artist", "strict.parser", F.array_join("strict.qualifiers", ",").alias("qualifiers"))


def t1_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of quoted rows written from parts."""
    line = F.concat(F.lit('"'), "p_name", F.lit(', ""x""", '), "p_brand", F.lit(" ,"), F.col("p_size").cast("string"))
    rows = table(spark, folder, "part").select("p_partkey", TB.split_row(line, F.lit(",")).alias("c"))
    return rows.select("p_partkey", F.posexplode("c").alias("pos", "cell"))


def t2_header_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the header lines that the layouts name."""
    spec = table(spark, folder, "table_spec").where("header_row is not null").select("case_no", "delim", "header_row")
    head = table(spark, folder, "printed_case").join(spec, "case_no").select("case_no", TB.split_row(F.regexp_replace(F.element_at(F.split("text", "\n", -1), F.col("header_row") + 1), "\r", ""), F.col("delim")).alias("cells"))
    return head.select("case_no", F.explode(TB.header_fields(F.col("cells"))).alias("field", "at"))


# Grounding and scores.


def v1_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of a part's name found in the next part's."""
    rows = table(spark, folder, "part").select("p_partkey", "p_name")
    after = rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("source"))
    return rows.join(after, "p_partkey").select("p_partkey", extract.coverage(T.tokens(F.col("p_name")), T.tokens(F.col("source"))).alias("coverage"))


def _grounded(rows: DataFrame, fold: Callable[[Column], Column]) -> DataFrame:
    both = F.concat_ws(" ", "title", "artist")
    folded = rows.where("title is not null").select(
        "line_id", "title", "artist", fold(F.col("title")).alias("ftitle"), fold(F.col("artist")).alias("fartist"),
        fold(both.substr(F.lit(4), F.char_length(both))).alias("fspan"), F.lit(0).alias("span_start"), (F.col("line_no").cast("bigint") * 40).alias("span_end"), F.lit(2000).alias("n_chars"),
    )
    return extract.reject_reason(folded).select("line_id", "reason")


def v2_grounded(spark: SparkSession, folder: str) -> DataFrame:
    return _grounded(_list(spark, folder), N.fold)


def k7_match_score(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("t"), (F.col("l_tax") * 12).alias("a"), (F.col("l_quantity") / 50).cast("double").alias("d"))
    score = S.match_score(F.col("t"), F.col("a"), F.col("d"), F.lit(1.0))
    return rows.select("l_orderkey", "l_linenumber", F.round(score, 9).alias("score"), S.verdict(F.round(score, 9), F.col("l_linenumber") == 1).alias("verdict"))


def _folded_artists(spark: SparkSession, folder: str, fold: Callable[[Column], Column]) -> DataFrame:
    return table(spark, folder, "match_input").select("input_id", fold(F.col("artist")).alias("a"), fold(F.col("alternate.title")).alias("b")).distinct()


def _artist_similarity(rows: DataFrame) -> DataFrame:
    return rows.select("input_id", F.round(S.artist_similarity(F.col("a"), F.col("b"), T.tokens(F.col("a")), T.tokens(F.col("b"))), 9).alias("similarity"))


def k4_artist_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return _artist_similarity(_folded_artists(spark, folder, N.fold))


# Joins.


def j2_cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Inputs with a recording code answered from a cache of the catalog's codes, as of a day; expired answers are none."""
    answers = table(spark, folder, "seed_row").select(T.isrc_key(F.col("isrc")).alias("cache_key"), F.col("row_id").alias("recording_id"), F.lit(1.0).alias("score"), F.lit("auto_accept").alias("verdict"), F.col("harvested_at").alias("made_at"))
    cache = match.cache_rows(answers)
    inputs = table(spark, folder, "match_input").select(F.col("input_id").alias("item_id"), T.isrc_key(F.col("isrc")).alias("cache_key")).distinct()
    return match.from_cache(inputs, cache, F.lit("2026-01-15 00:00:00").cast("timestamp")).select("item_id", "recording_id")


def j4_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Inputs by text against one provider's recordings, and against the others' where that one proposes nothing; lengths left out."""
    none = F.lit(None).cast("double")
    key = lambda rows: rows.withColumns({"ftitle": N.fold(F.col("title")), "fartist": N.fold(F.col("artist")), "duration_s": none})
    # Folded once: both sides serve several joins.
    inputs = cut(key(table(spark, folder, "match_input").select(F.col("input_id").alias("item_id"), "title", "artist", "qualifiers").distinct()))
    listed = cut(key(table(spark, folder, "candidate").select(F.col("candidate_id").alias("recording_id"), "provider", "title", "artist", "qualifiers", "popularity", F.col("candidate_id").alias("pos"))))
    first = F.col("provider") == "nimbus"
    return match.by_text(inputs, listed.where(first), listed.where(~first)).withColumn("score", F.round("score", 9))


def j6_nearest_before(spark: SparkSession, folder: str) -> DataFrame:
    """Each event with its user's last purchase value at or before it."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    bought = events.where("event_type = 'purchase'").select("user_id", "at", F.col("value").alias("last_value"))
    return asof.nearest_before(events.select("event_id", "user_id", "at"), bought, "user_id", "at", "last_value", 86400e6 * 5).select("event_id", F.round("last_value", 6).alias("last_value"))


def j7_alias_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Column names of the layouts by the fields that aliases give them."""
    names = table(spark, folder, "table_spec").select("case_no", F.explode("column_map").alias("label", "pos"))
    return names.join(F.broadcast(TB.alias_table(spark)), "label").select("case_no", "label", "field", "pos")  # a fixed table of thirty rows


def j12_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of a segment that have an open order."""
    open_orders = table(spark, folder, "orders").where("o_orderstatus = 'O'")
    customers = table(spark, folder, "customer")
    return customers.join(open_orders, customers["c_custkey"] == open_orders["o_custkey"], "left_semi").select("c_custkey", "c_name")


def _absorb(lines: DataFrame, fold: Callable[[Column], Column]) -> DataFrame:
    rows = lines.select("list_id", "line_id", fold(F.col("title")).alias("ftitle"), fold(F.col("artist")).alias("fartist")).where("ftitle <> ''")
    hosts = rows.where("fartist is not null").groupBy("list_id", "ftitle").agg(F.countDistinct("fartist").alias("n"), F.min("line_id").alias("host_id")).where("n = 1")
    return rows.where("fartist is null").join(hosts, ["list_id", "ftitle"]).select("line_id", "host_id")


def j14_absorb(spark: SparkSession, folder: str) -> DataFrame:
    return _absorb(_list(spark, folder), N.fold)


def j15_set_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Customers' nations: in orders only, in both, or without orders."""
    have = table(spark, folder, "customer").select("c_custkey").distinct()
    want = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    hit, miss, extra = want.join(have, "c_custkey", "left_semi"), want.join(have, "c_custkey", "left_anti"), have.join(want, "c_custkey", "left_anti")
    return hit.withColumn("kind", F.lit("hit")).unionByName(miss.withColumn("kind", F.lit("miss"))).unionByName(extra.withColumn("kind", F.lit("extra")))


# Items, views and reports.


def f10_review_queue(spark: SparkSession, folder: str) -> DataFrame:
    return items.below(_list(spark, folder)).select("line_id", "confidence")


def f11_alternates(spark: SparkSession, folder: str) -> DataFrame:
    """The swapped reading of tab lines, whose direction is unsure."""
    rows = items.with_alternates(_list(spark, folder), F.col("parser") == "tab")
    return rows.select("line_id", F.col("alternate.title").alias("alt_title"), F.col("alternate.artist").alias("alt_artist"))


def f16_needs_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Cases that have no line in the list of their number, or a line below the confidence floor."""
    lines = _list(spark, folder).select(F.col("list_id").alias("case_no"), "confidence")
    return items.needs_fallback(table(spark, folder, "printed_case"), lines, "case_no")


def f19_view(spark: SparkSession, folder: str) -> DataFrame:
    return items.view(_list(spark, folder)).select("line_id", "item_key", "shown")


def f9_residual_text(spark: SparkSession, folder: str) -> DataFrame:
    """Titles below the floor of each list, joined in order."""
    return items.joined_text(items.below(_list(spark, folder), items.FALLBACK), "list_id", "line_no", "title")


def g9_over_budget(spark: SparkSession, folder: str) -> DataFrame:
    return items.census(table(spark, folder, "events"), "event_type", 100)


def g20_tally(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "seed_row").where("not isnan(coalesce(duration_ms, 0))")
    return rows.groupBy("feed").agg(F.count("*").alias("n"), F.count_if(F.array_contains("tags", "live")).alias("live"), F.max(F.abs("duration_ms")).alias("longest"), F.min("row_id").alias("first_row"))


def g22_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def s17_report_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A report written as Markdown and read back."""
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("engine"), F.col("l_linestatus").alias("class")).agg(F.round(F.avg("l_discount"), 2).alias("a"), F.round(F.avg("l_quantity"), 2).cast("double").alias("b"))
    read = stores.report_rows(stores.report_table(rows, ["engine", "class", "a", "b"]), 4)
    return read.select("engine", "class", F.element_at("numbers", 1).alias("a"), F.element_at("numbers", 2).alias("b"))


# Sequences.


def w9_alarm_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    """The purchases of a user beyond the tenth."""
    return items.beyond(table(spark, folder, "events").where("event_type = 'purchase'"), "user_id", ["ts", "event_id"], 10).select("event_id", "nth")


def w10_first_match(spark: SparkSession, folder: str) -> DataFrame:
    """The first attributed line of each list; lines before it are its head."""
    return items.first_where(_list(spark, folder), "list_id", "line_no", F.col("artist").isNotNull()).withColumnRenamed("first", "first_line")


# Sets and order.


def l4_binds_first(spark: SparkSession, folder: str) -> DataFrame:
    """The nation with most customers, the first by name on ties."""
    count = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return count.orderBy(F.desc("n"), "n_name").limit(1).select("n_name", "n")


def o1_array_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Union, intersection and difference of two lines' qualifiers."""
    none = F.array().cast("array<string>")
    rows = _list(spark, folder).select("line_id", F.coalesce("hints.qualifiers", none).alias("a"))
    after = rows.select((F.col("line_id") - 1).alias("line_id"), F.col("a").alias("b"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return rows.join(after, "line_id").select("line_id", text(F.array_union("a", "b")).alias("u"), text(F.array_intersect("a", "b")).alias("i"), text(F.array_except("a", "b")).alias("e"))


def o5_corpora(spark: SparkSession, folder: str) -> DataFrame:
    """Expected pairs of both tiers as one table."""
    rows = table(spark, folder, "printed_case").select("case_no", "tier", F.explode("expected").alias("x"))
    clean, noisy = (rows.where(F.col("tier") == t).select("case_no", "x.title", "x.artist") for t in ("clean", "noisy"))
    return clean.unionByName(noisy)


def x2_cache_expiry(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a cache of inputs' answers: the newest answer of each key, and until when it lives."""
    keys = N.fold(F.col("title")), N.fold(F.col("artist"))
    answers = table(spark, folder, "match_input").select(
        F.coalesce(T.isrc_key(F.col("isrc")), T.text_key(*keys)).alias("cache_key"), F.col("input_id").alias("recording_id"), F.lit(1.0).alias("score"), F.lit("review").alias("verdict"), F.col("submitted_at").alias("made_at")
    )
    return match.cache_rows(answers).select("cache_key", "recording_id", F.unix_micros("expires_at").alias("expires_us"))


def x8_error_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Events as call results: what may be tried again, and what only later."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("quotaExceeded", "rateLimited", "notFound", "backendError")]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, folder, "events").select("event_id", kind.alias("reason"))
    return rows.select("event_id", "reason", F.col("reason").isin("rateLimited", "backendError").alias("retryable"), (F.col("reason") == "quotaExceeded").alias("deferrable"))


def x9_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches that each list needs by the size a provider allows."""
    sizes = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(n).alias("size")) for p, n in (("one", 1), ("ten", 10), ("hundred", 100))])
    count = _list(spark, folder).groupBy("list_id").agg(F.count("*").alias("n"))
    return count.select("list_id", "n", F.inline(sizes)).select("list_id", "provider", F.ceil(F.col("n") / F.col("size")).alias("batches"))


def x14_noise(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog titles in other dress, each kind a row."""
    title = F.col("title")
    kinds = [noise.recase(title, "upper"), noise.recase(title, "turns"), noise.emoji(title), noise.zero_width(title, rate=0.1), noise.full_width(title), noise.typos(title, rate=0.1), noise.ragged(title)]
    return table(spark, folder, "seed_row").where("title is not null").select("row_id", F.posexplode(F.array(*kinds)).alias("kind", "dressed"))


def f17_autonomous(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as match results: sure ones accepted, tab lines unresolved."""
    rows = _list(spark, folder).select("line_id", F.when(F.col("confidence") >= S.REVIEW, "auto_accept").otherwise("review").alias("verdict"), F.when(F.col("parser") == "tab", "unresolved").otherwise("resolved").alias("outcome"))
    return items.autonomous(rows).select("line_id", "autonomous")


def f20_wire(spark: SparkSession, folder: str) -> DataFrame:
    """Lines in wire form."""
    rows = _list(spark, folder).select("line_id", "title", "artist", "parser", F.col("hints.qualifiers").alias("qualifiers"))
    return items.wire(rows, ["title", "artist", "parser", "qualifiers"], ["qualifiers"]).select("line_id", "wire")


def x4_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The batch of two hundred that each line of a list goes with."""
    return items.batches(_list(spark, folder), "list_id", "line_no").select("line_id", "batch")


def n30_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Discounts and taxes as shares of a gate."""
    rows = table(spark, folder, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", S.mark(F.col("l_discount") * 1000, F.lit(90.0), F.col("l_tax") > 0).alias("mark"), S.shown_number(F.col("l_extendedprice")).alias("shown"))


def n35_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the catalog that break their contract."""
    rules = {"recording_mbid": (F.col("recording_mbid"), "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "isrc": (F.col("isrc"), "^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$"), "release_date": (F.col("release_date"), "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "feed": (F.col("feed"), "^[a-z]+$")}
    return quality.field_breaks(table(spark, folder, "seed_row"), "row_id", rules)


def n36_unicode(spark: SparkSession, folder: str) -> DataFrame:
    """What the engine knows of Unicode: a row for each check."""
    checks = T.unicode_checks()
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(name).alias("name"), holds.alias("holds")) for name, holds in checks])))


def s14_metric_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Values by type over January, with a metric that has no points."""
    events = table(spark, folder, "events").select(F.col("event_type").alias("metric"), F.col("ts").alias("at"), "value")
    metrics = events.select("metric").unionByName(spark.createDataFrame([("never",)], "metric string"))
    sums = rollup.metric_sums(events, metrics, F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp"))
    return sums.select("metric", F.round("total", 4).alias("total"), "points")


def w3_spaced(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user as requests half an hour apart that start up to 9 minutes late."""
    rows = table(spark, folder, "events").select("event_id", F.col("event_id").alias("request_id"), F.col("user_id").alias("caller"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("arrival_s"), (F.col("event_id") % 10 * 60.0).alias("overshoot_s"))
    return rollup.spaced(rows, 1800.0).select("event_id", F.round("start_s", 3).alias("start_s"))


def l6_report(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten lines of each list, for a report."""
    return items.first_of(_list(spark, folder), "list_id", ["line_no"], 10).select("line_id", "nth")


def l8_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Five lines of each list drawn by digest."""
    return items.sampled(_list(spark, folder), "list_id", "line_id", 5).select("line_id", "nth")


def f15_truth(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "printed_case").select("case_no", items.truth_of(F.col("expected")).alias("t"))
    return rows.select("case_no", F.size("t").alias("n"), F.array_join(F.transform("t", lambda x: x["title"]), "|").alias("titles"))


def g17_images(spark: SparkSession, folder: str) -> DataFrame:
    """Cases as images: their lines read without the first, their items without the last."""
    cases = table(spark, folder, "printed_case").select(F.col("case_no").alias("image_id"), F.split("text", "\n", -1).alias("lines"), F.col("expected").alias("items"))
    n, m = F.size("lines"), F.size("items")
    readings = cases.select("image_id", F.slice("lines", 2, F.greatest(n - 1, F.lit(0))).alias("lines"), F.slice("items", 1, F.greatest(m - 1, F.lit(0))).alias("items"), F.lit(0.5).alias("least"))
    scores = quality.score_images(cases, stores.paired_readings(cases, readings))
    return scores.select("image_id", (F.col("cer") == 0).alias("exact"), *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "empty", "fallback")


def x18_due(spark: SparkSession, folder: str) -> DataFrame:
    """Orders due within a week of a day."""
    return table(spark, folder, "orders").where("cast(o_orderdate as date) between date'1995-03-01' and date'1995-03-07'").select("o_orderkey")


def f13_seed_worthy(spark: SparkSession, folder: str) -> DataFrame:
    """Releases as typed by their rows' tags, kept if they are albums."""
    group = F.struct(F.when(F.col("row_id") % 3 == 0, "Single").otherwise("Album").alias("primary-type"), F.when(F.array_contains("tags", "live"), F.array(F.lit("Live"))).when(F.col("row_id") % 7 == 0, F.array(F.lit("Compilation"))).alias("secondary-types"))
    return catalog.seed_worthy(table(spark, folder, "seed_row").withColumn("release-group", group)).select("row_id")


QUERIES = {
    f.__name__: f
    for f in (
        n2_strip, n3_document, n10_credits, n11_marked_titles, n15_strip_chars, n16_sha256, n17_spans, n18_merged_hints, n20_canonical_json, n29_share_pct, n31_in_basis, n33_large_events, n35_field_checks,
        a1_prefixes, a2_suffixes, a9_truth_first, t1_cells, t2_header_fields, v1_coverage, v2_grounded, k4_artist_similarity, k7_match_score, j2_cache_lookup, j4_fallback, j6_nearest_before, j7_alias_lookup,
        j12_semi, j14_absorb, j15_set_difference, f9_residual_text, f10_review_queue, f11_alternates, f13_seed_worthy, f16_needs_fallback, f19_view, g9_over_budget, g20_tally, g22_status_counts, s17_report_rows,
        w9_alarm_ordinals, w10_first_match, l4_binds_first, o1_array_sets, o5_corpora, x2_cache_expiry, n30_marks, n35_breaks, n36_unicode, s14_metric_sums, w3_spaced, l6_report, l8_sample, f15_truth, g17_images, f17_autonomous, f20_wire, x4_batches, x8_error_kinds, x9_batches, x14_noise, x18_due,
    )
}

_SPACES = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{_SPACES}]+', ''), '[{_SPACES}]+$', '')"


_FLAT = r"trim(regexp_replace(array_to_string({0}, ' '), '[\x09-\x0d\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
_IMAGES = f"""with c as (select case_no as image_id, string_split(text, chr(10)) as l, list_transform(expected, lambda x: lower(trim(x.title)) || '|' || lower(trim(coalesce(x.artist, '')))) as e from printed_case),
    r as (select image_id, {_FLAT.format('l')} as a, {_FLAT.format('l[2:]')} as b, list_distinct(e) as w, list_distinct(e[1:len(e) - 1]) as g from c), s as (select *, len(list_intersect(w, g)) as tp from r),
    p as (select *, case when len(g) > 0 then tp / len(g) else 1.0 end as pr, case when len(w) > 0 then tp / len(w) else 1.0 end as rc from s)
    select image_id, a = b as exact, round(pr, 9)::double as precision, round(rc, 9)::double as recall, round(case when tp > 0 then 2 * pr * rc / (pr + rc) else 0 end, 9)::double as f1, a <> '' and b = '' as empty, true as fallback from p"""


_TOKENS = "list_distinct(list_filter(string_split({0}, ' '), lambda x: x <> ''))"
_SHARED = "case when len({0}) = 0 and len({1}) = 0 then 1.0 when len({0}) = 0 or len({1}) = 0 then 0.0 else len(list_intersect({0}, {1})) / least(len({0}), len({1})) end"
_MISSING = "len(list_filter(list_distinct({0}), lambda x: not list_contains({1}, x)))"


def _side(key: str, kind: str, popularity: str, name: str) -> str:
    return f"coalesce(qualifiers, []) as q from (select distinct {key} as id, {kind} as kind, title, artist, qualifiers, {popularity} as pop, {fold('title')} as t, {fold('artist')} as a from {name})"


_MEET = f"""select i.id as item_id, c.id as recording_id, c.pop, case when len(i.tt) > 0 and len(list_intersect(i.tt, c.tt)) > 0 then 1 else 0 end as shares, {_MISSING.format('c.q', 'i.q')} > 0 as unwanted,
    {S.WEIGHTS['title']} * ({_SHARED.format('i.tt', 'c.tt')}) + {S.WEIGHTS['artist']} * (case when i.a is null or c.a is null then 0.5 when i.a = c.a then 1.0 else {_SHARED.format('i.at', 'c.at')} end)
    + {S.WEIGHTS['length']} * 0.5 + {S.WEIGHTS['qualifiers']} * greatest(0.0, 1 - 0.25 * {_MISSING.format('i.q', 'c.q')} - 0.5 * {_MISSING.format('c.q', 'i.q')}) as s from i, c where i.t is not null and c.t is not null"""
_PICK = "select item_id, recording_id, s, unwanted from {0} qualify row_number() over (partition by item_id order by round(s, 6) desc, coalesce(pop, 0) desc, recording_id) = 1"
_FALLBACK = f"""with i as (select id, t, a, {_TOKENS.format('t')} as tt, coalesce({_TOKENS.format('a')}, []) as at, {_side('input_id', "'x'", '0.0', 'match_input')}),
    k as (select id, kind, pop, t, a, {_TOKENS.format('t')} as tt, coalesce({_TOKENS.format('a')}, []) as at, {_side('candidate_id', 'provider', 'popularity', 'candidate')}),
    p as (select * from ({_MEET.replace(' from i, c ', " from i, (select * from k where kind = 'nimbus') c ")}) where shares = 1 or s >= {S.NOT_FOUND} - 1e-9),
    f as (select * from ({_MEET.replace(' from i, c ', " from (select * from i where id not in (select item_id from p)) i, (select * from k where kind <> 'nimbus') c ")}) where shares = 1 or s >= {S.NOT_FOUND} - 1e-9),
    b as (select *, 'text' as source from ({_PICK.format('p')}) union all select *, 'fallback' from ({_PICK.format('f')}))
    select item_id, recording_id, round(s, 9)::double as score, case when s >= {S.REVIEW} - 1e-12 and not unwanted then 'auto_accept' when s >= {S.NOT_FOUND} - 1e-12 then 'review' else 'not_found' end as verdict, source from b"""


def _draw(seed: str, at: str) -> str:
    return f"(cast('0x' || substr(md5('{seed}|' || title || '|' || ({at})), 1, 6) as int) / 16777216.0)"


def _pick(values: list[str], seed: str, at: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][cast(floor({_draw(seed, at)} * {len(values)}) as int) + 1]"


def _per_character(change: str) -> str:
    """SQL of the characters of a title, each changed; ``c`` is the character and ``i`` its place from zero."""
    return f"coalesce((select string_agg({change}, '' order by i) from (select title, unnest(range(length(title))) as i, unnest(string_split(title, '')) as c)), '')"


_SWAPS = lambda i: f"({i} >= 0 and {_draw('typo', i)} < 0.1 and floor({_draw('typo-kind', i)} * 4) = 2 and {i} + 1 < length(title))"
_TURNED = lambda i: f"({_SWAPS(i)} and not {_SWAPS(f'({i} - 1)')})"
_KEYED = f"translate(c, '{noise.KEYS + noise.KEYS.upper()}', '{noise.BESIDE + noise.BESIDE.upper()}')"
_TYPO = f"""case when {_TURNED('(i - 1)')} then '' when {_draw('typo', 'i')} < 0.1 then case floor({_draw('typo-kind', 'i')} * 4) when 0 then '' when 1 then c || c
    when 2 then case when {_TURNED('i')} then title[i + 2] || c else c end else {_KEYED} end else c end"""
_FULL = f"case when {_draw('wide', 'i')} < 0.4 and c between '!' and '~' then chr(ascii(c) + 65248) else c end"
_ZERO = f"case when {_draw('zero', 'i')} < 0.1 then {_pick(noise.ZERO_WIDTH, 'zero-which', 'i')} || c else c end"
_BLANKS = lambda side: f"case when {_draw(f'ragged-{side}', '0')} < 0.3 then repeat(' ', cast(floor({_draw(f'ragged-{side}-n', '0')} * 3) as int) + 1) else '' end"
_MARK = _pick(noise.EMOJI, "emoji-which", "0")
_FACED = f"case when {_draw('emoji', '0')} >= 0.5 then title when {_draw('emoji-where', '0')} < 0.7 then title || ' ' || {_MARK} else {_MARK} || ' ' || title end"
_DRESSES = ["replace(upper(title), 'ẞ', 'SS')", _per_character("case when i % 2 = 0 then replace(upper(c), 'ẞ', 'SS') else lower(c) end"), _FACED, _per_character(_ZERO), _per_character(_FULL), _per_character(_TYPO), f"{_BLANKS('left')} || title || {_BLANKS('right')}"]
_BLANK = lambda i, sql: f"case when trim(title) = '' then title else {sql} end" if i in (2, 6) else sql
_NOISY = " union all ".join(f"select row_id, {i} as kind, {_BLANK(i, sql)} as dressed from seed_row where title is not null" for i, sql in enumerate(_DRESSES))
_ISRC = r"case when regexp_full_match(upper(regexp_replace({0}, '[\s\-]+', '', 'g')), '[A-Z]{{2}}[A-Z0-9]{{3}}[0-9]{{7}}') then upper(regexp_replace({0}, '[\s\-]+', '', 'g')) end"
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in "abcdefghijklmnopqrstuvwxyz")
_ALIASES = ", ".join(f"('{label}', '{field}')" for field, labels in TB.ALIASES.items() for label in labels)

ORACLES = {
    "n2_strip": f"select line_id, {_strip('title')} as title, {_strip('artist')} as artist from list_line",
    "n15_strip_chars": f"select line_id, trim(artist, ' -;.*') as artist from list_line",
    "n16_sha256": "select p_partkey, sha256(p_name) as digest from part",
    "n17_spans": "select doc_id, substring(text, 4, 8) as cut, length(text) >= 500 as fits from documents where text is not null",
    "n20_canonical_json": "select n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' as json from nation",
    "n29_share_pct": "with r as (select l_orderkey, l_linenumber, l_quantity::double as q, floor(l_discount * 50)::double as a from lineitem) select l_orderkey, l_linenumber, round(case when a > 0 then 100.0 * q / a when q > 0 then 'inf'::double else 0 end, 6) as pct from r",
    "n31_in_basis": "select o_orderkey, round(o_totalprice::double / case o_orderkey % 3 when 0 then 1 when 1 then 30 else 2592000 end, 6) as rate from orders",
    "n33_large_events": "select event_id, octet_length(encode('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"' || coalesce(',\"props\":\"' || replace(props, '\"', '\\\"') || '\"', '') || '}')) <= 60 as small from events",
    "n35_field_checks": r"select row_id, regexp_full_match(recording_mbid, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') as id_ok, regexp_matches(artist, '^\S{1,128}$') as token_ok, regexp_matches(feed, '^[a-z_]+(\.[a-z_]+)*$') as type_ok from seed_row",
    "a1_prefixes": "select p_partkey, p_name as rest, cast(p_partkey % 999 + 1 as int) as position, cast((p_partkey % 60) * 60 + 30 as int) as timestamp_s from part",
    "a2_suffixes": "select p_partkey, p_name as rest, cast(180 + p_partkey % 60 as double) as duration_s, 'QZA12' || lpad(cast(p_partkey as varchar), 7, '0') as isrc from part",
    "a9_truth_first": "select p_partkey as doc_id, p_name as title, replace(p_brand, '#', ' ') as artist, case p_partkey % 5 when 1 then 'quoted' when 2 then 'by' when 3 then 'tab' else 'dash' end as parser, case p_partkey % 5 when 4 then 'live' else '' end as qualifiers from part",
    "t1_cells": "select p_partkey, 0 as pos, p_name || ', \"x\"' as cell from part union all select p_partkey, 1, p_brand from part union all select p_partkey, 2, cast(p_size as varchar) from part",
    "v1_coverage": "with t as (select a.p_partkey, string_split(a.p_name, ' ') as c, string_split(b.p_name, ' ') as s from part a join part b on b.p_partkey = a.p_partkey + 1) select p_partkey, cast(len(list_filter(c, lambda x: list_contains(s, x))) as double) / len(c) as coverage from t",
    "v2_grounded": f"""with r as (select line_id, title, artist, string_split({fold('title')}, ' ') as t, string_split({fold('artist')}, ' ') as a, string_split({fold("substring(concat_ws(' ', title, artist), 4)")}, ' ') as s, line_no * 40 as e, {fold('title')} as ft, {fold('artist')} as fa from list_line where title is not null),
        c as (select *, case when ft = '' then 1.0 else cast(len(list_filter(t, lambda x: list_contains(s, x))) as double) / len(t) end as tc, case when fa = '' then 1.0 else cast(len(list_filter(a, lambda x: list_contains(s, x))) as double) / len(a) end as ac from r)
        select line_id, case when trim(title) = '' then 'empty_title' when length(title) > 300 then 'title_too_long' when e > 2000 then 'span_out_of_range' when e > 400 then 'span_out_of_range' when tc < 0.7 then 'span_text_mismatch' when artist is not null and ac < 0.6 then 'span_text_mismatch' end as reason from c""",
    "k4_artist_similarity": f"""with r as (select distinct input_id, {fold('artist')} as a, {fold('alternate.title')} as b from match_input), t as (select *, list_distinct(string_split(a, ' ')) as x, list_distinct(string_split(b, ' ')) as y from r)
        select input_id, round(case when a is null or b is null then 0.5 when a = b then 1 else cast(len(list_intersect(x, y)) as double) / least(len(x), len(y)) end, 9) as similarity from t""",
    "k7_match_score": "with r as (select l_orderkey, l_linenumber, round(0.5 * (l_discount * 10) + 0.3 * (l_tax * 12) + 0.1 * (l_quantity / 50) + 0.1, 9) as s from lineitem) select l_orderkey, l_linenumber, s as score, case when s >= 0.8 and l_linenumber <> 1 then 'auto_accept' when s >= 0.5 then 'review' else 'not_found' end as verdict from r",
    "j2_cache_lookup": f"""with c as (select {_ISRC.format('isrc')} as code, row_id, harvested_at from seed_row), k as (select code, max_by(row_id, (harvested_at, row_id)) as recording_id, max(harvested_at) as made_at from c where code is not null group by 1),
        i as (select distinct input_id as item_id, {_ISRC.format('isrc')} as code from match_input) select item_id, recording_id from i join k using (code) where made_at + interval 30 day > timestamp '2026-01-15'""",
    "j4_fallback": _FALLBACK,
    "j6_nearest_before": "with e as (select event_id, user_id, epoch_us(ts) as at from events), p as (select user_id, epoch_us(ts) as at, max(value) as v from events where event_type = 'purchase' group by 1, 2) select event_id, round(p.v, 6) as last_value from e asof left join p on e.user_id = p.user_id and e.at >= p.at",
    "j7_alias_lookup": f"with a(label, field) as (values {_ALIASES}), n as (select case_no, unnest(map_keys(column_map)) as label, unnest(map_values(column_map)) as pos from table_spec) select case_no, label, field, pos from n join a using (label)",
    "j12_semi": "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'O')",
    "j14_absorb": f"""with r as (select list_id, line_id, {fold('title')} as t, {fold('artist')} as a from list_line), h as (select list_id, t, min(line_id) as host_id from r where a is not null group by 1, 2 having count(distinct a) = 1) select line_id, host_id from r join h using (list_id, t) where a is null and t <> ''""",
    "j15_set_difference": "select coalesce(c, o) as c_custkey, case when c is null then 'miss' when o is null then 'extra' else 'hit' end as kind from (select distinct c_custkey as c from customer) full join (select distinct o_custkey as o from orders) on c = o",
    "f9_residual_text": "select list_id, string_agg(title, chr(10) order by line_no, title) as residual from list_line where confidence < 0.6 and title is not null group by 1",
    "f10_review_queue": "select line_id, confidence from list_line where confidence < 0.8",
    "f11_alternates": "select line_id, case when parser = 'tab' and artist is not null then artist end as alt_title, case when parser = 'tab' and artist is not null then title end as alt_artist from list_line",
    "f13_seed_worthy": "select row_id from seed_row where row_id % 3 <> 0 and (coalesce(list_contains(tags, 'live'), false) or row_id % 7 <> 0)",
    "f16_needs_fallback": "select case_no, coalesce(min(confidence) < 0.6, true) as fallback from printed_case left join list_line on list_id = case_no group by 1",
    "f19_view": "select line_id, span.span_start || '-' || span.span_end as item_key, printf('%.2f', confidence) as shown from list_line where span is not null",
    "g9_over_budget": "select event_type, count(*) as n, greatest(0, count(*) - 100) as over from events group by 1",
    "g20_tally": "select feed, count(*) as n, count(*) filter (where list_contains(tags, 'live')) as live, max(abs(duration_ms)) as longest, min(row_id) as first_row from seed_row where not isnan(coalesce(duration_ms, 0)) group by 1",
    "g22_status_counts": "select o_orderstatus, count(*) as n from orders group by 1",
    "s17_report_rows": "select l_returnflag as engine, l_linestatus as class, round(avg(l_discount), 2) as a, round(avg(l_quantity), 2)::double as b from lineitem group by 1, 2",
    "w9_alarm_ordinals": "select event_id, cast(n as int) as nth from (select event_id, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type = 'purchase') where n > 10",
    "w10_first_match": "select list_id, min(line_no) filter (where artist is not null) as first_line, count(*) as n from list_line group by 1",
    "l4_binds_first": "select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1 order by 2 desc, 1 limit 1",
    "o1_array_sets": """with r as (select line_id, coalesce(hints.qualifiers, []) as a from list_line), j as (select x.line_id, x.a, y.a as b from r x join r y on y.line_id = x.line_id + 1)
        select line_id, coalesce(array_to_string(list_sort(list_distinct(list_concat(a, b))), ','), '') as u, coalesce(array_to_string(list_sort(list_intersect(list_distinct(a), b)), ','), '') as i, coalesce(array_to_string(list_sort(list_filter(list_distinct(a), lambda q: not list_contains(b, q))), ','), '') as e from j""",
    "o5_corpora": "select case_no, x.title, x.artist from (select case_no, unnest(expected) as x from printed_case where tier in ('clean', 'noisy'))",
    "x2_cache_expiry": f"""with k as (select coalesce('isrc#' || {_ISRC.format('isrc')}, 'q#' || sha256({fold('title')} || '|' || coalesce({fold('artist')}, ''))) as cache_key, input_id, submitted_at from match_input)
        select cache_key, max_by(input_id, (submitted_at, input_id)) as recording_id, epoch_us(max(submitted_at) + interval 30 day) as expires_us from k where cache_key is not null group by 1""",
    "x8_error_kinds": "select event_id, r as reason, r in ('rateLimited', 'backendError') as retryable, r = 'quotaExceeded' as deferrable from (select event_id, ['quotaExceeded', 'rateLimited', 'notFound', 'backendError'][event_id % 4 + 1] as r from events)",
    "f17_autonomous": "select line_id, coalesce(confidence >= 0.8 and parser is distinct from 'tab', false) as autonomous from list_line",
    "f20_wire": """select line_id, cast(to_json(struct_pack(artist := artist, parser := parser, qualifiers := list_sort(list_distinct(coalesce(hints.qualifiers, []))), title := title)) as varchar) as wire from list_line""",
    "x4_batches": "select line_id, cast(floor((row_number() over (partition by list_id order by line_no) - 1) / 200) as int) as batch from list_line",
    "n30_marks": """select l_orderkey, l_linenumber, case when l_tax <= 0 then '·' when l_discount * 1000 > 90 then 'FAIL' when l_discount * 1000 > 90 * (2.0 / 3.0) then 'watch' else 'ok' end as mark,
        case when l_extendedprice >= 1000 then format('{:,.0f}', round_even(l_extendedprice, 0)) else regexp_replace(printf('%.2f', l_extendedprice), '\\.00$', '') end as shown from lineitem""",
    "n35_breaks": """with r as (select row_id, unnest([{'f': 'recording_mbid', 'v': recording_mbid, 'p': '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$'}, {'f': 'isrc', 'v': isrc, 'p': '^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$'},
        {'f': 'release_date', 'v': release_date, 'p': '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'}, {'f': 'feed', 'v': feed, 'p': '^[a-z]+$'}]) as t from seed_row)
        select row_id, t.f as field, case when t.v is null then 'missing' else 'shape' end as reason from r where t.v is null or not regexp_matches(t.v, t.p)""",
    "n36_unicode": "select name, true as holds from (values " + ", ".join(f"('{name}')" for name, _ in (("a Greek capital is an upper-case letter", 1), ("Cyrillic is a letter", 1), ("an ideograph is a letter", 1), ("an Arabic-Indic digit is a number", 1), ("a separator is a control", 1), ("a hyphen is no letter", 1), ("looking behind works", 1), ("lengths count code points", 1))) + ") t(name)",
    "s14_metric_sums": """with m as (select distinct event_type as metric from events union all select 'never'), s as (select event_type as metric, round(sum(value), 4) as total, count(value) as points from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01' group by 1)
        select metric, total, coalesce(points, 0) as points from m left join s using (metric)""",
    "w3_spaced": """with recursive r as (select event_id, user_id, epoch_us(ts) / 1e6 as a, event_id % 10 * 60.0 as o, row_number() over (partition by user_id order by ts, event_id) as k from events),
        walk as (select event_id, user_id, k, cast(a + o as double) as s from r where k = 1 union all select r.event_id, r.user_id, r.k, cast(greatest(r.a, w.s + 1800.0) + r.o as double) from walk w join r on r.user_id = w.user_id and r.k = w.k + 1)
        select event_id, round(s, 3) as start_s from walk""",
    "l6_report": "select line_id, cast(row_number() over (partition by list_id order by line_no) as int) as nth from list_line qualify nth <= 10",
    "l8_sample": "select line_id, cast(row_number() over (partition by list_id order by md5('sample|' || line_id), line_id) as int) as nth from list_line qualify nth <= 5",
    "f15_truth": "select case_no, cast(len(t) as int) as n, array_to_string(list_transform(t, lambda x: x.title), '|') as titles from (select case_no, list_filter(expected, lambda x: x.title is not null and x.title <> '') as t from printed_case)",
    "g17_images": _IMAGES,
    "x9_batches": "select list_id, p as provider, cast(ceil(n / s) as bigint) as batches from (select list_id, count(*) as n from list_line group by 1), (values ('one', 1.0), ('ten', 10.0), ('hundred', 100.0)) v(p, s)",
    "x14_noise": _NOISY,
    "x18_due": "select o_orderkey from orders where cast(o_orderdate as date) between date '1995-03-01' and date '1995-03-07'",
}
