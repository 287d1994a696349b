"""A nested catalog flattened, its credits read, its rows picked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanline.functions import text as T
from gleanline.session import cut, merged

FEATURING = r"(?i)(?<![\p{L}\p{N}_])(?:feat\.?|featuring|with)(?![\p{L}\p{N}_])"
FEAT_JOIN = r"(?i)(?<![\p{L}\p{N}_])feat"
RELEASE = """id string, title string, date string, disambiguation string, `release-group` struct<`primary-type`: string, `secondary-types`: array<string>>,
media array<struct<tracks: array<struct<title: string, recording: struct<id: string, title: string, disambiguation: string, length: bigint, isrcs: array<string>,
`artist-credit`: array<struct<name: string, joinphrase: string, artist: struct<id: string, name: string>>>>>>>>"""


def credit_line(artists: Column, name: str = "credit_name", join: str = "join_text") -> Column:
    """Names and what joins them as one line; null for no credits."""
    return F.trim(F.array_join(F.transform(artists, lambda a: F.concat(F.coalesce(a[name], F.lit("")), F.coalesce(a[join], F.lit("")))), ""))


def _first_feature(artists: Column, join: str) -> Column:
    """Position of the first credit whose join text says featuring; 0 where none does."""
    return F.coalesce(F.array_position(F.transform(artists, lambda a: F.coalesce(a[join], F.lit("")).rlike(FEAT_JOIN)), True), F.lit(0)).cast("int")


def primary_artist(artists: Column, name: str = "credit_name", join: str = "join_text") -> Column:
    """The credit line up to the first "feat."."""
    at = _first_feature(artists, join)
    upto = F.when(at > 0, F.slice(artists, 1, F.greatest(at, F.lit(1)))).otherwise(artists)
    parts = F.transform(upto, lambda a, i: F.concat(F.coalesce(a[name], F.lit("")), F.when(i + 1 < F.size(upto), F.coalesce(a[join], F.lit(""))).otherwise(F.lit(""))))
    return F.trim(F.array_join(parts, ""))


def featured_artists(artists: Column, name: str = "credit_name", join: str = "join_text") -> Column:
    """The names after the first "feat."."""
    at = _first_feature(artists, join)
    none = F.array().cast("array<string>")
    return F.when(at > 0, F.transform(F.slice(artists, at + 1, F.greatest(F.size(artists) - at, F.lit(0))), lambda a: a[name])).otherwise(none)


def tags(artists: Column, title: Column, version: Column, artist: Column, secondary: Column, release_title: Column, note: Column, join: str = "join_text") -> Column:
    """live, remaster, feat and non_latin, each from structured fields only."""
    text = F.lower(F.concat_ws(" ", release_title, note, version))
    tests = {
        "live": F.coalesce(F.exists(secondary, lambda s: F.lower(s) == "live"), F.lit(False)),
        "remaster": F.contains(text, F.lit("remaster")),
        "feat": F.coalesce((F.size(artists) > 1) & F.exists(artists, lambda a: F.coalesce(a[join], F.lit("")).rlike(FEATURING)), F.lit(False)),
        "non_latin": F.coalesce(T.has_non_latin(title), F.lit(False)) | F.coalesce(T.has_non_latin(artist), F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def seed_worthy(releases: DataFrame) -> DataFrame:
    """Albums, live ones included, but no compilations and the like."""
    group = F.col("release-group")
    fits = (F.lower(group["primary-type"]) == "album") & F.forall(F.coalesce(group["secondary-types"], F.array().cast("array<string>")), lambda s: F.lower(s) == "live")
    return releases.where(F.coalesce(fits, F.lit(False)))


def flatten_releases(releases: DataFrame) -> DataFrame:
    """Recordings of nested releases, a row each; those without id, title or a usable credit are left out.

    The recording's title wins over the track's, and the code is the first in order.
    """
    tracks = releases.where("id is not null and title is not null").select("id", "title", "date", "disambiguation", F.col("release-group.secondary-types").alias("secondary"), F.explode("media").alias("medium"))
    tracks = tracks.select("*", F.explode("medium.tracks").alias("track")).select("*", F.col("track.recording").alias("rec")).where("rec.id is not null")
    credits = F.filter(
        F.transform(F.col("rec.artist-credit"), lambda c: F.struct(F.coalesce(c["name"], c["artist"]["name"]).alias("credit_name"), c["artist"]["id"].alias("mbid"), F.coalesce(c["joinphrase"], F.lit("")).alias("join_text"))),
        lambda c: c["credit_name"].isNotNull() & c["mbid"].isNotNull(),
    )
    rows = tracks.withColumns({"artists": credits, "name": F.coalesce("rec.title", "track.title")}).where((F.trim("name") != "") & (F.size("artists") > 0))
    isrcs = F.array_sort(F.coalesce("rec.isrcs", F.array().cast("array<string>")))
    version = F.coalesce("rec.disambiguation", F.lit(""))
    rows = rows.withColumns({"isrcs": isrcs, "version_note": version, "artist": credit_line(F.col("artists"))})
    return rows.select(
        F.col("rec.id").alias("recording_mbid"), F.col("name").alias("title"), "version_note", "artist", "artists", F.try_element_at("isrcs", F.lit(1)).alias("isrc"), "isrcs",
        F.col("rec.length").cast("double").alias("duration_ms"), F.col("id").alias("release_mbid"), F.col("title").alias("release_title"), F.col("date").alias("release_date"),
        tags(F.col("artists"), F.col("name"), F.col("version_note"), F.col("artist"), F.col("secondary"), F.col("title"), F.coalesce("disambiguation", F.lit(""))).alias("tags"),
    )


def first_by_id(rows: DataFrame, key: str = "recording_mbid", order: str = "row_id") -> DataFrame:
    """One row a recording: the first that has a code, else the first."""
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(F.col("isrc").isNull().alias("without"), F.col(order).alias("at"))).alias("best")).select(F.col("best.at").alias(order))
    return rows.join(best, order)


def usable_truth(rows: DataFrame, title: str = "title", artist: str = "artist") -> DataFrame:
    """Rows that a line of a list can show without doubt: short, with letters, without breaks, annotations or separators."""
    t, a = T.strip(F.col(title)), T.strip(F.col(artist))
    dash, inner = r"\s[-–—]\s*\S{1,20}\s*$", r"\s[-–—~|/•·]\s"
    fits = (
        (t != "") & (a != "") & (F.char_length(t) <= 90) & (F.char_length(a) <= 70) & t.rlike(r"\p{L}") & ~t.rlike(r"[\n\r\t]") & ~a.rlike(r"[\n\r\t]")
        & ~t.rlike(r"[(\[].{0,40}[)\]]\s*$") & ~t.rlike(dash) & ~t.rlike(inner) & ~a.rlike(inner) & ~t.rlike(r"(?i)\sby\s")
    )
    return rows.where(F.coalesce(fits, F.lit(False)))


def capped_harvest(rows: DataFrame, per_artist: int, plain: int, artist: str = "artist", order: str = "row_id") -> DataFrame:
    """At most ``per_artist`` rows an artist in order, of them at most ``plain`` without a code.

    Rows over the quota of plain ones free their place for later rows of the artist.
    """
    kind = Window.partitionBy(artist, F.col("isrc").isNull()).orderBy(order)
    ranked = rows.withColumn("kind_rank", F.row_number().over(kind)).where(F.col("isrc").isNotNull() | (F.col("kind_rank") <= plain))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(artist).orderBy(order))).where(F.col("rank") <= per_artist).drop("kind_rank", "rank")


def not_ready(tasks: DataFrame) -> DataFrame:
    """Tasks (``task_id, status, deps``) with a dependency that isn't done or isn't known."""
    done = tasks.where("status = 'done'").select(F.col("task_id").alias("dep"))
    return tasks.select("task_id", F.explode("deps").alias("dep")).join(done, "dep", "left_anti").select("task_id").distinct()


def covered_by(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """``text_id, font`` of each text that a font's code-point ranges cover wholly.

    ``texts(text_id, text)``, ``ranges(font, low, high)``.  Distinct characters meet the ranges through
    blocks of 256 code points, an equi join; the fonts of each character are what may be
    broadcast, never the texts: an outer join keeps to that side, and an inner one would be made of it by ``explode``.
    """
    chars = texts.where("text is not null").select("text_id", F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''").select("text_id", F.ascii("c").alias("cp"))
    need = chars.groupBy("text_id").agg(F.count("*").alias("need"))
    blocks = ranges.withColumn("block", F.explode(F.sequence(F.shiftright("low", 8), F.shiftright("high", 8))))
    wanted = chars.select("cp", F.shiftright("cp", 8).alias("block")).distinct()
    has = wanted.join(blocks, "block").where("cp between low and high").groupBy("cp").agg(F.collect_set("font").alias("fonts"))
    have = chars.join(has, "cp", "left").select("text_id", F.explode_outer("fonts").alias("font")).where("font is not null").groupBy("text_id", "font").agg(F.count("*").alias("have"))
    return have.join(merged(need), "text_id").where("have = need").select("text_id", "font")


def cyclic(edges: DataFrame, source: str = "task_id", target: str = "dep") -> DataFrame:
    """``node`` of the nodes on a cycle or between two cycles: what is left when sources and sinks are taken away again and again.

    ``edges`` are pairs of a node and one it depends on; nulls and repeated edges count for nothing, an edge to
    itself is a cycle.  Each round drops the edges whose source nothing leads to or whose target leads nowhere;
    it ends when a round drops none.
    """
    left = cut(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null").distinct())
    n = left.count()
    while n:
        live = left.join(left.select(F.col("t").alias("s")).distinct(), "s", "left_semi")
        live = live.join(live.select(F.col("s").alias("t")).distinct(), "t", "left_semi")
        left, before = cut(live.select("s", "t")), n
        n = left.count()
        if n == before:
            break
    return left.select(F.explode(F.array("s", "t")).alias("node")).distinct()
