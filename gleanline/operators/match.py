"""Items resolved against a catalog: cache, recording code, text search, fallback and alternate reading."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.functions import score as S
from gleanline.functions import text as T
from gleanline.functions.normalize import fold
from gleanline.session import cut

MARGIN = 0.10
CACHE_DAYS = 30


def _folded(rows: DataFrame, title: str, artist: str, prefix: str) -> DataFrame:
    return rows.withColumns({f"{prefix}title": fold(F.col(title)), f"{prefix}artist": fold(F.col(artist))})


ITEM_BLOCK, CATALOG_BLOCK = 262_144, 2_097_152  # rows of a block: what one task holds and searches
LONG = 200  # rows of a token from which those with no other token are left out first
NEAR = 1e-6  # scores further apart are never equal


def _tokens(texts: pa.ChunkedArray, known: pa.Array | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The dictionary of tokens, and rows and numbers of each row's different tokens, in order of row.

    Tokens beyond ``known`` have numbers after its own; an empty text has the empty token, a null none.
    """
    split = pc.split_pattern(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, " ")
    row, flat = pc.list_parent_indices(split).to_numpy().astype(np.int64), pc.list_flatten(split)
    coded = pc.dictionary_encode(flat)
    names, number = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    if known is not None:
        at = pc.fill_null(pc.index_in(names, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(known) + np.arange((at < 0).sum())
        number = at[number] if len(at) else number
    width = int(number.max()) + 1 if len(number) else 1
    both = np.sort(row * width + number, kind="stable")  # nearly in order already
    both = both[np.diff(both, prepend=-1) != 0]
    return names, both // width, both % width


class _Field:
    """Titles or artists of a block of the catalog: tokens of each row, rows of each token, rows of small token sets."""

    def __init__(self, texts: pa.ChunkedArray):
        n = len(texts)
        self.names, row, number = _tokens(texts)
        self.size = np.bincount(row, minlength=n).astype(np.int32)
        self.words = len(self.names)
        self.table = np.full((n, max(1, int(self.size.max(initial=0)))), self.words, dtype=np.int32)
        self.table[row, np.arange(len(row)) - np.repeat(np.cumsum(self.size) - self.size, self.size)] = number
        order = np.argsort(number, kind="stable")
        self.rows, self.starts = row[order].astype(np.int32), np.searchsorted(number[order], np.arange(self.words + 1))
        self.mark = np.zeros(self.words + 1, dtype=np.int8)
        self.wide: dict[int, np.ndarray] = {}  # of tokens in every fiftieth row and more, whether a row has it
        for token in np.flatnonzero(np.diff(self.starts) * 50 > n).tolist():
            self.wide[token] = np.zeros(n, dtype=bool)
            self.wide[token][self.having(token)] = True
        self.small: dict[int, np.ndarray] = {}  # by the one token, or by both
        few = np.flatnonzero((self.size == 1) | (self.size == 2))
        if len(few):
            pair = self.table[few, : min(2, self.table.shape[1])].astype(np.int64)
            key = np.where(self.size[few] == 1, -1 - pair[:, 0], pair[:, 0] * (self.words + 1) + pair[:, -1])
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            self.small = dict(zip(keys.tolist(), np.split(few[order], first[1:])))

    def having(self, token: int) -> np.ndarray:
        return self.rows[self.starts[token] : self.starts[token + 1]]

    def among(self, token: int, rows: np.ndarray, scratch: np.ndarray) -> np.ndarray:
        """Whether each row has the token; ``scratch`` is false for all rows, and is again afterwards."""
        if token in self.wide:
            return self.wide[token][rows]
        having = self.having(token)
        scratch[having] = True
        found = scratch[rows]
        scratch[having] = False
        return found

    def within(self, tokens: list[int]) -> list[np.ndarray]:
        """Rows whose one or two tokens are all among ``tokens``."""
        keys = [-1 - t for t in tokens] + [min(t, u) * (self.words + 1) + max(t, u) for i, t in enumerate(tokens) for u in tokens[:i]]
        return [self.small[k] for k in keys if k in self.small]

    def shared(self, tokens: list[int], rows: np.ndarray, scratch: np.ndarray) -> np.ndarray:
        """How many of ``tokens`` each row has."""
        if len(rows) > 5 * LONG:
            return sum((self.among(t, rows, scratch).astype(np.int32) for t in tokens), np.zeros(len(rows), dtype=np.int32))
        self.mark[tokens] = 1
        found = self.mark[self.table[rows]].sum(axis=1, dtype=np.int32)
        self.mark[tokens] = 0
        return found


def _most(left: int, size: int) -> float:
    """No row of three tokens or more, or with a token beyond the text's, is more alike to a text of ``size`` tokens by ``left`` of them."""
    return left / size if size < 3 or not left else (0.5, 2 / 3, 1.0)[min(left, 3) - 1]


def _first_best(score: np.ndarray, popularity: np.ndarray) -> int:
    """Where ``score.best_of`` ends over rows in order of ``pos``."""
    near = np.flatnonzero(score >= score.max() - 1e-6)  # lower ones never stay
    if np.ptp(score[near]) <= S.TIE:
        return near[np.argmax(popularity[near])]
    best = near[0]
    for i in near[1:]:
        gap = score[i] - score[best]
        if gap > S.TIE or (abs(gap) <= S.TIE and popularity[i] > popularity[best]):
            best = i
    return best


def _best_in_block(items: pa.Table, catalog: pa.Table) -> pa.Table:
    """Each item's best recording of a block of the catalog, by the scores of ``score_pairs``.

    An item's tokens are taken from the rarest on; a recording with none of those taken so far can't be better
    than the tokens that are left allow, and the search ends when that is less than the best found.  Recordings
    of one or two common tokens, which those alone make wholly alike, are looked up by the set.
    """
    kinds = pa.schema([pa.field("item_id", items.schema.field("item_id").type), pa.field("recording_id", catalog.schema.field("recording_id").type)])
    if not len(items) or not len(catalog):
        return kinds.empty_table()
    order = catalog.select(["pos", "recording_id"]).to_pandas().sort_values(["pos", "recording_id"], na_position="first").index.to_numpy()
    catalog = catalog.take(pa.array(order))
    w, title, artist = S.WEIGHTS, _Field(catalog["ftitle"]), _Field(catalog["fartist"])
    numbers = lambda column: column.to_pandas().to_numpy(dtype=float, na_value=np.nan)
    unknown, length, popularity = artist.size == 0, numbers(catalog["duration_s"]), np.nan_to_num(numbers(catalog["popularity"]))
    sets = catalog["kind"].combine_chunks().dictionary_encode()
    kind, offered, agreed = sets.indices.to_numpy(), [set(json.loads(k)) for k in sets.dictionary.to_pylist()], {}
    same = items.select(["ftitle", "fartist", "duration_s", "kind"]).to_pandas().groupby(["ftitle", "fartist", "duration_s", "kind"], dropna=False, sort=False).ngroup().to_numpy()
    _, first, same = np.unique(same, return_index=True, return_inverse=True)
    own = items.take(pa.array(first))
    tokens = []
    for field, name in ((title, "ftitle"), (artist, "fartist")):
        _, row, number = _tokens(own[name], field.names)
        tokens.append((number.tolist(), np.searchsorted(row, np.arange(len(own) + 1)).tolist()))
    silent = pc.is_null(own["fartist"]).to_pylist()
    found, scratch = np.full(len(own), -1), np.zeros(len(catalog), dtype=bool)

    for i, (seconds, wants) in enumerate(zip(numbers(own["duration_s"]).tolist(), own["kind"].to_pylist())):
        if wants not in agreed:
            wanted = set(json.loads(wants))
            agreed[wants] = np.array([max(0.0, 1 - 0.25 * len(wanted - k) - 0.5 * len(k - wanted)) for k in offered])
        agree, bare = agreed[wants], seconds != seconds
        every = [number[at[i] : at[i + 1]] for number, at in tokens]
        mine = [[t for t in ts if t < field.words] for ts, field in zip(every, (title, artist))]
        n_title, n_artist = len(every[0]), len(every[1])
        rest = w["length"] * (0.5 if bare else 1.0) + w["qualifiers"] * agree.max()
        terms = sorted((f.starts[t + 1] - f.starts[t], k, t) for k, f in enumerate((title, artist)) for t in mine[k])
        left, best, near = [set(mine[0]), set(mine[1])], -1.0, []

        def take(rows: np.ndarray) -> None:
            nonlocal best, near
            if not len(rows):
                return
            titles = title.shared(mine[0], rows, scratch)
            score = w["title"] * (titles / np.minimum(np.maximum(title.size[rows], 1), n_title))
            if silent[i]:
                score = score + w["artist"] * 0.5
            else:
                alike = artist.shared(mine[1], rows, scratch) / np.maximum(np.minimum(artist.size[rows], n_artist), 1)
                score = score + w["artist"] * np.where(unknown[rows], 0.5, alike)
            if bare:
                score = score + w["length"] * 0.5
            else:
                gap = np.abs(seconds - length[rows])
                score = score + w["length"] * np.where(np.isnan(gap), 0.5, np.clip(1 - (gap - 3.0) / 9.0, 0.0, 1.0))
            score = score + w["qualifiers"] * agree[kind[rows]]
            score[(titles == 0) & (score < S.NOT_FOUND - S.TIE)] = -1.0
            top = score.max()
            if top >= 0 and top >= best - NEAR:
                best = max(best, top)
                keep = score >= best - NEAR
                near.append((rows[keep], score[keep]))

        def holding(rows: np.ndarray, k: int) -> np.ndarray:
            """Which rows have a token that is left."""
            more = np.zeros(len(rows), dtype=bool)
            for t in left[k]:
                more |= (title, artist)[k].among(t, rows, scratch)
            return more

        def beyond(t: float, a: float) -> bool:
            """Nothing with these similarities is as good as the best, or a candidate."""
            floor = max(best, 0.0) if t > 0 else max(best, S.NOT_FOUND)
            return w["title"] * t + w["artist"] * a + rest < floor - NEAR

        for size, k, token in terms:
            t, a = _most(len(left[0]), n_title), 0.5 if silent[i] else max(0.5, _most(len(left[1]), max(n_artist, 1)))
            if beyond(t, a):
                break
            field, rows = (title, artist)[k], (title, artist)[k].having(token)
            left[k].remove(token)
            if size > LONG:  # with this token alone a row is seldom good enough, unless it is the whole of the row's
                more = holding(rows, 0) | holding(rows, 1)
                take(np.concatenate([rows[more], field.small.get(-1 - token, rows[:0])]))
                rows = rows[:0] if (beyond(_most(1, n_title), 0.5) if k == 0 else beyond(0.0, _most(1, n_artist))) else rows[~more]
            take(rows)
        t, whole = _most(len(left[0]), n_title), 1.0 if left[1] else 0.5
        if left[0] and not beyond(1.0, whole):
            for rows in title.within(list(left[0])):
                take(rows[holding(rows, 1)] if len(rows) > LONG and beyond(1.0, 0.5) else rows)
        if left[1] and not beyond(t, whole):
            for rows in artist.within(list(left[1])):
                take(rows[holding(rows, 0)] if len(rows) > LONG and beyond(0.0, 1.0) else rows)
        if near:
            rows, score = np.concatenate([r for r, _ in near]), np.concatenate([s for _, s in near])
            rows, at = np.unique(rows, return_index=True)
            found[i] = rows[_first_best(score[at], popularity[rows])]

    found = found[same]
    hit = np.flatnonzero(found >= 0)
    return pa.Table.from_arrays([items["item_id"].take(pa.array(hit)), catalog["recording_id"].take(pa.array(found[hit]))], schema=kinds)


def _apart(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers whose rows a shuffle by them puts into a partition each."""
    found, tried = {}, 0
    while len(found) < n:
        tried = 20 * (tried + n)
        rows = spark.range(tried).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id"))
        found = {r["at"]: r["id"] for r in rows.collect()}
    return [found[i] for i in range(n)]


def search(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pairs of each item and its best recording in every block of the catalog; the best of all is among them.

    ``items``: ``item_id, ftitle, fartist, duration_s, qualifiers``; ``catalog``: ``recording_id, ftitle,
    fartist, duration_s, qualifiers, popularity, pos``.  A recording is a candidate if it shares a title
    token, however common, or if its score is enough for 'review' without one.  Every block of items meets
    every block of the catalog, so no token needs to be rare; in a task, the search of an item ends when
    nothing that is left can be as good as what it has.  Of recordings that only differ in popularity and
    place, the one that wins ties is searched.
    """
    kind = F.to_json(F.array_sort(F.array_distinct(F.coalesce("qualifiers", F.array().cast("array<string>"))))).alias("kind")
    told = ["ftitle", "fartist", F.col("duration_s").cast("double").alias("duration_s"), kind]
    left = items.where("ftitle is not null").select("item_id", *told)
    right = catalog.where("ftitle is not null").select("recording_id", *told, F.coalesce(F.col("popularity").cast("double"), F.lit(0.0)).alias("popularity"), "pos")
    same = ["ftitle", "fartist", "duration_s", "kind"]
    right = cut(right.groupBy(*same).agg(F.min_by(F.struct("recording_id", "popularity", "pos"), F.struct(-F.col("popularity"), "pos", "recording_id")).alias("c")).select(*same, "c.*"))
    down = max(1, -(-right.count() // CATALOG_BLOCK))
    across = max(-(-left.count() // ITEM_BLOCK), -(-items.sparkSession.sparkContext.defaultParallelism // down))
    left = left.withColumns({"a": F.pmod(F.xxhash64(*same), F.lit(across)), "b": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(down - 1).cast("bigint")))})
    right = right.withColumns({"b": F.pmod(F.xxhash64("recording_id"), F.lit(down)), "a": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint")))})
    kinds = {f.name: f.dataType.simpleString() for f in [*items.schema, *catalog.schema]}
    # Each pair of blocks in a partition of its own: by the hash of both numbers some would hold several and others none.
    own = F.element_at(F.array(*map(F.lit, _apart(items.sparkSession, across * down))), (F.col("a") * down + F.col("b") + 1).cast("int"))
    blocks = [rows.withColumn("block", own).drop("a", "b").repartition(across * down, "block").groupBy("block") for rows in (left, right)]
    return blocks[0].cogroup(blocks[1]).applyInArrow(_best_in_block, f"item_id {kinds['item_id']}, recording_id {kinds['recording_id']}")


def score_pairs(pairs: DataFrame, items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pairs with the four similarities, ``score``, ``verdict`` and the recording's ``popularity`` and ``pos``."""
    none = F.array().cast("array<string>")
    left = items.select("item_id", F.col("ftitle").alias("q_title"), F.col("fartist").alias("q_artist"), F.col("duration_s").alias("q_length"), F.coalesce("qualifiers", none).alias("q_quals"))
    right = catalog.select("recording_id", F.col("ftitle").alias("c_title"), F.col("fartist").alias("c_artist"), F.col("duration_s").alias("c_length"), F.coalesce("qualifiers", none).alias("c_quals"), "popularity", "pos")
    rows = pairs.join(left, "item_id").join(right, "recording_id")
    tok = lambda c: F.coalesce(T.tokens(F.col(c)), none)
    rows = rows.withColumns({
        "title_sim": S.token_set_ratio(tok("q_title"), tok("c_title")),
        "artist_sim": S.artist_similarity(F.col("q_artist"), F.col("c_artist"), tok("q_artist"), tok("c_artist")),
        "length_sim": S.length_similarity(F.col("q_length"), F.col("c_length")),
        "qualifier_sim": S.qualifier_similarity(F.col("q_quals"), F.col("c_quals")),
        "unwanted": F.size(F.array_except("c_quals", "q_quals")) > 0,
    })
    score = S.match_score(F.col("title_sim"), F.col("artist_sim"), F.col("length_sim"), F.col("qualifier_sim"))
    return rows.withColumn("score", score).withColumn("verdict", S.verdict(F.col("score"), F.col("unwanted")))


def best_match(scored: DataFrame) -> DataFrame:
    """Each item's best recording, folded in order of ``pos`` (ties within an epsilon aren't transitive)."""
    ranked = F.collect_list(F.struct("pos", "score", "popularity", "recording_id", "verdict"))  # an item's candidates: its blocks, not the catalog
    return scored.groupBy("item_id").agg(S.best_of(ranked).alias("b")).select("item_id", "b.recording_id", "b.score", "b.verdict")


def by_isrc(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items whose recording code is in the catalog: the first recording by position, with full score."""
    codes = catalog.where("isrc is not null").groupBy("isrc").agg(F.min_by("recording_id", "pos").alias("recording_id"))
    return items.where("isrc is not null").join(codes, "isrc").select("item_id", "recording_id", F.lit(1.0).alias("score"), F.lit("auto_accept").alias("verdict"))


def by_text(items: DataFrame, primary: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Best text match of each item; the fallback catalog serves items for which the primary proposes nothing."""
    pairs = cut(search(items, primary))
    best = best_match(score_pairs(pairs, items, primary)).withColumn("source", F.lit("text"))
    if fallback is None:
        return best
    rest = items.join(pairs.select("item_id").distinct(), "item_id", "left_anti")
    other = best_match(score_pairs(search(rest, fallback), rest, fallback)).withColumn("source", F.lit("fallback"))
    return best.unionByName(other)


def cache_rows(answers: DataFrame, days: int = CACHE_DAYS) -> DataFrame:
    """``cache_key, recording_id, score, verdict, expires_at`` of answers (with ``made_at``): the newest of each key, living so many days.

    Keys hold no readable text; answers with any other key, or none, are not kept.
    """
    newest = F.max(F.struct("made_at", "recording_id", "score", "verdict")).alias("a")
    kept = answers.where(T.is_neutral_key(F.col("cache_key"))).groupBy("cache_key").agg(newest)
    return kept.select("cache_key", "a.recording_id", "a.score", "a.verdict", (F.col("a.made_at") + F.make_dt_interval(F.lit(days))).alias("expires_at"))


def from_cache(items: DataFrame, cache: DataFrame, now: Column | None = None) -> DataFrame:
    """``item_id, recording_id, score, verdict`` of items whose ``cache_key`` has a row that hasn't expired."""
    live = cache.where(F.col("expires_at") > (now if now is not None else F.current_timestamp())).select("cache_key", "recording_id", "score", "verdict")
    return items.select("item_id", "cache_key").join(live, "cache_key").select("item_id", "recording_id", "score", "verdict")


def resolve(items: DataFrame, catalog: DataFrame, cache: DataFrame | None = None, now: Column | None = None, fallback: DataFrame | None = None) -> DataFrame:
    """``item_id, recording_id, score, verdict, source, flipped, outcome`` of every item.

    ``items``: ``item_id, title, artist, isrc, duration_s, qualifiers, alternate``; ``catalog``:
    ``recording_id, title, artist, isrc, duration_s, qualifiers, popularity, pos``.  The first stage that
    answers wins: a cache row that hasn't expired, the recording code, the text.  An item with an alternate
    reading is searched both ways; one way must lead by a margin, else the better stays for review.
    Items without any candidate are 'not_found'; null titles have none.
    """
    # Both sides serve several joins; folded once, they are kept.
    known = cut(_folded(items.select("item_id", "title", "artist", "isrc", "duration_s", "qualifiers", "alternate"), "title", "artist", "f").withColumn("isrc", T.isrc(F.col("isrc"))))
    listed = cut(_folded(catalog, "title", "artist", "f").withColumn("isrc", T.isrc(F.col("isrc"))))
    spare = _folded(fallback, "title", "artist", "f").withColumn("isrc", T.isrc(F.col("isrc"))) if fallback is not None else None
    stages = []
    rest = known
    if cache is not None:
        key = F.coalesce(T.isrc_key(F.col("isrc")), T.text_key(F.col("ftitle"), F.col("fartist")))
        found = from_cache(rest.withColumn("cache_key", key), cache, now)
        hits = found.select("*", F.lit("cache").alias("source"), F.lit(False).alias("flipped"), F.lit("not_applicable").alias("outcome"))
        stages.append(hits)
        rest = rest.join(hits.select("item_id"), "item_id", "left_anti")
    coded = by_isrc(rest, listed).select("*", F.lit("isrc").alias("source"), F.lit(False).alias("flipped"), F.lit("not_applicable").alias("outcome"))
    stages.append(coded)
    rest = rest.join(coded.select("item_id"), "item_id", "left_anti")
    straight = by_text(rest, listed, spare)
    turned = rest.where("alternate is not null").withColumns({"title": F.col("alternate.title"), "artist": F.col("alternate.artist")})
    swapped = by_text(_folded(turned, "title", "artist", "f"), listed, spare)
    a = straight.select("item_id", F.struct("recording_id", "score", "verdict", "source").alias("a"))
    b = swapped.select("item_id", F.struct("recording_id", "score", "verdict", "source").alias("b"))
    both = rest.select("item_id", F.col("alternate").isNotNull().alias("two")).join(a, "item_id", "left").join(b, "item_id", "left")
    sa, sb = F.coalesce("a.score", F.lit(0.0)), F.coalesce("b.score", F.lit(0.0))
    outcome = F.when(~F.col("two"), "not_applicable").when(sb - sa >= MARGIN, "resolved").when(sa - sb >= MARGIN, "resolved").otherwise("unresolved")
    flip = F.col("two") & (sb - sa >= MARGIN)
    pick = F.when(flip, F.col("b")).otherwise(F.coalesce(F.when(sb > sa, F.col("b")), F.col("a"), F.col("b")))
    chosen = both.select("item_id", pick.alias("p"), flip.alias("flipped"), outcome.alias("outcome"))
    verdict = F.coalesce(F.when((F.col("outcome") == "unresolved") & (F.col("p.verdict") == "auto_accept"), "review").otherwise(F.col("p.verdict")), F.lit("not_found"))
    stages.append(chosen.select("item_id", "p.recording_id", F.coalesce("p.score", F.lit(0.0)).alias("score"), verdict.alias("verdict"), F.coalesce("p.source", F.lit("none")).alias("source"), "flipped", "outcome"))
    out = stages[0]
    for stage in stages[1:]:
        out = out.unionByName(stage)
    return out


def fingerprint(recording: Column, verdict: Column, outcome: Column) -> Column:
    """What a match decided, without its score."""
    return F.sha2(F.concat_ws("|", F.coalesce(recording.cast("string"), F.lit("-")), verdict, outcome), 256)


def rematch(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``item_id, outcome``: a new match against the stored one: unchanged, updated or still_unmatched.

    Only 'updated' rows need writing; items that were never stored are updated if they match now.
    """
    mark = lambda f: f.select("item_id", "recording_id", fingerprint(F.col("recording_id"), F.col("verdict"), F.col("outcome")).alias("mark"))
    old = mark(stored).withColumnsRenamed({"mark": "old_mark", "recording_id": "old_recording"})
    joined = mark(fresh).join(old, "item_id", "left")
    said = F.when(F.col("recording_id").isNull() & F.col("old_recording").isNull(), "still_unmatched").when(F.col("mark").eqNullSafe(F.col("old_mark")), "unchanged").otherwise("updated")
    return joined.select("item_id", said.alias("rematch"))
