"""Lines matched to a provider's recordings without a key: probabilistic record linkage.

Several blocking passes propose pairs; title, artist, length and version are compared at a few
agreement levels; expectation-maximisation over the counts of level patterns gives the probabilities
of levels among matches and non-matches, where non-matches are a mixture of other recordings of a song,
songs of one title and unrelated ones; a pair's confidence is its posterior among all pairs of its input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanline.llm.names import Lexicon, alike, distance, fold, learn
from gleanline.operators.units import resolve_lengths
from gleanline.session import cut

# Words that mark a version (a remaster and an album version are the studio version).
VERSIONS = {
    "live": ["live", "concert"], "remix": ["remix", "rmx"], "acoustic": ["acoustic", "unplugged", "akustik"], "demo": ["demo"],
    "extended": ["extended"], "instrumental": ["instrumental", "karaoke"], "edit": ["edit"], "cover": ["cover"],
}
STUDIO = ["remaster", "remastered", "album", "original", "mono", "stereo", "studio"]
NOISE = ["official", "video", "audio", "lyrics", "lyric", "hq", "hd", "visualizer", "full", "song"]
BUCKET_S = 8.0
#: Lengths further apart than this are seldom of one recording.
NEAR_S = 3.05
#: Titles more edits apart than this are not compared.
TITLE_EDITS = 4
LEVELS = {"title": 4, "artist": 3, "length": 5, "version": 4}
#: Where EM starts, levels from agreement to disagreement (a missing artist is 1, a missing length 4): matches, other
#: recordings of the same song, songs of the same title by others, and unrelated ones; with their shares.
START = {
    "title": [[0.85, 0.12, 0.025, 0.005], [0.85, 0.12, 0.025, 0.005], [0.9, 0.07, 0.02, 0.01], [0.05, 0.05, 0.3, 0.6]],
    "artist": [[0.92, 0.075, 0.005], [0.92, 0.075, 0.005], [0.02, 0.08, 0.9], [0.2, 0.1, 0.7]],
    "length": [[0.55, 0.12, 0.01, 0.005, 0.315], [0.03, 0.07, 0.15, 0.5, 0.25], [0.1, 0.2, 0.2, 0.3, 0.2], [0.05, 0.15, 0.2, 0.4, 0.2]],
    "version": [[0.98, 0.01, 0.005, 0.005], [0.02, 0.08, 0.6, 0.3], [0.6, 0.05, 0.25, 0.1], [0.6, 0.05, 0.25, 0.1]],
}
SHARES = [0.3, 0.2, 0.2, 0.3]


def _mark(text: str) -> tuple[str, str | None] | None:
    """What an annotation says: ('version', name), ('studio', None), ('noise', None) or ('guest', None); None for anything else."""
    words = re.findall(r"[^\W\d_]+", fold(text))
    if not words:
        return None
    if words[0] in ("feat", "ft", "featuring"):
        return "guest", None
    near = lambda w, v: w == v or len(v) > 5 and distance(w, v) <= (1 if len(v) < 8 else 2) or v == "demo" and len(w) == 4 and distance(w, v) == 1
    for name, marks in VERSIONS.items():
        if any(near(w, v) for w in (words if name != "live" else words[:1] + words[-1:]) for v in marks):
            return "version", name
    if any(near(w, v) for w in words for v in STUDIO):
        return "studio", None
    if all(w in NOISE for w in words):
        return "noise", None
    return None


#: Titles without any of these have no annotation.
_MARKED = re.compile(r"[()\[\]~|/–—]| -\S*\s|\s(?:feat|ft|featuring|hq|hd|lyrics)\b", re.I)


def title_parts(title: str | None) -> tuple[str, str, list[str]]:
    """A title's words without annotations, the name of its remix or place, and its versions."""
    text, versions, named = (title or "").strip(), [], ""
    while _MARKED.search(text):
        tail = re.search(r"\s*[(\[]([^()\[\]]*)[)\]]\s*$", text) or re.search(r"\s+[-–—~|/]\s+([^-–—~|/]+)$", text) or re.search(r"\s+((?:feat\.?|ft\.?|featuring)\s.*)$", text, re.I) or re.search(r"\s+(HQ|HD|lyrics)$", text, re.I)
        if not tail or not text[: tail.start()].strip():
            break
        mark = _mark(tail.group(1))
        if mark is None:
            break
        if mark[0] == "version":
            versions.append(mark[1])
            rest = [w for w in re.findall(r"[^\W_]+", fold(tail.group(1))) if w not in ("at", "the", "version", "mix") and w not in VERSIONS[mark[1]]]
            if mark[1] in ("live", "remix") and rest:
                named = " ".join(rest)
        text = text[: tail.start()]
    words = [{"part": "pt"}.get(w, w.replace("ph", "f")) for w in re.findall(r"[^\W_]+", fold(text)) if w != "and"]
    return " ".join(words), named, versions


_GUEST = r"(?i)\s*[(\[]?\b(?:feat\.?|ft\.?|featuring)\s"


def _credits(artist: Column) -> Column:
    """The names in an artist field, as far as its form tells: guests apart, and at commas where every part has two words or more."""
    sides = F.split(artist, _GUEST)
    apart = lambda side: F.when(F.forall(F.split(side, ", "), lambda p: F.trim(p).contains(" ")), F.split(side, ", ")).otherwise(F.array(side))
    return F.flatten(F.transform(sides, apart))


def _readings(artist: str | None, lexicon: Lexicon) -> list[str]:
    """What an artist field may name, the whole or the one before a guest, each as ``core|others|by``."""
    if not artist or not artist.strip():
        return []
    text = re.split(_GUEST, artist, maxsplit=1)[0].strip() or artist
    texts = [text, text.split(", ")[0]] if ", " in text else [text]
    out = []
    for i, reading in enumerate(texts):
        parts = lexicon.apart(reading)
        if parts and (i == 0 or len(re.findall(r"[^\W_]+", reading)) > 1):
            out.append(f"{parts[0]}|{','.join(parts[1])}|{'b' if parts[2] else ''}")
    return list(dict.fromkeys(out))


_SIDE = "id bigint, reading int, base string, tight string, named string, versions array<string>, artists array<string>, length_s double"


def prepare(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``id, reading, title, artist, qualifiers, length_s`` taken apart for comparison."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named_by = lru_cache(maxsize=1 << 15)(lambda artist: _readings(artist, lexicon))
        for batch in batches:
            out = []
            for key, reading, title, artist, qualifiers, length in batch.itertuples(index=False):
                base, named, versions = title_parts(title)
                for word in qualifiers if qualifiers is not None else []:
                    mark = _mark(word) if word else None
                    if mark and mark[0] == "version":
                        versions.append(mark[1])
                out.append((key, reading, base, base.replace(" ", ""), named, sorted(set(versions)), named_by(artist), length))
            yield pd.DataFrame(out, columns=["id", "reading", "base", "tight", "named", "versions", "artists", "length_s"])

    return rows.select("id", "reading", "title", "artist", "qualifiers", "length_s").mapInPandas(run, _SIDE)


def _keys(side: DataFrame, asking: bool) -> DataFrame:
    """The side with a row for each blocking key, a hash (a collision only proposes a pair more).

    A title is a key by its first and last letters, a multiple of three within the half, and by its two outer
    thirds, since one slip leaves the beginning or the end, and two in the middle the outer thirds; an asking
    title also tries the parts of a title one shorter or longer.  Parts of titles are common, so every key is
    refined: with the first or last letters of an artist's core, with the length bucket (asking rows try all
    within reach) where the asking row names no artist, and the whole title with the length bucket in any
    case.  An asking row with neither field uses the whole title refined by its versions, all that it has.
    """
    size, tight = F.length("tight"), F.col("tight")
    lengths = F.filter(F.array(size - 1, size, size + 1), lambda n: n >= 3) if asking else F.array(size)
    half = lambda n: F.ceil(n / 2).cast("int")
    sizes = F.array_distinct(F.transform(lengths, lambda n: F.when(half(n) < 3, half(n)).otherwise(half(n) - half(n) % 3)))
    heads = F.transform(sizes, lambda k: F.concat(F.lit("<"), F.left(tight, k)))
    tails = F.transform(sizes, lambda k: F.concat(F.lit(">"), F.right(tight, k)))
    rims = F.transform(F.array_distinct(F.transform(lengths, lambda n: F.ceil(n / 3).cast("int"))), lambda k: F.concat(F.lit("~"), F.left(tight, k), F.lit("~"), F.right(tight, k)))
    core = F.transform("artists", lambda a: F.element_at(F.split(a, r"\|"), 1))
    ends = F.array_distinct(F.flatten(F.transform(core, lambda c: F.array(F.concat(F.lit("^"), F.left(c, F.lit(4))), F.concat(F.lit("$"), F.right(c, F.lit(4)))))))
    bucket = lambda off: F.floor((F.col("length_s") + off) / BUCKET_S).cast("int")
    near = F.when(F.col("length_s").isNotNull(), F.array_distinct(F.array(bucket(-NEAR_S), bucket(NEAR_S))) if asking else F.array(bucket(0.0))).otherwise(F.array().cast("array<int>"))
    crossed = lambda left, right: F.flatten(F.transform(left, lambda p: F.transform(right, lambda o: F.xxhash64(p, o.cast("string")))))
    none = F.array().cast("array<bigint>")
    lonely = F.size("artists") == 0 if asking else F.lit(True)
    whole = F.array(F.concat(F.lit("="), tight))
    bare = F.array(F.concat(F.lit("?"), F.concat_ws(",", "versions")))
    keys = F.concat(
        crossed(F.concat(heads, tails), ends), crossed(rims, F.filter(ends, lambda e: e.startswith("^"))), crossed(whole, near),
        F.when(lonely, crossed(F.concat(heads, tails, rims), near)).otherwise(none),
        F.when(lonely & (F.col("length_s").isNull() if asking else F.lit(True)), crossed(whole, bare)).otherwise(none),
    )
    return side.where("tight <> ''").select("id", "reading", "tight", F.explode(F.array_distinct(keys)).alias("key"))


def same_artist(left: list[str], right: list[str], lexicon: Lexicon) -> bool:
    """Whether two artist fields name one: in some reading, cores alike and other words that agree, or a by-name in their place."""
    for a in left:
        core_a, others_a, by_a = a.split("|")
        for b in right:
            core_b, others_b, by_b = b.split("|")
            if not alike(core_a, core_b):
                continue
            x, y = (tuple(filter(None, o.split(","))) for o in (others_a, others_b))
            if by_a or by_b or lexicon.same_others(x, y):
                return True
            # Of several names in a field the first may stand alone.
            if (not x or not y) and core_a == core_b and len(left) + len(right) > 2:
                return True
    return False


def _title_level() -> Column:
    """0 the same letters, 1 one slip (a swap too), 2 two or three in a long title, 3 another title or other numbers."""
    digits = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"(\d+)"), 1)
    edits = F.levenshtein("tight_a", "tight_b", TITLE_EDITS)
    longest = F.greatest(F.length("tight_a"), F.length("tight_b"))
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))
    slip = (edits <= 1) & (edits >= 0) | (edits == 2) & (letters("tight_a") == letters("tight_b"))
    return (
        F.when(F.col("base_a") == F.col("base_b"), 0).when((digits("base_a") != digits("base_b")) | (F.col("tight_a") == "") | (F.col("tight_b") == ""), 3)
        .when(F.col("tight_a") == F.col("tight_b"), 0).when(slip & (longest >= 5), 1)
        .when((edits >= 0) & (longest >= 8) & (edits <= F.when(longest >= 12, 4).otherwise(3)), 2).otherwise(3)
    )


def _length_level() -> Column:
    gap = F.abs(F.col("length_a") - F.col("length_b"))
    return F.when(gap.isNull(), 4).when(gap <= 0.75, 0).when(gap <= NEAR_S, 1).when(gap <= 8, 2).otherwise(3)


def _version_level() -> Column:
    """0 the same versions (of one remixer or place), 1 some shared, 2 a version beside none, 3 others."""
    named = (F.col("named_a") == "") | (F.col("named_b") == "") | (F.levenshtein("named_a", "named_b", 2) >= 0)
    return (
        F.when(F.col("versions_a") == F.col("versions_b"), F.when(named, 0).otherwise(3)).when(F.arrays_overlap("versions_a", "versions_b"), 1)
        .when((F.size("versions_a") == 0) | (F.size("versions_b") == 0), 2).otherwise(3)
    )


def compare(pairs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``input_id, candidate_id, title, artist, length, version`` levels and the gap in seconds of every pair.

    Only artists that differ, with cores near enough to be one, reach Python.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([0 if same_artist(list(a), list(b), lexicon) else 2 for a, b in zip(left, right, strict=True)], dtype="int32")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    judged = F.pandas_udf(run, "int")
    core = lambda a: F.element_at(F.split(a, r"\|"), 1)
    near = F.exists("artists_a", lambda a: F.exists("artists_b", lambda b: F.levenshtein(core(a), core(b), 4) >= 0))
    known = F.when((F.size("artists_a") == 0) | (F.size("artists_b") == 0), 1).when(F.arrays_overlap("artists_a", "artists_b"), 0).when(~near, 2)
    levels = pairs.select(
        "input_id", "candidate_id", _title_level().alias("title"), known.alias("known"), _length_level().alias("length"), _version_level().alias("version"),
        F.abs(F.col("length_a") - F.col("length_b")).alias("gap"), "artists_a", "artists_b",
    )
    keep = ("input_id", "candidate_id", "title", "artist", "length", "version", "gap")
    easy = levels.where("known is not null").withColumn("artist", F.col("known")).select(*keep)
    return easy.unionByName(levels.where("known is null").withColumn("artist", judged("artists_a", "artists_b")).select(*keep))


def fit(patterns: pd.DataFrame, rounds: int = 200) -> tuple[list[dict[str, np.ndarray]], np.ndarray]:
    """EM over counted level patterns (``title, artist, length, version, n``): level probabilities of the four classes and their shares.

    All probabilities are free; the start counts as ten pairs, so that an empty level keeps a probability.
    """
    tables = [{k: np.array(START[k][c]) for k in LEVELS} for c in range(len(SHARES))]
    shares = np.array(SHARES)
    if not len(patterns):
        return tables, shares
    patterns = patterns.sort_values(list(LEVELS))  # sums don't depend on the order in which patterns came
    counts = patterns["n"].to_numpy(float)
    levels = {k: patterns[k].to_numpy(int) for k in LEVELS}
    last = -np.inf
    for _ in range(rounds):
        logs = np.stack([np.log(shares[c]) + sum(np.log(tables[c][k][levels[k]]) for k in LEVELS) for c in range(len(SHARES))])
        top = logs.max(axis=0)
        total = top + np.log(np.exp(logs - top).sum(axis=0))
        post = np.exp(logs - total)
        for c in range(len(SHARES)):
            weight = post[c] * counts
            for k, size in LEVELS.items():
                hit = np.bincount(levels[k], weight, size) + 10 * np.array(START[k][c])
                tables[c][k] = hit / hit.sum()
        shares = np.clip((post * counts).sum(axis=1) / counts.sum(), 1e-4, None)
        shares /= shares.sum()
        now = float((total * counts).sum())
        if now - last < 1e-7 * abs(now):
            break
        last = now
    return tables, shares


def _odds(tables: list[dict[str, np.ndarray]], shares: np.ndarray) -> Column:
    """Odds that a pair is a match, from its levels."""
    one = []
    for c in range(len(SHARES)):
        total = F.lit(float(np.log(shares[c])))
        for name in LEVELS:
            total = total + F.element_at(F.array(*[F.lit(float(x)) for x in np.log(tables[c][name])]), F.col(name) + 1)
        one.append(F.exp(total))
    return one[0] / (one[1] + one[2] + one[3])


_COMPARED = [("base", "base"), ("tight", "tight"), ("artists", "artists"), ("length_s", "length"), ("versions", "versions"), ("named", "named")]


def link(inputs: DataFrame, candidates: DataFrame) -> DataFrame:
    """``input_id, candidate_id, confidence`` of the best candidate of every input with a proposed pair.

    Repeated inputs count once (of rows that differ under one id the least); a null artist, length or version is a level of its own, a null or empty
    title proposes nothing; ties go to the nearer length, then the smaller candidate id; inputs
    without a pair give no row; extra columns are left out.
    """
    single = inputs.groupBy("input_id").agg(F.min(F.struct("title", "artist", "duration_s", "qualifiers", "alternate")).alias("i")).select("input_id", "i.*")
    length = F.when((F.col("duration_s") > 0) & ~F.isnan("duration_s"), F.col("duration_s"))
    reading = lambda n, t, a: F.struct(F.lit(n).alias("reading"), t.alias("title"), a.alias("artist"))
    readings = F.array(reading(0, F.col("title"), F.col("artist")), F.when(F.col("alternate").isNotNull(), reading(1, F.col("alternate.title"), F.col("alternate.artist"))))
    left_rows = single.select(F.col("input_id").alias("id"), "qualifiers", length.alias("length_s"), F.explode(F.filter(readings, lambda r: r.isNotNull())).alias("r"))
    # Where title and artist may have changed places, nothing is learned from them.
    fields = inputs.where("alternate is null").select("artist").unionByName(candidates.select("artist"))
    lexicon = learn(fields.select(F.explode(_credits(F.col("artist"))).alias("artist")))
    left = cut(prepare(left_rows.select("id", "r.*", "qualifiers", "length_s"), lexicon))
    none = F.lit(None).cast("string")
    recorded = candidates.select(
        F.lit("candidate").alias("tbl"), F.col("candidate_id").alias("rec_id"), F.col("provider").alias("source"), F.date_format("listed_at", "yyyy-MM").alias("period"),
        F.lit("s").alias("home"), F.col("duration_s").alias("number"), none.alias("unit_text"), F.col("duration_label").alias("label"),
    )
    lengths = resolve_lengths(recorded).select(F.col("rec_id").alias("candidate_id"), (F.col("length_ms") / 1000.0).alias("length_s"))
    right_rows = candidates.select("candidate_id", "title", "artist", "qualifiers").join(lengths, "candidate_id", "left")
    right = cut(prepare(right_rows.select(F.col("candidate_id").alias("id"), F.lit(0).alias("reading"), "title", "artist", "qualifiers", "length_s"), lexicon))
    asked = _keys(left, True).select(F.col("id").alias("input_id"), "reading", F.col("tight").alias("tight_a"), "key")
    offered = _keys(right, False).select(F.col("id").alias("candidate_id"), F.col("tight").alias("tight_b"), "key")
    near = F.levenshtein("tight_a", "tight_b", TITLE_EDITS) >= 0  # before pairs are shuffled
    proposed = asked.join(offered, "key").where(near).select("input_id", "reading", "candidate_id").distinct()
    side = lambda frame, x: frame.select(F.col("id").alias("input_id" if x == "a" else "candidate_id"), *(["reading"] if x == "a" else []), *[F.col(c).alias(f"{n}_{x}") for c, n in _COMPARED])
    pairs = proposed.join(side(left, "a"), ["input_id", "reading"]).join(side(right, "b"), "candidate_id")
    compared = cut(compare(pairs, lexicon))
    patterns = compared.groupBy(*LEVELS).agg(F.count("*").alias("n")).toPandas()  # bounded: 240 patterns
    tables, shares = fit(patterns)
    scored = compared.withColumn("odds", _odds(tables, shares))
    per_pair = scored.groupBy("input_id", "candidate_id").agg(F.max("odds").alias("odds"), F.min("gap").alias("gap"))
    best = per_pair.groupBy("input_id").agg(
        F.sum("odds").alias("all_odds"),
        F.max(F.struct("odds", (-F.coalesce("gap", F.lit(1e9))).alias("near"), (-F.col("candidate_id")).alias("least"))).alias("best"),
    )
    return best.select("input_id", (-F.col("best.least")).alias("candidate_id"), (F.col("best.odds") / (1 + F.col("all_odds"))).alias("confidence"))


def found(inputs: DataFrame, candidates: DataFrame, least: float = 0.5) -> DataFrame:
    """Inputs and candidates that are the same recording with a confidence of ``least`` or more."""
    return link(inputs, candidates).where(F.col("confidence") >= least).select("input_id", "candidate_id")
