"""Lengths recorded in different units, brought to whole milliseconds.

A recorded length is a number, a number with a unit, or words ("4 Min. 53 Sek.").  Stated units are
read off; numbers without a unit are assigned one by a mixture: all lengths share one log-normal
shape, and a unit shifts it by the logarithm of its conversion factor.  Location and scale are
fitted once on a histogram of bounded size; each source has its own unit weights, drawn towards
them per month, so that a source may change its unit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Milliseconds per unit.
UNIT_MS = {
    "sample44k": 1000 / 44100,
    "ms": 1.0,
    "cs": 10.0,
    "frame75": 1000 / 75,
    "s": 1000.0,
    "min": 60000.0,
    "h": 3600000.0,
}
# How units are written (lower case, without full stops).
UNIT_NAMES = {
    "ms": ["ms", "msec", "msecs", "millisecond", "milliseconds", "millis"],
    "cs": ["cs", "1/100 s", "1/100s", "centisecond", "centiseconds", "hundredths"],
    "frame75": ["fr", "fr 75", "frame", "frames", "frames 75"],
    "s": ["s", "sec", "secs", "second", "seconds", "sek", "sekunde", "sekunden", "\"", "″", "”"],
    "min": ["m", "min", "mins", "minute", "minutes", "minuten", "'", "′", "’"],
    "h": ["h", "hr", "hrs", "hour", "hours", "std", "stunde", "stunden"],
    "sample44k": ["samples", "sample"],
}
UNITS = list(UNIT_MS)
OFFSETS = np.log(np.array([UNIT_MS[u] for u in UNITS]))
BINS_PER_E = 50
BIN_LIMIT = 2500  # bins of 0.02 from e**-50 to e**50: at most 5,001 rows a histogram
CLOSE = 0.7  # units whose log factors differ by less can't be told apart row by row
PRIOR_ROWS = 30.0  # weight of a source's own mix against one month's rows
SURE = 0.95


def _unit_map() -> Column:
    pairs = [F.lit(x) for unit, names in UNIT_NAMES.items() for name in names for x in (name, unit)]
    return F.create_map(*pairs)


def _factor_map() -> Column:
    return F.create_map(*[F.lit(x) for unit, ms in UNIT_MS.items() for x in (unit, ms)])


def unit_of(text: Column) -> Column:
    """The unit that a unit field names, or null."""
    return F.try_element_at(_unit_map(), F.regexp_replace(F.trim(F.lower(text)), r"\.", ""))


def stated_ms(label: Column) -> Column:
    """Milliseconds (double) that a worded length states; null for plain numbers and unreadable text."""
    text = F.trim(F.regexp_replace(F.lower(label), r"[\u00a0\u202f\u2009]", " "))
    text = F.regexp_replace(text, r"^(?:~|≈|about|approx(?:\.|imately)?|ca\.?|circa|c\.)\s*", "")
    text = F.regexp_replace(text, r"^p?t(?=\d)", "")
    for sign, value in (("½", ".5"), ("¼", ".25"), ("¾", ".75")):
        text = F.regexp_replace(F.regexp_replace(text, rf"(?<=\d)\s?{sign}", value), sign, f"0{value}")

    def number(part: Column, grouped: bool = False) -> Column:
        comma = F.regexp_replace(part, r",(?=\d{3}(?:\D|$))", "") if grouped else part
        return F.regexp_replace(comma, ",", ".").try_cast("double")

    clock = r"^(?:(\d{1,3}):)?(\d{1,3}):(\d{1,2}(?:[.,]\d+)?)$"
    hours = F.coalesce(F.regexp_extract(text, clock, 1).try_cast("double"), F.lit(0.0))
    of_clock = (hours * 3600 + F.regexp_extract(text, clock, 2).try_cast("double") * 60 + number(F.regexp_extract(text, clock, 3))) * 1000
    samples = r"^([\d.,]+)\s*samples?\s*(?:@|at)\s*([\d.,]+)\s*(k?)hz$"
    rate = number(F.regexp_extract(text, samples, 2)) * F.when(F.regexp_extract(text, samples, 3) == "k", 1000.0).otherwise(1.0)
    of_samples = number(F.regexp_extract(text, samples, 1), grouped=True) * 1000 / F.when(rate > 0, rate)
    frames = r"^([\d.,]+)\s*(?:fr|frames?)\.?\s*(?:\(?\s*(?:@\s*)?(\d+)\s*(?:/\s*s|fps)\s*\)?)?$"
    per_s = F.coalesce(F.nullif(F.regexp_extract(text, frames, 2).try_cast("double"), F.lit(0.0)), F.lit(75.0))
    of_frames = number(F.regexp_extract(text, frames, 1), grouped=True) * 1000 / per_s

    part = r"(\d[\d.,]*)\s*([^\d\s.,()]*)\.?"
    whole = r"^(?:\d[\d.,]*\s*[^\d\s.,()]*\.?[\s,]*)+$"
    numbers = F.regexp_extract_all(text, F.lit(part), 1)
    names = F.regexp_extract_all(text, F.lit(part), 2)
    units, factors = _unit_map(), _factor_map()

    def step(state: Column, pair: Column) -> Column:
        named = F.try_element_at(units, pair["name"])
        after = F.when(state["unit"] == "h", "min").when(state["unit"] == "min", "s")
        unit = F.when(pair["name"] == "", after).otherwise(named)
        raw = F.regexp_replace(pair["number"], r"[.,]+$", "")
        grouped = F.when(unit.isin("ms", "cs", "frame75", "sample44k"), F.regexp_replace(raw, r",(?=\d{3}(?:\D|$))", "")).otherwise(raw)
        value = F.regexp_replace(grouped, ",", ".").try_cast("double") * F.try_element_at(factors, unit)
        return F.struct((state["ms"] + value).alias("ms"), unit.alias("unit"))

    pairs = F.zip_with(numbers, names, lambda n, u: F.struct(n.alias("number"), u.alias("name")))
    start = F.struct(F.lit(0.0).alias("ms"), F.lit(None).cast("string").alias("unit"))
    of_parts = F.when(F.size(pairs) > 0, F.aggregate(pairs, start, step)["ms"])
    return (
        F.when(text.rlike(r"^\d+(?:[.,]\d+)?$"), F.lit(None).cast("double"))
        .when(text.rlike(clock), of_clock)
        .when(text.rlike(samples), of_samples)
        .when(text.rlike(frames), of_frames)
        .when(text.rlike(whole), of_parts)
    )


def plain_number(label: Column) -> Column:
    """The number of a text that is only a number."""
    text = F.trim(label)
    return F.when(text.rlike(r"^\d+(?:[.,]\d+)?$"), F.regexp_replace(text, ",", ".").try_cast("double"))


def _log_density(bins: np.ndarray, mu: float, sigma: float) -> np.ndarray:
    """Rows x units: log density of the bins under each unit."""
    z = (bins[:, None] / BINS_PER_E + OFFSETS[None, :] - mu) / sigma
    return -0.5 * np.minimum(z * z, 80.0) - np.log(sigma)


def fit_shape(bins: np.ndarray, units: np.ndarray, counts: np.ndarray, home: np.ndarray) -> tuple[float, float]:
    """Location and scale of log milliseconds by EM; ``units`` is -1 where no unit is stated, ``home`` the field's own."""
    if not len(bins):
        return float(np.log(200000.0)), 0.4
    logs = bins / BINS_PER_E
    known = units >= 0
    start = np.where(known, logs + OFFSETS[np.maximum(units, 0)], logs + OFFSETS[home])
    base = known if counts[known].sum() >= 50 else np.ones(len(bins), bool)
    order = np.argsort(start[base])
    share = np.cumsum(counts[base][order]) / counts[base].sum()
    low, mu, high = (start[base][order][min(np.searchsorted(share, q), len(order) - 1)] for q in (0.25, 0.5, 0.75))
    sigma = max((high - low) / 1.35, 0.05)
    weights = np.full(len(UNITS), 1 / len(UNITS))
    shifted = logs[:, None] + OFFSETS[None, :]
    for _ in range(60):
        with np.errstate(divide="ignore"):
            post = _log_density(bins, mu, sigma) + np.log(weights)[None, :]
        post = np.exp(post - post.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        post[known] = 0
        post[known, units[known]] = 1
        mass = post * counts[:, None]
        near = mass * (np.abs(shifted - mu) < 4 * sigma)  # far lengths (whole mixes, slips) don't widen the shape
        if near.sum() <= 0:
            break
        new = float((near * shifted).sum() / near.sum())
        sigma = float(np.sqrt(max((near * (shifted - new) ** 2).sum() / near.sum(), 0.05**2)))
        weights = np.maximum(mass[~known].sum(axis=0), 0) + 1e-3
        weights /= weights.sum()
        if abs(new - mu) < 1e-7:
            break
        mu = new
    return mu, sigma


def _weights(bins: np.ndarray, counts: np.ndarray, mu: float, sigma: float, prior: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, float]:
    density = np.where(allowed[None, :], _log_density(bins, mu, sigma), -1e9)
    weights = np.where(allowed, prior + 1e-6, 0)
    weights = weights / weights.sum()
    for _ in range(200):
        with np.errstate(divide="ignore"):
            joint = density + np.log(weights)[None, :]
        top = joint.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
        new = (np.exp(joint - total[:, None]) * counts[:, None]).sum(axis=0) + np.where(allowed, prior, 0)
        new /= new.sum()
        if np.abs(new - weights).max() < 1e-9:
            break
        weights = new
    return weights, float((total * counts).sum())


def source_weights(rows: pd.DataFrame, mu: float, sigma: float) -> pd.DataFrame:
    """One source's histogram (``period, home, bin, n``) to unit weights per period."""
    home = UNITS.index(rows["home"].iloc[0])
    flat = np.full(len(UNITS), 0.02)
    flat[home] += 0.5
    total = rows.groupby("bin", as_index=False)["n"].sum()
    bins, counts = total["bin"].to_numpy(float), total["n"].to_numpy(float)
    allowed = np.ones(len(UNITS), bool)
    weights, best = _weights(bins, counts, mu, sigma, flat, allowed)
    for a in range(len(UNITS)):
        for b in range(a + 1, len(UNITS)):
            if abs(OFFSETS[a] - OFFSETS[b]) < CLOSE and allowed[a] and allowed[b]:
                tried = []
                for out in (a, b):
                    trial = allowed.copy()
                    trial[out] = False
                    tried.append((*_weights(bins, counts, mu, sigma, flat, trial)[::-1], trial))
                like, w, trial = max(tried, key=lambda t: t[0])
                if best - like < np.log(counts.sum() + 1) + 5:  # a source keeps to one of two close units unless the rows say otherwise
                    best, weights, allowed = like, w, trial
    out = []
    for period, own in rows.groupby("period", dropna=False):
        w, _ = _weights(own["bin"].to_numpy(float), own["n"].to_numpy(float), mu, sigma, weights * PRIOR_ROWS + 1e-4, allowed)
        out.append((period, [float(x) for x in w]))
    return pd.DataFrame(out, columns=["period", "weights"])


def resolve_lengths(recorded: DataFrame) -> DataFrame:
    """Whole milliseconds of recorded lengths.

    ``recorded``: ``tbl, rec_id, source, period`` (strings but for the id), ``home`` (unit of the field's
    name), ``number`` double, ``unit_text`` string, ``label`` string.  A number wins over a label.  Returns
    ``tbl, rec_id, length_ms, unit, how`` ('stated' or 'fitted'), ``posterior, uncertain, as_named``
    (a plain number in the field's own unit).  Null, NaN, infinite, zero and negative numbers and
    unreadable labels are no lengths and give no row; repeated rows are each resolved; a source without
    a name counts as one source.
    """
    number = F.when((F.col("number") > 0) & ~F.isnan("number") & (F.col("number") < float("1e18")), F.col("number"))
    rows = recorded.select(
        "tbl", "rec_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("period", F.lit("")).alias("period"), "home",
        F.coalesce(number, plain_number(F.col("label"))).alias("value"),
        F.when(number.isNotNull(), unit_of(F.col("unit_text"))).alias("unit"),
        F.when(number.isNull(), stated_ms(F.col("label"))).alias("label_ms"),
    ).where("value > 0 or label_ms > 0")
    factors = F.create_map(*[F.lit(x) for unit, ms in UNIT_MS.items() for x in (unit, ms)])
    bins = lambda value: F.greatest(F.lit(-BIN_LIMIT), F.least(F.lit(BIN_LIMIT), F.rint(F.log(value) * BINS_PER_E).cast("int")))
    known = F.coalesce(F.col("unit"), F.when(F.col("label_ms").isNotNull(), F.lit("ms")))
    histogram = rows.groupBy("tbl", "source", "period", "home", known.alias("unit"), bins(F.coalesce("label_ms", "value")).alias("bin")).agg(F.count("*").alias("n"))
    shape = histogram.groupBy("home", "unit", "bin").agg(F.sum("n").alias("n")).toPandas()  # bounded: units x units x bins
    index = {u: i for i, u in enumerate(UNITS)}
    mu, sigma = fit_shape(
        shape["bin"].to_numpy(float), shape["unit"].map(index).fillna(-1).to_numpy(int), shape["n"].to_numpy(float), shape["home"].map(index).to_numpy(int)
    )

    def weigh(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        done = source_weights(part, mu, sigma)
        done.insert(0, "tbl", key[0])
        done.insert(1, "source", key[1])
        return done

    weights = histogram.where("unit is null").groupBy("tbl", "source").applyInPandas(weigh, "tbl string, source string, period string, weights array<double>")
    stated = F.coalesce(F.col("label_ms"), F.col("value") * F.try_element_at(factors, F.col("unit")))
    to_ms = lambda ms: F.floor(ms + 0.5 + 1e-7).cast("long")
    read = rows.where("unit is not null or label_ms is not null").select(
        "tbl", "rec_id", to_ms(stated).alias("length_ms"), F.col("unit"), F.lit("stated").alias("how"), F.lit(1.0).alias("posterior"), F.lit(False).alias("uncertain"),
        F.coalesce(F.col("unit") == F.col("home"), F.lit(False)).alias("as_named"),
    )
    joined = rows.where("unit is null and label_ms is null").join(weights, ["tbl", "source", "period"], "left")
    scores = F.array(
        *[
            F.log(F.greatest(F.element_at("weights", i + 1), F.lit(1e-12))) - 0.5 * F.least(F.pow((F.log("value") + float(OFFSETS[i]) - mu) / sigma, F.lit(2.0)), F.lit(80.0))
            for i in range(len(UNITS))
        ]
    )
    best = joined.withColumn("scores", scores).withColumn("at", F.array_position("scores", F.array_max("scores")).cast("int"))
    fitted = best.select(
        "tbl", "rec_id", "value", "home",
        F.element_at(F.array(*[F.lit(u) for u in UNITS]), F.col("at")).alias("unit"),
        (1 / F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("scores")))).alias("posterior"),
    ).select(
        "tbl", "rec_id", to_ms(F.col("value") * F.try_element_at(factors, F.col("unit"))).alias("length_ms"), "unit", F.lit("fitted").alias("how"), "posterior",
        (F.col("posterior") < SURE).alias("uncertain"), (F.col("unit") == F.col("home")).alias("as_named"),
    )
    return read.unionByName(fitted)


def recorded_lengths(seed: DataFrame, candidate: DataFrame, lines: DataFrame) -> DataFrame:
    """The three fields of the catalog, provider and list tables in the form ``resolve_lengths`` takes."""
    month = lambda c: F.date_format(c, "yyyy-MM")
    none = F.lit(None).cast("string")
    a = seed.select(
        F.lit("seed_row").alias("tbl"), F.col("row_id").alias("rec_id"), F.col("feed").alias("source"), month("harvested_at").alias("period"), F.lit("ms").alias("home"),
        F.col("duration_ms").alias("number"), F.col("duration_unit").alias("unit_text"), none.alias("label"),
    )
    b = candidate.select(
        F.lit("candidate").alias("tbl"), F.col("candidate_id").alias("rec_id"), F.col("provider").alias("source"), month("listed_at").alias("period"), F.lit("s").alias("home"),
        F.col("duration_s").alias("number"), none.alias("unit_text"), F.col("duration_label").alias("label"),
    )
    c = lines.select(
        F.lit("list_line").alias("tbl"), F.col("line_id").alias("rec_id"), none.alias("source"), none.alias("period"), F.lit("s").alias("home"),
        F.lit(None).cast("double").alias("number"), none.alias("unit_text"), F.col("hints.duration_s").alias("label"),
    )
    return a.unionByName(b).unionByName(c)


def found(lengths: DataFrame) -> DataFrame:
    """Lengths that are not a plain number in the field's own unit."""
    return lengths.where(~F.col("as_named")).select("tbl", "rec_id", "length_ms")
