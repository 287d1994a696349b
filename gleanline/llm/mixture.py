"""A corpus of target shares from sources of unequal size, by the cube method.

Every text of a source is used a whole number of times and perhaps once more.  The chance of that
extra use is the same for all texts of a source; the cube method settles the chances to 0 or 1 while
token and text totals stay balanced: chances move along the null space of the constraints until all
but a few are settled, bucket by bucket in parallel, then over what the buckets left, and a small
landing problem remains.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanline.llm.tokens import token_count
from gleanline.session import cut

#: Texts that one flight task takes; sources have as many buckets as the largest needs.
BUCKET = 20_000
EPS = 1e-9


def flight(chance: np.ndarray, sizes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Chances settled as far as the totals of ``sizes`` and of units can be kept; at most two stay open.

    Units enter a window of three; the window's chances move along the direction that leaves both
    totals as they are, to one end or the other with the odds that keep each unit's expectation.
    """
    chance = np.clip(chance.astype(float), 0, 1)
    open_units = [int(i) for i in np.flatnonzero((chance > EPS) & (chance < 1 - EPS))]
    window: list[int] = []
    values = chance.tolist()
    size = sizes.astype(float).tolist()
    at = 0
    for unit in open_units:
        window.append(unit)
        while len(window) == 3:
            a, b, c = window
            # The null space of [1 1 1; size]: the cross product of both rows.
            direction = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if direction == (0.0, 0.0, 0.0):
                direction = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for u, x in zip(window, direction):
                if x > 0:
                    up, down = min(up, (1 - values[u]) / x), min(down, values[u] / x)
                elif x < 0:
                    up, down = min(up, values[u] / -x), min(down, (1 - values[u]) / -x)
            move = up if draws[at % len(draws)] * (up + down) < down else -down
            at += 1
            kept = []
            for u, x in zip(window, direction):
                values[u] += move * x
                if values[u] < EPS:
                    values[u] = 0.0
                elif values[u] > 1 - EPS:
                    values[u] = 1.0
                else:
                    kept.append(u)
            window = kept
    return np.array(values)


def landing(chance: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The few open units settled so that tokens, then units, come nearest to their totals."""
    out = np.clip(chance.astype(float), 0, 1)
    open_units = np.flatnonzero((out > EPS) & (out < 1 - EPS))
    if not len(open_units):
        return np.round(out)
    tokens, units = float((out[open_units] * sizes[open_units]).sum()), float(out[open_units].sum())
    best = min(itertools.product((0, 1), repeat=len(open_units)), key=lambda c: (abs(float(np.dot(c, sizes[open_units])) - tokens), abs(sum(c) - units)))
    out[open_units] = best
    return np.round(out)


def texts_of(documents: DataFrame) -> DataFrame:
    """Distinct texts with tokens: ``doc_id``, ``source``, ``n_tokens``.

    Null and empty texts have no tokens and are left out.  A text under several ids or sources is one
    text, under the smallest id that has a source and that row's source; if no copy has one, under the
    smallest id.  Copies meet by the text's digest, after partial
    aggregation, so a hot text is one row a task.
    """
    rows = documents.where("text is not null and text <> ''").select("doc_id", "source", "text")
    digest = F.sha2(F.col("text"), 256)
    first = rows.groupBy(digest.alias("digest")).agg(F.min(F.struct(F.col("source").isNull().alias("unknown"), "doc_id", "source")).alias("first")).select("first.doc_id", "first.source")
    counted = documents.select("doc_id", token_count(F.col("text")).alias("n_tokens")).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    return first.join(counted, "doc_id").where("n_tokens > 0")


def plan(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_name, source, weight, max_uses, target_tokens, source_tokens, source_texts, uses`` of every target.

    A mix is as large as its scarcest source allows: target tokens are the target share of the largest
    corpus in which no source that has texts and a positive weight needs more than ``max_uses`` of each
    text.  Sources without texts, weights of zero or null and use caps below one give nothing; the other
    sources keep their shares among themselves.
    """
    totals = texts.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("source_texts"))
    wanted = targets.groupBy("mix_name", "source").agg(F.sum("weight").alias("weight"), F.min("max_uses").alias("max_uses"))
    joined = wanted.join(totals, "source", "left").withColumns({"source_tokens": F.coalesce("source_tokens", F.lit(0)), "source_texts": F.coalesce("source_texts", F.lit(0))})
    usable = (F.col("source_tokens") > 0) & (F.col("weight") > 0) & (F.col("max_uses") >= 1)
    size = joined.where(usable).groupBy("mix_name").agg(F.min(F.col("source_tokens") * F.col("max_uses") / F.col("weight")).alias("mix_size"))
    planned = joined.join(size, "mix_name", "left")
    target = F.when(usable, F.col("weight") * F.col("mix_size")).otherwise(0.0)
    uses = F.when(usable, F.least(target / F.col("source_tokens"), F.col("max_uses").cast("double"))).otherwise(0.0)
    return planned.select("mix_name", "source", "weight", "max_uses", target.alias("target_tokens"), "source_tokens", "source_texts", uses.alias("uses"))


def _settle(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    pdf = pdf.sort_values("doc_id", kind="stable")
    sizes = pdf["n_tokens"].to_numpy(float)
    seed = int(pd.util.hash_pandas_object(pdf[["mix_name", "source"]].head(1).astype(str).agg("|".join, axis=1), index=False).iloc[0] % (2**32)) + int(pdf["doc_id"].iloc[0] % 1_000_003)
    order = np.random.default_rng(seed)
    shuffled = order.permutation(len(pdf))  # neighbours by id may be alike; the random order spreads them
    # Units that stay open are among the last to enter, so the smallest do: little is left to land.
    rank = np.argsort(np.argsort(sizes[shuffled], kind="stable"), kind="stable")
    small = rank < max(16, len(pdf) // 20)
    shuffled = np.concatenate([shuffled[~small], shuffled[small][np.argsort(-sizes[shuffled][small], kind="stable")]])
    chance = pdf["chance"].to_numpy(float)[shuffled]
    settled = flight(chance, sizes[shuffled], order.random(max(16, min(len(pdf) * 2, 1 << 16))))
    if last:
        settled = landing(settled, sizes[shuffled])
    out = np.empty(len(pdf))
    out[shuffled] = settled
    return pdf.assign(chance=out)


_UNITS = "mix_name string, source string, doc_id bigint, n_tokens int, whole int, chance double"


def chosen(texts: DataFrame, planned: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``mix_name, source, doc_id, n_tokens, uses`` of every text used at least once; ``bucket`` texts fly in one task."""
    rates = planned.where("uses > 0").select("mix_name", "source", F.floor(F.col("uses") + EPS).cast("int").alias("whole"), "uses", "max_uses", "source_texts")
    chance = F.when(F.col("uses") - F.col("whole") > EPS, F.col("uses") - F.col("whole")).otherwise(0.0)
    units = texts.join(rates, "source")
    units = units.select("mix_name", "source", "doc_id", "n_tokens", "whole", chance.alias("chance"))
    every, rest = units.where("chance = 0"), units.where("chance > 0")
    still = f"chance > {EPS} and chance < 1 - {EPS}"
    # Each bucket leaves two open units at most: what all buckets of a source left is flown in buckets again, until one is enough.
    most = rates.agg(F.max("source_texts")).first()[0] or 0
    while True:
        buckets = max(1, math.ceil(most / bucket))
        placed = rest.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(buckets)), F.lit(buckets)))
        flown = cut(placed.groupBy("mix_name", "source", "bucket").applyInPandas(lambda p: _settle(p.drop(columns="bucket"), False), _UNITS))
        every, rest = every.unionByName(flown.where(f"not ({still})")), flown.where(still)
        if buckets == 1 or 2 * buckets <= bucket:
            break
        most = 2 * buckets
    every = every.unionByName(rest.groupBy("mix_name", "source").applyInPandas(lambda p: _settle(p, True), _UNITS))
    return every.select("mix_name", "source", "doc_id", "n_tokens", (F.col("whole") + F.round("chance").cast("int")).alias("uses")).where("uses > 0")


def corpus(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_name, doc_id, source, uses, n_tokens, text``: a row for each text of each mix, used ``uses`` times.

    Empty tables give no rows; ties and repeated rows are settled by the smallest id; extra columns are
    left out.  Texts are joined once, with all mixes of a document in one row.
    """
    picked = _picked(documents, targets)
    by_doc = picked.groupBy("doc_id").agg(F.collect_list(F.struct("mix_name", "source", "uses", "n_tokens")).alias("mixes"))  # one entry a mix
    texts = documents.where("text is not null and text <> ''").select("doc_id", "text")
    once = texts.groupBy("doc_id").agg(F.min("text").alias("text"))  # a row delivered twice is one text
    return once.join(by_doc, "doc_id").select("doc_id", "text", F.inline("mixes")).select("mix_name", "doc_id", "source", "uses", "n_tokens", "text")


def _picked(documents: DataFrame, targets: DataFrame) -> DataFrame:
    texts = cut(texts_of(documents))
    return cut(chosen(texts, plan(texts, targets)))


def shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of every source of every mix: ``mix_name, source, weight, max_uses, source_texts, texts_used, most_uses, tokens, share``."""
    texts = cut(texts_of(documents))
    planned = plan(texts, targets)
    used = chosen(texts, planned).groupBy("mix_name", "source").agg(
        F.count("*").alias("texts_used"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("n_tokens").cast("long")).alias("tokens")
    )
    total = used.groupBy("mix_name").agg(F.sum("tokens").alias("mix_tokens"))
    joined = planned.join(used, ["mix_name", "source"], "left").join(total, "mix_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        "mix_name", "source", "weight", "max_uses", "source_texts", zero("texts_used"), zero("most_uses"), zero("tokens"),
        F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("share"),
    )
