"""Grades: edit distances, precision and recall, regressions, checks of a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanline.functions import text as T


def _rate(errors: Column, units: Column) -> Column:
    return errors / F.greatest(units, F.lit(1))


def char_errors(reference: Column, reading: Column) -> Column:
    """Edits between two texts with collapsed blanks, by character."""
    return F.levenshtein(T.collapse(reference), T.collapse(reading))


def word_errors(reference: Column, reading: Column) -> Column:
    """Edits between two texts by word: every distinct word of the pair becomes one character first."""
    a, b = T.words(reference), T.words(reading)
    known = F.array_distinct(F.concat(a, b))
    # Code points from the CJK block up: one per word, far more than a line has words.
    code = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0x4E00), 4, "0")), "UTF-16BE")
    return F.levenshtein(F.array_join(F.transform(a, code), ""), F.array_join(F.transform(b, code), ""))


def error_rates(pairs: DataFrame) -> DataFrame:
    """``reference, reading`` with ``cer, wer`` and their errors and units; an empty reference counts as one unit."""
    ref, read = F.coalesce("reference", F.lit("")), F.coalesce("reading", F.lit(""))
    out = pairs.withColumns({
        "char_errors": char_errors(ref, read), "chars": F.char_length(T.collapse(ref)), "word_errors": word_errors(ref, read), "n_words": F.size(T.words(ref)),
    })
    return out.withColumns({"cer": _rate(F.col("char_errors"), F.col("chars")), "wer": _rate(F.col("word_errors"), F.col("n_words"))})


def multiset_f1(expected: DataFrame, actual: DataFrame, group: str) -> DataFrame:
    """Precision, recall and F1 of each group by multiset, on lower-case trimmed pairs; both sides count how often."""
    key = F.concat_ws("|", F.lower(T.strip(F.col("title"))), F.lower(T.strip(F.coalesce("artist", F.lit("")))))
    count = lambda f, n: f.groupBy(group, key.alias("key")).agg(F.count("*").alias(n))
    joined = count(expected, "want").join(count(actual, "got"), [group, "key"], "full_outer").na.fill(0, ["want", "got"])
    sums = joined.groupBy(group).agg(F.sum(F.least("want", "got")).alias("tp"), F.sum("want").alias("want"), F.sum("got").alias("got"))
    return _prf(sums, F.col("tp"), F.col("got"), F.col("want"))


def set_f1(expected: DataFrame, actual: DataFrame, group: str) -> DataFrame:
    """Counts and micro-averaged scores by distinct folded pairs (``ftitle, fartist``), summed over documents."""
    keys = ["doc_id", group, "ftitle", "fartist"]
    clean = lambda f: f.select("doc_id", group, "ftitle", F.coalesce("fartist", F.lit("")).alias("fartist")).distinct()
    joined = clean(expected).withColumn("w", F.lit(1)).join(clean(actual).withColumn("g", F.lit(1)), keys, "full_outer")
    sums = joined.groupBy(group).agg(F.count_if(F.col("w").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count("w").alias("want"), F.count("g").alias("got"))
    return _prf(sums, F.col("tp"), F.col("got"), F.col("want"))


def _prf(sums: DataFrame, tp: Column, got: Column, want: Column) -> DataFrame:
    """Nothing claimed is full precision, nothing wanted full recall; without a hit F1 is 0."""
    p = F.when(got > 0, tp / got).otherwise(1.0)
    r = F.when(want > 0, tp / want).otherwise(1.0)
    return sums.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(tp > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def summary(scores: DataFrame, by: str, within: str) -> DataFrame:
    """One pass over ``by``'s classes and over all of it: micro error rates, macro F1, exact median time, shares."""
    grouped = scores.groupingSets([[by, within], [by]], by, within)
    return grouped.agg(
        F.count("*").alias("n"), (F.sum("char_errors") / F.nullif(F.sum("chars"), F.lit(0))).alias("cer"), (F.sum("word_errors") / F.nullif(F.sum("n_words"), F.lit(0))).alias("wer"),
        F.avg("f1").alias("f1"), F.median("ms").alias("median_ms"), F.count_if(F.col("empty")).alias("empties"), F.avg(F.col("fallback").cast("int")).alias("fallback_share"),
    )


def regressions(now: DataFrame, before: DataFrame, epsilon: float = 0.01) -> DataFrame:
    """Metrics (``engine, class, metric, value, higher_is_better``) worse than before by more than epsilon; new ones never are."""
    joined = now.join(before.select("engine", "class", "metric", F.col("value").alias("was")), ["engine", "class", "metric"], "left")
    worse = F.when(F.col("higher_is_better"), F.col("was") - F.col("value")).otherwise(F.col("value") - F.col("was"))
    return joined.where(worse > epsilon).withColumn("worse_by", worse)


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, side`` of the rows that only one side has."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").where("l is null or r is null").select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def catalog_problems(rows: DataFrame) -> DataFrame:
    """``row_id, problem`` of every row of a catalog that breaks a rule; a row may break several.

    Rows: ``row_id, recording_mbid, title, artist, artists, isrc, isrcs``.
    """
    blank = lambda c: F.coalesce(T.strip(F.col(c)) == "", F.lit(True))
    seen = rows.groupBy("recording_mbid").agg(F.min("row_id").alias("first_row"), F.count("*").alias("n")).where("n > 1 and recording_mbid is not null")
    checks = {
        "no recording id": blank("recording_mbid"), "empty title": blank("title"), "empty artist": blank("artist"), "no credits": F.col("artists").isNull() | (F.size("artists") <= 0),
        "malformed code": F.col("isrc").isNotNull() & ~F.col("isrc").rlike(T.ISRC), "code not listed": F.col("isrc").isNotNull() & ~F.coalesce(F.array_contains("isrcs", F.col("isrc")), F.lit(False)),
    }
    wrong = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]), lambda x: x.isNotNull())
    direct = rows.select("row_id", F.explode(wrong).alias("problem"))
    repeated = rows.join(seen, "recording_mbid").where("row_id <> first_row").select("row_id", F.lit("duplicate recording id").alias("problem"))
    return direct.unionByName(repeated)


def catalog_floors(rows: DataFrame, floors: dict[str, int], isrc_share: float = 0.8) -> DataFrame:
    """``name, found, floor, ok`` for the share of rows with a code and the number of rows with each tag."""
    totals = rows.agg(*[F.count_if(F.array_contains("tags", F.lit(t))).cast("double").alias(t) for t in floors], F.avg(F.col("isrc").isNotNull().cast("double")).alias("isrc_share"))
    entries = F.array(*[F.struct(F.lit(t).alias("name"), F.col(t).alias("found"), F.lit(float(n)).alias("floor")) for t, n in [*floors.items(), ("isrc_share", isrc_share)]])
    return totals.select(F.inline(entries)).withColumn("ok", F.coalesce(F.col("found") >= F.col("floor"), F.lit(False)))


def out_of_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key is smaller than that of the row before.

    Neighbours are compared within ranges of ``order`` and at their borders, so no task holds the whole table.
    """
    step = 100_000
    binned = rows.select(key, order).withColumn("bin", F.floor(F.col(order) / step))
    inside = Window.partitionBy("bin").orderBy(order)
    first = binned.withColumn("before", F.lag(key).over(inside))
    ends = binned.groupBy("bin").agg(F.max_by(key, order).alias("last_key"))
    bounds = ends.withColumn("bin_before", F.lag("bin").over(Window.orderBy("bin"))).select("bin", "bin_before")  # a row per 100,000 rows
    last = ends.select(F.col("bin").alias("bin_before"), "last_key")
    joined = first.join(bounds.join(last, "bin_before", "left"), "bin", "left")
    return joined.withColumn("before", F.coalesce("before", "last_key")).where(F.col(key) < F.col("before")).select(order, key, "before")


def score_images(truths: DataFrame, readings: DataFrame) -> DataFrame:
    """``image_id`` with error rates, precision, recall and F1 of its items, ``empty`` and ``fallback``: a row for each image with a truth.

    Both sides: ``image_id, lines array<string>, items array<struct<title, artist>>``, readings also ``least``,
    their lowest confidence.  An image without a reading counts as read empty; a text without letters in its
    truth can't come out empty.  Everything stays in its image's row but for the join of the two sides.
    """
    none, nothing = F.array().cast("array<string>"), F.array().cast("array<struct<title:string,artist:string>>")
    flat = lambda lines: T.collapse(F.array_join(F.coalesce(lines, none), " "))
    read = readings.select("image_id", F.col("lines").alias("read_lines"), F.col("items").alias("read_items"), "least")
    both = truths.select("image_id", "lines", "items").join(read, "image_id", "left")
    key = lambda x: F.concat_ws("|", F.lower(T.strip(x["title"])), F.lower(T.strip(F.coalesce(x["artist"], F.lit("")))))
    keys = lambda c: F.array_distinct(F.transform(F.coalesce(c, nothing), key))
    rows = error_rates(both.withColumns({"reference": flat(F.col("lines")), "reading": flat(F.col("read_lines")), "w": keys(F.col("items")), "g": keys(F.col("read_items"))}))
    graded = _prf(rows, F.size(F.array_intersect("w", "g")), F.size("g"), F.size("w"))
    return graded.select(
        "image_id", "cer", "wer", "precision", "recall", "f1", ((F.col("reference") != "") & (F.col("reading") == "")).alias("empty"), (F.coalesce(F.col("least") < 0.6, F.lit(True)) | (F.size("g") == 0)).alias("fallback")
    )


def field_breaks(rows: DataFrame, key: str, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """``key, field, reason`` of every field that breaks its contract: 'missing' for a null, 'shape' for a value its pattern doesn't match.

    ``rules`` names fields with their column and pattern; all are tested in one pass, good rows give none.
    """
    said = lambda name, column, shape: F.struct(F.lit(name).alias("field"), F.when(column.isNull(), "missing").when(~column.cast("string").rlike(shape), "shape").alias("reason"))
    tests = F.array(*[said(name, column, shape) for name, (column, shape) in rules.items()])
    return rows.select(key, F.inline(F.filter(tests, lambda t: t["reason"].isNotNull())))
