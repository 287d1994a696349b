"""Daily roll-ups of events, and usage against allowances."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanline.functions import score as S


def payload_events(events: DataFrame) -> DataFrame:
    """Events with ``occurred_on, env, payload``: the JSON properties as a variant, so that kinds of values stay apart."""
    return events.withColumns({"occurred_on": F.to_date("ts"), "payload": F.try_parse_json("props")})


def check_payload(events: DataFrame, field: str) -> Column:
    """Whether a payload field is absent or a whole number; a text or truth value is neither."""
    value = F.try_variant_get("payload", f"$.{field}", "variant")
    return value.isNull() | F.schema_of_variant(value).isin("BIGINT", "VOID")


def daily_rollup(events: DataFrame, fields: list[str], strict: bool = True) -> DataFrame:
    """``env, occurred_on, event_type, events`` and ``sum_<field>`` of each payload field.

    Missing fields are skipped, and a sum is null where no event has the field.  A field that is
    not a whole number stops the job when ``strict``, before anything is written.
    """
    rows = events
    if strict:
        for field in fields:
            rows = rows.withColumn("payload", F.when(check_payload(rows, field), F.col("payload")).otherwise(F.raise_error(F.lit(f"payload field {field} is not a whole number"))))
    sums = [F.sum(F.try_variant_get("payload", f"$.{f}", "bigint")).alias(f"sum_{f}") for f in fields]
    return rows.groupBy("env", "occurred_on", "event_type").agg(F.count("*").alias("events"), *sums)


def rollup_key(env: Column, day: Column, event_type: Column) -> Column:
    """Composite key under which a rerun overwrites a day."""
    return F.concat(F.lit("AGG#"), env, F.lit("#"), day.cast("string"), F.lit("/TYPE#"), event_type)


def month_to_date(events: DataFrame, value: str = "value") -> DataFrame:
    """Running sum of a value within its UTC month, by event type and day; a day is one row before the window."""
    days = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum(value).alias("day_sum"))
    month = Window.partitionBy("event_type", F.date_trunc("month", "day")).orderBy("day")
    return days.withColumn("month_sum", F.sum("day_sum").over(month))


def projected_usage(volumes: DataFrame, costs: DataFrame, baseline: DataFrame) -> DataFrame:
    """``env, metric, total, confidence``: volumes times unit costs plus the baseline; the weakest confidence of any part.

    ``volumes(env, operation, volume)``, ``costs(operation, metric, cost, confidence)``, ``baseline(env, metric, amount)``.
    An operation without costs gives nothing.
    """
    rank = F.create_map(*[F.lit(x) for pair in (("measured", 0), ("estimated", 1), ("declared", 2)) for x in pair])
    parts = volumes.join(costs, "operation").select("env", "metric", (F.col("volume") * F.col("cost")).alias("amount"), "confidence")
    every = parts.unionByName(baseline.select("env", "metric", "amount", F.lit("declared").alias("confidence")))
    return every.groupBy("env", "metric").agg(F.sum("amount").alias("total"), F.max_by("confidence", rank[F.col("confidence")]).alias("confidence"))


def in_basis(monthly: Column, basis: Column, days: int = 30) -> Column:
    """A monthly amount per month, day or second; a fixed allowance has no rate."""
    return F.when(basis == "monthly", monthly).when(basis == "per_day", monthly / days).when(basis == "per_second", monthly / (days * 86400)).otherwise(F.raise_error(F.concat(F.lit("no rate for basis "), basis)).cast("double"))


def estimate(totals: DataFrame, meters: DataFrame, limits: DataFrame, splits: DataFrame, gates: dict[str, float], days: int = 30) -> DataFrame:
    """``env, limit_name, scope, projected, allowance, pct, breached, metrics`` of every limit in use, fullest first.

    A metric without a meter or limit stops the job.
    """
    metered = totals.join(meters, "metric", "left").withColumn("limit_name", F.when(F.col("limit_name").isNull(), F.raise_error(F.concat(F.lit("unmetered "), "metric")).cast("string")).otherwise(F.col("limit_name")))
    used = metered.groupBy("env", "limit_name").agg(F.sum("total").alias("monthly"), F.array_sort(F.collect_set("metric")).alias("metrics"))
    joined = used.join(limits, "limit_name").join(splits, ["limit_name", "env"], "left")
    rows = joined.withColumn("projected", in_basis(F.col("monthly"), F.col("basis"), days)).withColumn("pct", S.share_pct(F.col("projected"), F.coalesce("allowance", F.lit(0.0))))
    gate = F.when(F.col("scope") == "provider", gates["provider"]).otherwise(gates["own"])
    return rows.select("env", "limit_name", "scope", "projected", "allowance", "pct", (F.col("pct") > gate).alias("breached"), "metrics").orderBy(F.desc("pct"), "limit_name", "env")


def over_allocated(limits: DataFrame, splits: DataFrame) -> DataFrame:
    """Limits whose shares add up to more than their total."""
    shares = splits.groupBy("limit_name").agg(F.sum("allowance").alias("shared"))
    return limits.join(shares, "limit_name").where(F.col("shared") > F.col("total"))


def readings(shares: DataFrame, usage: DataFrame, trip: float = 85.0) -> DataFrame:
    """Each share with ``used, pct, tripped, unknown``; a metric without data is unknown, not zero, and trips nothing."""
    joined = shares.join(usage, ["limit_name", "env"], "left").withColumn("unknown", F.col("used").isNull())
    joined = joined.withColumn("pct", F.when(~F.col("unknown"), S.share_pct(F.col("used"), F.col("allowance"))))
    return joined.withColumn("tripped", F.coalesce(F.col("pct") >= trip, F.lit(False)))


def departures(requests: DataFrame, interval_s: float, key: str = "caller") -> DataFrame:
    """When each request may leave if a caller's departures are ``interval_s`` apart: ``slot_s``.

    Closed form of the sequential bucket: the running maximum of arrival less its turn, plus the turn.
    A caller is one window; callers are many, and a caller's requests are bounded by its rate.
    """
    order = Window.partitionBy(key).orderBy("arrival_s", "request_id")
    turn = (F.row_number().over(order) - 1) * F.lit(float(interval_s))
    rows = requests.withColumn("turn", turn)
    lag = F.max(F.col("arrival_s") - F.col("turn")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("slot_s", lag + F.col("turn")).drop("turn")


def quota_ledger(calls: DataFrame, cap: int) -> DataFrame:
    """``account, call_no, cost, accepted, used``: calls charged in order, refused where they would exceed the cap.

    A refused call is not charged, so a running sum can't say it: calls are read in order, partition by
    partition, and only the account at hand and its charge are remembered from one batch to the next.  Ties
    of a number go to the smaller cost.
    """

    def charge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, used = None, 0
        for batch in batches:
            accepted, so_far = [], []
            for owner, cost in zip(batch["account"].tolist(), batch["cost"].tolist(), strict=True):
                if owner != account:
                    account, used = owner, 0
                fits = used + cost <= cap
                used += cost if fits else 0
                accepted.append(fits)
                so_far.append(used)
            yield batch.assign(accepted=accepted, used=so_far)

    kind = calls.schema["account"].dataType.simpleString()
    plain = calls.select("account", F.col("call_no").cast("bigint").alias("call_no"), F.col("cost").cast("bigint").alias("cost"))
    ordered = plain.where("account is not null and cost is not null").repartition("account").sortWithinPartitions("account", "call_no", "cost")
    return ordered.mapInPandas(charge, f"account {kind}, call_no bigint, cost bigint, accepted boolean, used bigint")


def spaced(requests: DataFrame, interval_s: float, key: str = "caller") -> DataFrame:
    """When each request starts if starts of a caller are ``interval_s`` apart and each may start ``overshoot_s`` later than it might: ``start_s``.

    As ``departures``, with the sum of the intervals and overshoots before a request in place of its turn.
    """
    order = Window.partitionBy(key).orderBy("arrival_s", "request_id")
    late = F.coalesce(F.col("overshoot_s"), F.lit(0.0))
    rows = requests.withColumns({"late": late}).withColumn("before", (F.row_number().over(order) - 1) * F.lit(float(interval_s)) + F.coalesce(F.sum("late").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    lag = F.max(F.col("arrival_s") - F.col("before")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start_s", lag + F.col("before") + F.col("late")).drop("late", "before")


def metric_sums(points: DataFrame, metrics: DataFrame, since: Column, until: Column) -> DataFrame:
    """``metric, total, points`` of every metric over [since, until); one without points has a null total, not zero."""
    inside = points.where((F.col("at") >= since) & (F.col("at") < until)).groupBy("metric").agg(F.sum("value").alias("total"), F.count("value").alias("points"))
    return metrics.select("metric").distinct().join(inside, "metric", "left").select("metric", "total", F.coalesce("points", F.lit(0)).alias("points"))
