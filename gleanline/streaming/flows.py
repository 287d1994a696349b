"""Streams: routing, idempotent intake, windowed roll-ups, rate and quota state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleanline.session import checkpoint_folder

#: Rows that a stateful step hands on at once.
CHUNK = 10_000


def routed(events: DataFrame, types: list[str], envs: list[str]) -> DataFrame:
    """Events that one consumer subscribed to, by type and environment."""
    return events.where(F.col("event_type").isin(*types) & F.col("env").isin(*envs))


def domain_of(event_type):
    """The second part of a dotted type name."""
    return F.nullif(F.split_part(event_type, F.lit("."), F.lit(2)), F.lit(""))


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, so redelivered events don't count again."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum by type and window; rows later than the watermark are left out."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("events"), F.sum("value").alias("value_sum")).select(F.col("w.start").alias("window_start"), "event_type", "events", "value_sum")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: bursts of events with no longer gap inside."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def write_days(path: str, dead: str | None = None):
    """``foreachBatch`` sink: each batch replaces its own batch folder, so a retried batch writes the same; bad rows go aside."""

    def sink(batch: DataFrame, number: int) -> None:
        good = batch.where("event_type is not null")
        good.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if dead is not None:
            batch.where("event_type is null").write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return sink


def ledger(calls: DataFrame, cap: int) -> DataFrame:
    """A stream of ``account, call_no, cost`` charged against a cap with state: ``account, call_no, accepted, used``.

    Of an account's calls in one micro-batch only two numbers each are held while they are put in order.
    """

    def charge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        parts = [batch[["call_no", "cost"]].to_numpy("int64") for batch in batches]
        held = np.concatenate(parts) if parts else np.empty((0, 2), "int64")
        held = held[np.argsort(held[:, 0], kind="stable")]
        for start in range(0, len(held), CHUNK):
            accepted, so_far = [], []
            for cost in held[start : start + CHUNK, 1].tolist():
                fits = used + cost <= cap
                used += cost if fits else 0
                accepted.append(fits)
                so_far.append(used)
            yield pd.DataFrame({"account": key[0], "call_no": held[start : start + CHUNK, 0], "accepted": accepted, "used": so_far})
        state.update((used,))

    return calls.groupBy("account").applyInPandasWithState(charge, "account bigint, call_no bigint, accepted boolean, used bigint", "used bigint", "append", GroupStateTimeout.NoTimeout)


def first_answers(answers: DataFrame, live: str = "30 days") -> DataFrame:
    """A stream of ``cache_key, recording_id, ts`` as a cache sees it: a row for each answer that had to be made.

    A key that was answered less than ``live`` ago is served from state; its time to live starts with the
    answer that was made, and state past it is dropped.
    """
    span = pd.Timedelta(live)

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = pd.Timestamp(state.get[0], unit="us", tz="UTC") if state.exists else None
        rows = pd.concat([batch[["recording_id", "ts"]] for batch in batches]).sort_values("ts", kind="stable")
        made = []
        for recording, at in rows.itertuples(index=False):
            at = at.tz_localize("UTC") if at.tzinfo is None else at
            if until is None or at >= until:
                until = at + span
                made.append((key[0], recording, at.tz_localize(None), until.tz_localize(None)))
        state.update((until.value // 1000,))
        state.setTimeoutTimestamp(max(until.value // 1_000_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(made, columns=["cache_key", "recording_id", "made_at", "expires_at"])

    watermarked = answers.withWatermark("ts", live)
    return watermarked.groupBy("cache_key").applyInPandasWithState(keep, "cache_key string, recording_id bigint, made_at timestamp, expires_at timestamp", "until bigint", "append", GroupStateTimeout.EventTimeTimeout)


def replay(stream: DataFrame, mode: str = "append") -> DataFrame:
    """A finite stream run to its end, its batches written to the shared checkpoint folder and read from there.

    In complete mode the last batch is the result.  A stream without rows gives an empty frame.
    """
    spark = stream.sparkSession
    at = f"{checkpoint_folder(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    last: list[int] = []

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
        last.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema).parquet(*(f"{at}/out/batch={n}" for n in (dict.fromkeys(last) if mode == "append" else last[-1:])))
    return rows
