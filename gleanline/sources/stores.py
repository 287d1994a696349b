"""Readers and writers: whole texts, JSON lines, day partitions, tables, reports, budgets."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEED_SCHEMA = "recording_mbid string, title string, version string, artist string, artists array<struct<name: string, mbid: string, join: string>>, isrc string, isrcs array<string>, duration_ms double, release_mbid string, release_title string, release_date string, tags array<string>"
EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@dataclass(frozen=True)
class Job:
    """One day of one environment, and the payload fields to add up."""

    day: str
    env: str
    fields: tuple[str, ...] = ()


Source = Callable[[SparkSession, Job], DataFrame]
Sink = Callable[[DataFrame], None]


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text``: a file a row, by path; missing files are an error, empty ones empty texts."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str | StructType = SEED_SCHEMA) -> DataFrame:
    """Rows of a JSON lines file by an explicit schema; blank lines are skipped, a broken one stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(rows: DataFrame, path: str, order: str) -> None:
    """Rows in order, fields in the frame's order, range-partitioned so that no task sorts everything."""
    rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def day_partition(path: str) -> Source:
    """Source of one environment's day: partition filters reach the scan."""
    return lambda spark, job: spark.read.parquet(path).where((F.col("env") == job.env) & (F.col("occurred_on") == F.lit(job.day).cast("date")))


def day_sink(path: str) -> Sink:
    """Sink that overwrites just the partitions it is given, so a rerun replaces its day."""
    return lambda rows: rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("env", "occurred_on").parquet(path)


def run_day(spark: SparkSession, job: Job, source: Source, sink: Sink) -> None:
    """The daily job: read, check, roll up, write; a wrong day or environment in the source stops it before anything is written."""
    from gleanline.operators.rollup import daily_rollup

    rows = source(spark, job)
    right = (F.col("env") == job.env) & (F.col("occurred_on") == F.lit(job.day).cast("date"))
    checked = rows.withColumn("env", F.when(right, F.col("env")).otherwise(F.raise_error(F.lit("row of another day or environment")).cast("string")))
    sink(daily_rollup(checked, list(job.fields)))


def rollup_ddl(name: str, location: str) -> str:
    """Statement for the external table over the roll-up's files."""
    return f"CREATE TABLE IF NOT EXISTS {name} (event_type STRING, events BIGINT, sum_k BIGINT, env STRING, occurred_on DATE) USING parquet PARTITIONED BY (env, occurred_on) LOCATION '{location}'"


def canonical_json(*columns: Column | str) -> Column:
    """One JSON object a row with its keys in order."""
    names = sorted(c if isinstance(c, str) else c._jc.toString() for c in columns)
    return F.to_json(F.struct(*names))


def number_map(raw: Column) -> Column:
    """A JSON object of finite numbers as a map; null if it is anything else."""
    parsed = F.from_json(raw, "map<string,double>", {"mode": "PERMISSIVE"})
    finite = F.forall(F.map_values(parsed), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(parsed.isNotNull() & finite, parsed)


def report_rows(lines: DataFrame, columns: int = 12) -> DataFrame:
    """Cells of a Markdown table's rows with at least ``columns`` of them: ``engine, class`` and ``numbers``.

    Percentages become shares; cells that are no numbers are null.
    """
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(F.regexp_replace(c, r"\(best case\)", "")))
    shape = r"^(-?\d+(?:\.\d+)?)(%?)$"
    number = lambda c: F.when(c.rlike(shape), F.regexp_extract(c, shape, 1).cast("double") / F.when(F.regexp_extract(c, shape, 2) == "%", 100.0).otherwise(1.0))
    rows = lines.select(cells.alias("cells")).where((F.size("cells") >= columns) & ~F.element_at("cells", 1).rlike(r"^:?-+:?$"))
    return rows.select(F.element_at("cells", 1).alias("engine"), F.element_at("cells", 2).alias("class"), F.transform(F.slice("cells", 3, columns), number).alias("numbers"))


def report_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A Markdown line a row, doubles with two decimals; the caller writes header and order."""
    kinds = dict(rows.dtypes)
    cells = [F.format_string("%.2f", c) if kinds[c] == "double" else F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


class Progress:
    """Resume state of a long walk, in one small file: what is complete, and where the walk is."""

    def __init__(self, path: str):
        self.path = path

    def read(self) -> dict:
        """The state; empty where there is none."""
        if not os.path.exists(self.path):
            return {"completed": [], "in_flight": None}
        with open(self.path, encoding="utf-8") as file:
            return json.load(file)

    def write(self, completed: list[str], in_flight: dict | None) -> None:
        """The state replaced in one step."""
        with open(f"{self.path}.new", "w", encoding="utf-8") as file:
            json.dump({"completed": completed, "in_flight": in_flight}, file, sort_keys=True)
        os.replace(f"{self.path}.new", self.path)

    def clear(self) -> None:
        """No state, as after success."""
        if os.path.exists(self.path):
            os.remove(self.path)


def yaml_budget(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Limits and their shares from a budget file: ``limit_name, scope, basis, total`` and ``limit_name, env, allowance``."""
    import yaml

    with open(path, encoding="utf-8") as file:
        raw = yaml.safe_load(file)
    limits, splits = [], []
    for group, scope in (("limits", "own"), ("provider_limits", "provider")):
        for name, entry in (raw.get(group) or {}).items():
            basis = entry.get("basis", "monthly")
            if basis not in ("monthly", "per_day", "per_second", "fixed"):
                raise ValueError(f"{name}: unknown basis {basis}")
            limits.append((name, scope, basis, float(entry["total"])))
            splits += [(name, env, float(share)) for env, share in entry["split"].items()]
    return spark.createDataFrame(limits, "limit_name string, scope string, basis string, total double"), spark.createDataFrame(splits, "limit_name string, env string, allowance double")


def paired_readings(truths: DataFrame, readings: DataFrame, key: str = "image_id") -> DataFrame:
    """Readings of images that the manifest knows.  No reading at all is an error, not a pass."""
    known = readings.join(truths.select(key).distinct(), key, "left_semi")
    if known.isEmpty():
        raise ValueError("no readings for any image of the manifest")
    return known


def schema_drift(frame: DataFrame, snapshot: str) -> list[str]:
    """Differences between a frame's schema and a snapshot of one (its JSON), field by field; none for equal ones."""
    kept = {f["name"]: f for f in json.loads(snapshot)["fields"]}
    now = {f["name"]: f for f in json.loads(frame.schema.json())["fields"]}
    said = [f"{name} is gone" for name in kept if name not in now] + [f"{name} is new" for name in now if name not in kept]
    return said + [f"{name} has changed" for name in now if name in kept and (now[name]["type"], now[name]["nullable"]) != (kept[name]["type"], kept[name]["nullable"])]
