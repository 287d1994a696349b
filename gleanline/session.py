"""Session settings and the few helpers every operator needs."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(master).appName("gleanline").config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where the setting is unset."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"gleanline-{os.getuid()}")
        os.makedirs(folder, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` materialised in the shared checkpoint folder: computed once, and kept when an executor is lost."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def dealt(frame: DataFrame, *keys: str) -> DataFrame:
    """``frame`` in partitions by ``keys``, as many as a shuffle has."""
    spark = frame.sparkSession
    return frame.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def placed(frame: DataFrame) -> DataFrame:
    """As ``cut``, and later steps know by which keys its partitions were ``dealt``.

    Steps that group by these keys and others, join by just them or number rows within them then shuffle nothing.
    Adaptive execution forgets by what a checkpoint is divided, so it is off while this one is made.
    """
    spark = frame.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(frame)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def merged(frame: DataFrame) -> DataFrame:
    """``frame`` as a side of a join by sorting, never sent whole to every worker.

    Sizes are estimated from the bytes of the compressed files, so a side made of their texts (lines, cells,
    characters) seems small enough to be broadcast when it is far larger than the driver's memory.
    """
    return frame.hint("merge")


def spread(frame: DataFrame) -> DataFrame:
    """``frame`` over all cores where a small input came in fewer partitions than there are; otherwise as it is.

    Narrow steps keep their input's partitions, so one small file would be worked on by one core.  Results of a
    shuffle stay as they are; counting partitions of anything else starts no job.
    """
    if frame._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return frame
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once a session, so that they need no installation of it."""
    context = spark.sparkContext
    if getattr(context, "_gleanline", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    packed = os.path.join(tempfile.mkdtemp(prefix="gleanline-"), "gleanline.zip")
    with zipfile.ZipFile(packed, "w") as file:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    file.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(packed)
    context._gleanline = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a test-data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
