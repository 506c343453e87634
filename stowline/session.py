"""Session helpers: local sessions for tests and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "stowline", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    cpus = cpus or os.cpu_count() or 8
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_ready(spark: SparkSession) -> None:
    """Make sure ``checkpoint()`` has a folder that outlives an executor.

    The folder comes from ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder: on a cluster that folder would vanish with its machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stowline-checkpoint-")
    context.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` so later plans neither recompute it nor see it change."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint()
