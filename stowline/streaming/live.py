"""Structured Streaming jobs: incremental metric-file ingest and live usage windows."""

from __future__ import annotations

import threading

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from stowline.operators.metrics import interval_stats
from stowline.operators.skew import null_safe_join

FILE_KEYS = ["host", "name", "size", "mtime"]


def open_stream(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """A parquet file stream over a landing folder."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def new_versions(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """File versions seen for the first time; a changed size or time is a new version.

    State is bounded by the watermark on ``mtime``: a version older than ``delay`` is forgotten.
    """
    return stream.withWatermark("mtime", delay).dropDuplicatesWithinWatermark(FILE_KEYS)


def ingest_changed(stream: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append file versions that ``target`` does not hold yet, without keeping stream state.

    Every micro-batch owns the folder ``run=<query id>/batch=<id>`` below ``target``, cut into days of ``mtime``. The query id
    lives in the checkpoint, so a batch that runs again after a failure replaces its own rows, and a new checkpoint
    over an old target adds to it. A batch is compared with the rows of its own days only (and of the null day), so that
    its cost does not grow with the history. Nulls are equal: a file without host or time is written once.
    """
    started, own = threading.Event(), {}

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        started.wait()
        fresh = batch.dropDuplicates(FILE_KEYS).withColumn("day", F.to_date("mtime"))
        days = fresh.agg(F.min("day"), F.max("day")).first()
        schema = StructType([batch.schema[c] for c in FILE_KEYS]).add("run", "string").add("batch", "long").add("day", "date")
        try:
            known = spark.read.schema(schema).parquet(target)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            others = (F.col("run") != own["id"]) | (F.col("batch") != batch_id)
            # Files without a time have a day of their own, the null one.
            same_days = F.col("day").isNull() if days[0] is None else F.col("day").between(*days) | F.col("day").isNull()
            fresh = null_safe_join(fresh, known.filter(others & same_days).select(*FILE_KEYS), FILE_KEYS, "left_anti")
        fresh.write.mode("overwrite").partitionBy("day").parquet(f"{target}/run={own['id']}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    own["id"] = str(query.id)
    started.set()
    return query


def live_usage(stream: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Usage per host, metric and window over a stream; a window is final ``delay`` after its end."""
    zoneless = stream.schema["ts"].dataType.typeName() == "timestamp_ntz"
    # Event time must carry a zone; a zoneless time is read in the session zone and turned back.
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")) if zoneless else stream
    usage = interval_stats(timed.withWatermark("ts", delay), width, slide)
    if not zoneless:
        return usage
    return usage.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def write_usage(usage: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append final windows to a parquet table."""
    writer = usage.writeStream.format("parquet").outputMode("append").option("path", target).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
