"""File sources and sinks: sample sheets, resource definitions, location tables, raw metrics, logs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline.functions import paths as P
from stowline.sources.inventory import scan_files

try:  # YAML input is optional, JSON input needs nothing
    import yaml
except ImportError:
    yaml = None


def _to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["json"] = [json.dumps(yaml.safe_load(text), default=str) for text in batch["value"]]
        yield batch[["path", "json"]]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON or YAML file: ``(path, json)``. Files are spread over tasks.

    A YAML file is an error when no YAML reader is installed.
    """
    text = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    named = text.select(F.regexp_replace(F.input_file_name(), r"^file:/+", "/").alias("path"), "value")
    plain = named.filter(F.col("path").endswith(".json")).select("path", F.col("value").alias("json"))
    marked = named.filter(F.col("path").rlike(r"\.ya?ml$"))
    if yaml is None:
        missing = F.raise_error(F.concat(F.lit("no YAML reader is installed to read "), F.col("path"))).cast("string")
        return plain.unionByName(marked.select("path", missing.alias("json")))
    return plain.unionByName(marked.mapInPandas(_to_json, "path string, json string"))


def sheet_samples(documents: DataFrame, json: str = "json") -> DataFrame:
    """Sample sheets ``(path, json)`` → one row per ``details`` element.

    Returns ``(path, pos, sample, sheet)``: the sample as JSON text, and the sheet-level settings.
    """
    keys = F.filter(F.json_object_keys(json), lambda k: k != "details")
    whole = F.from_json(json, "map<string,string>")
    sheet = F.to_json(F.map_filter(whole, lambda k, _: F.array_contains(keys, k)))
    details = F.from_json(F.get_json_object(json, "$.details"), "array<string>")
    return documents.select("path", F.posexplode(details).alias("pos", "sample"), sheet.alias("sheet"))


def resource_values(documents: DataFrame, json: str = "json") -> DataFrame:
    """Two-level resource definitions → ``(path, k1, k2, value)``."""
    outer = documents.select("path", F.explode(F.from_json(json, "map<string,string>")).alias("k1", "_inner"))
    return outer.select("path", "k1", F.explode(F.from_json("_inner", "map<string,string>")).alias("k2", "value"))


def genome_folders(lines: DataFrame) -> DataFrame:
    """Reference folders named by location tables ``(file, line_no, value)``.

    Only ``index`` lines count, the last line per build wins, only relative values stay. The folder is
    three levels above the value, seen from the table's own folder. Distinct; order by ``folder``.
    """
    fields = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    rows = lines.filter(F.col("value").startswith("index")).select(
        "file", "line_no", F.element_at(fields, 2).alias("build"), F.element_at(fields, -1).alias("target"))
    last = rows.groupBy("file", "build").agg(F.max_by("target", "line_no").alias("target"))
    up = P.dirname(P.dirname(P.dirname("target")))
    return (
        last.filter((F.col("target") != "") & ~F.col("target").startswith("/"))
        .select("file", P.normalize(P.join_path(P.dirname("file"), up)).alias("folder"))
        .distinct()
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``(file, line_no, value)``; a whole file is one row until its lines are split."""
    text = spark.read.option("wholetext", "true").text(path)
    return text.select(
        F.regexp_replace(F.input_file_name(), r"^file:/+", "/").alias("file"),
        F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def parse_stat_lines(lines: DataFrame) -> DataFrame:
    """Collected ``size mtime name`` lines ``(host, value)`` → ``(host, name, size, mtime)``."""
    fields = F.split(F.trim("value"), r"\s+")
    return lines.filter(F.trim("value") != "").select(
        "host", F.element_at(fields, 3).alias("name"), F.element_at(fields, 1).cast("long").alias("size"),
        F.timestamp_seconds(F.element_at(fields, 2).cast("long")).alias("mtime"))


def scan_raw_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Raw metric files landed as ``<root>/<host>/<file>``: ``(host, name, size, mtime, path)``."""
    return scan_files(spark, root).select(
        P.basename(P.dirname("path")).alias("host"), P.basename("path").alias("name"), "size", "mtime", "path")


def write_series(series: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist a metric series in day folders, so that run windows prune folders.

    Rows are range-partitioned and sorted by day, host and time: a file holds a narrow range of hosts,
    which its statistics prune, and a busy host is spread over several files. Host folders would mean
    hosts × days tiny files.
    """
    order = ["day", "host", "ts"]
    dated = series.withColumn("day", F.to_date("ts"))
    dated.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("day").parquet(path)


def write_raw_files(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store raw files ``(host, name, size, mtime, …)`` in folders of the day of ``mtime``, for ``metrics.in_run_frame``."""
    order = ["day", "host", "mtime"]
    dated = files.withColumn("day", F.to_date("mtime"))
    dated.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("day").parquet(path)


def ready_path(sheet: str) -> str:
    """Where the normalised form of a sheet goes: next to it, marked ``-ready``."""
    stem, dot, ext = sheet.rpartition(".")
    return f"{stem}-ready.{ext}" if dot and "/" not in ext else f"{sheet}-ready"


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write records (one JSON document per row) as JSON lines."""
    records.select(F.col("json").alias("value")).write.mode(mode).text(path)
