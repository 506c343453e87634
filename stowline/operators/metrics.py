"""Host resource metrics of runs: file selection, usage by interval, attribution to run steps.

Tables: ``metrics (host, ts, metric, value)``, ``steps (host, step, start)``, ``hardware (host, …)`` and raw
metric files ``(host, name, size, mtime)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowline.operators import skew
from stowline.session import cut_lineage

LOG_LINE = r"^\[([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+)Z?\]\s+([^\s:]+):"


def log_times(lines: DataFrame, line: str = "value") -> DataFrame:
    """Time and host of every well-formed run-log line ``[<time>] <host>: <text>``."""
    time = F.nullif(F.regexp_extract(line, LOG_LINE, 1), F.lit(""))
    host = F.nullif(F.regexp_extract(line, LOG_LINE, 2), F.lit(""))
    return lines.select(F.to_timestamp_ntz(time).alias("ts"), host.alias("host")).filter(F.col("ts").isNotNull())


def log_hosts(lines: DataFrame, line: str = "value") -> DataFrame:
    """Distinct hosts named by a run log."""
    return log_times(lines, line).filter(F.col("host").isNotNull()).select("host").distinct()


def run_frame(lines: DataFrame, line: str = "value") -> DataFrame:
    """First and last time of a run log, as one row ``(run_start, run_end)``."""
    return log_times(lines, line).agg(F.min("ts").alias("run_start"), F.max("ts").alias("run_end"))


def in_run_frame(files: DataFrame, frame: DataFrame, first: str = "first_ts", last: str = "mtime",
                 day: str | None = None, span_days: int | None = None) -> DataFrame:
    """Files whose time interval overlaps the run.

    The frame is read by scalar subqueries, so the condition is an ordinary scan filter. ``day`` names a
    partition column, the day of ``last``, to prune by: a file that overlaps the run ends on its first day or
    later. It may end after the run, so days have no upper bound unless ``span_days`` says how many days a file
    spans at most.
    """
    start, end = frame.select("run_start").scalar(), frame.select("run_end").scalar()
    kept = files.filter((F.col(last) >= start) & (F.col(first) <= end))
    if day is not None:
        kept = kept.filter(F.col(day) >= F.to_date(start))
        if span_days is not None:
            kept = kept.filter(F.col(day) <= F.date_add(F.to_date(end), span_days))
    return kept


def changed_files(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote files with no local copy of equal name, size and time."""
    keys = ["host", "name", "size", "mtime"]
    return remote.join(local.select(*keys).distinct(), keys, "left_anti")


def _stats() -> list[Column]:
    return [F.count("value").alias("n"), F.min("value").alias("lowest"), F.avg("value").alias("mean"),
            F.max("value").alias("highest")]


def interval_stats(metrics: DataFrame, width: str = "1 hour", slide: str | None = None, *extra: Column) -> DataFrame:
    """Count, minimum, mean and maximum per host, metric and time window; works on streams too."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    stats = metrics.groupBy(window.alias("w"), "host", "metric").agg(*_stats(), *extra)
    return stats.select("host", "metric", F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                        *[c for c in stats.columns if c not in ("w", "host", "metric")])


def usage_by_interval(metrics: DataFrame, width: str = "1 hour", group_rows: int | None = None) -> DataFrame:
    """Count, minimum, mean and maximum per host, metric and time window, and the exact 95th percentile.

    The input is read once, into counts of equal values, which are checkpointed. While no group has more than
    ``group_rows`` different values, the percentile comes from these; beyond that from :func:`skew.exact_quantiles`,
    which splits large groups.
    """
    group_rows = skew.GROUP_ROWS if group_rows is None else group_rows
    keys = ["host", "metric", "start"]
    marked = metrics.withColumn("_w", F.window("ts", width)).withColumn("start", F.col("_w.start")).withColumn("end", F.col("_w.end"))
    values = cut_lineage(marked.groupBy(*keys, "end", "value").agg(F.count("value").alias("_c")))
    stats = [F.sum("_c").alias("n"), F.min("value").alias("lowest"), (F.sum(F.col("value") * F.col("_c")) / F.sum("_c")).alias("mean"),
             F.max("value").alias("highest")]
    largest = values.groupBy(*keys).agg(F.count("value").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= group_rows:
        p95 = F.percentile("value", F.lit(0.95), F.col("_c")).alias("p95")
        return values.groupBy(*keys, "end").agg(*stats, p95).select("host", "metric", "start", "end", "n", "lowest", "mean", "highest", "p95")
    p95 = cut_lineage(skew.exact_quantiles(marked, keys, "value", {"p95": 0.95}, group_rows))
    rows = values.groupBy(*keys, "end").agg(*stats).select("host", "metric", "start", "end", "n", "lowest", "mean", "highest")
    return skew.null_safe_join(rows, p95, keys, "left", skew.fits_broadcast(p95))


def _micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 without going through the session time zone."""
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
    return F.unix_micros(ts)


def attribute_steps(metrics: DataFrame, steps: DataFrame, bucket_seconds: int = 3600,
                    split_rows: int | None = None) -> DataFrame:
    """The step each metric row falls into: the latest step of its host that started at or before ``ts``.

    Rows and steps are cut into time buckets per host, so neither a busy host nor a long run is handled by
    one task, and rows are never paired with all steps of their host. The step running at the start of a
    bucket is found from one row per bucket and enters the bucket as its first step. A bucket with more
    than ``split_rows`` rows and steps is cut into equal time slices first. Of steps that start at one instant only the last
    counts. Rows of one instant all get one answer: more than ``split_rows`` of them are one row while steps are sought,
    and are then given its step where they are, by a broadcast of at most rows / ``split_rows`` instants.
    """
    split_rows = skew.HOT_ROWS if split_rows is None else split_rows
    width = bucket_seconds * 1_000_000
    rows = metrics.withColumn("_us", _micros(metrics, "ts"))
    instants = cut_lineage(rows.groupBy("host", "_us").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > split_rows).select("host", "_us"))
    if instants.isEmpty():
        return _attribute(rows, steps, width, split_rows).select(*metrics.columns, "step", "step_start")
    crowd = instants.withColumn("_crowd", F.lit(True))
    marked = skew.null_safe_join(rows, crowd, ["host", "_us"], "left", spread_right=skew.fits_broadcast(crowd))
    rest = _attribute(marked.filter("_crowd IS NULL").drop("_crowd"), steps, width, split_rows)
    known = cut_lineage(_attribute(instants, steps, width, split_rows).select("host", "_us", "step", "step_start"))
    many = skew.null_safe_join(marked.filter("_crowd").drop("_crowd"), known, ["host", "_us"], "left", spread_right=skew.fits_broadcast(known))
    columns = [*metrics.columns, "step", "step_start"]
    return rest.select(*columns).unionByName(many.select(*columns))


def _attribute(rows: DataFrame, steps: DataFrame, width: int, split_rows: int) -> DataFrame:
    """``rows`` (with ``_us``) and their ``step, step_start``; no instant has more than ``split_rows`` rows."""
    columns = rows.columns
    rows = rows.withColumn("_bucket", F.floor(F.col("_us") / width))
    marks = steps.select("host", F.col("step").alias("_step"), F.col("start").alias("_start"), _micros(steps, "start").alias("_us"))
    marks = marks.groupBy("host", "_us").agg(F.max(F.struct("_start", "_step")).alias("_m")).select(
        "host", "_us", "_m._start", "_m._step", F.floor(F.col("_us") / width).alias("_bucket"))
    both = rows.select("host", "_bucket").unionByName(marks.select("host", "_bucket"))
    crowded = (
        both.groupBy("host", "_bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > split_rows)
        .select("host", "_bucket", F.ceil(F.col("_n") / split_rows).alias("_slices"))
    )
    if not crowded.isEmpty():
        slices = F.coalesce(F.col("_slices"), F.lit(1))
        part = F.floor((F.col("_us") - F.col("_bucket") * width) * slices / width)
        rows = skew.checked_join(rows, crowded, ["host", "_bucket"], "left").withColumn("_slice", part).drop("_slices")
        marks = skew.checked_join(marks, crowded, ["host", "_bucket"], "left").withColumn("_slice", part).drop("_slices")
    else:
        rows, marks = rows.withColumn("_slice", F.lit(0).cast("long")), marks.withColumn("_slice", F.lit(0).cast("long"))
    cell = ["host", "_bucket", "_slice"]
    step_value = F.struct(F.col("_start"), F.col("_step"))
    # One row per cell with its last step (null for cells without one); cells per host are bounded by time.
    ends = (
        rows.select(*cell).distinct().withColumn("_last", F.lit(None).cast(marks.select(step_value.alias("s")).schema["s"].dataType))
        .unionByName(marks.groupBy(*cell).agg(F.max(step_value).alias("_last")))
        .groupBy(*cell).agg(F.max("_last").alias("_last"))
    )
    before = Window.partitionBy("host").orderBy("_bucket", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*cell, F.last("_last", ignorenulls=True).over(before).alias("_s")).filter("_s is not null")
    # Order inside a cell: the carried step, then by time; at equal times steps precede the rows they cover.
    events = (
        rows.withColumn("_s", F.lit(None).cast(carried.schema["_s"].dataType)).withColumn("_at", F.col("_us")).withColumn("_turn", F.lit(1))
        .unionByName(marks.select(*cell, step_value.alias("_s"), F.col("_us").alias("_at"), F.lit(0).alias("_turn")), True)
        .unionByName(carried.select(*cell, "_s", F.lit(-(2**62)).alias("_at"), F.lit(0).alias("_turn")), True)
    )
    so_far = Window.partitionBy(*cell).orderBy("_at", "_turn", "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tagged = events.withColumn("_now", F.last("_s", ignorenulls=True).over(so_far)).filter("_turn = 1")
    return tagged.select(*columns, F.col("_now._step").alias("step"), F.col("_now._start").alias("step_start"))


def with_hardware(metrics: DataFrame, hardware: DataFrame) -> DataFrame:
    """Add the hardware totals of each row's host; hosts without an entry keep nulls."""
    return skew.checked_join(metrics, hardware, ["host"], "left")


def step_ends(steps: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Steps with their end, the start of the host's next step; the last step stays open.

    Hosts up to ``group_rows`` steps use an ordinary window. When a larger one exists, steps are cut into slices by a
    range partitioning on (host, start, step): the last step of a slice ends where the host's next slice begins.
    """
    group_rows = skew.GROUP_ROWS if group_rows is None else group_rows
    seen = steps.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("all")).first()
    order = ["start", "step"]
    if (seen["top"] or 0) <= group_rows:
        return steps.withColumn("end", F.lead("start").over(Window.partitionBy("host").orderBy(*order)))
    slices = max(int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(seen["all"]) // group_rows))
    # The slice of a row must not change when a lost task runs again, hence the checkpoint.
    sliced = cut_lineage(steps.repartitionByRange(slices, "host", *order).withColumn("_slice", F.spark_partition_id()))
    first = F.min(F.struct(F.col("start").isNotNull().alias("none"), "start")).alias("_first")
    carry = cut_lineage(sliced.groupBy("host", "_slice").agg(first).select(
        "host", "_slice", F.lead("_first").over(Window.partitionBy("host").orderBy("_slice")).alias("_carry")))
    # A struct tells the end of a slice from a null start.
    inside = F.lead(F.struct("start")).over(Window.partitionBy("host", "_slice").orderBy(*order))
    joined = skew.null_safe_join(sliced.withColumn("_next", inside), carry, ["host", "_slice"], spread_right=skew.fits_broadcast(carry))
    end = F.when(F.col("_next").isNotNull(), F.col("_next.start")).otherwise(F.col("_carry.start"))
    return joined.select(*steps.columns, end.alias("end"))


def usage_by_step(attributed: DataFrame) -> DataFrame:
    """Usage per step and metric over attributed rows; rows before the first step form their own group."""
    return attributed.groupBy("step", "metric").agg(
        F.count("value").alias("n"), F.count_distinct("host").alias("hosts"), F.min("value").alias("lowest"),
        F.avg("value").alias("mean"), F.max("value").alias("highest"))
