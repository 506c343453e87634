"""Joins and per-group numbering that hold when one key carries a large share of all rows.

Two rules are used throughout the package:

* a side is broadcast only after its rows and bytes were counted (``fits_broadcast``);
* a hot key is split over many tasks (``skew_join`` salts it, ``number_in_group`` range-slices it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowline.session import cut_lineage

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
HOT_ROWS = 2_000_000
GROUP_ROWS = 5_000_000
HOT_KEYS = 500_000


def fits_broadcast(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Count at most ``rows + 1`` rows of ``df`` and say whether it is small enough to broadcast."""
    rows = BROADCAST_ROWS if rows is None else rows
    size = BROADCAST_BYTES if size is None else size
    if rows <= 0:
        return False
    width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    # Rows are counted first, without their columns. Widths are taken before the limit, which brings its rows to one task.
    if df.select(F.lit(1)).limit(rows + 1).count() > rows:
        return False
    seen = df.select(width.alias("_w")).limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("b")).first()
    return seen["n"] <= rows and (seen["b"] or 0) <= size


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", spread_right: bool = False) -> DataFrame:
    """Join in which null keys are equal. ``spread_right`` broadcasts ``right``; its size must have been checked."""
    other = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}") if c in on else F.col(f"`{c}`") for c in right.columns])
    match = F.lit(True)
    for c in on:
        match = match & left[c].eqNullSafe(other[f"_r_{c}"])
    return left.join(F.broadcast(other) if spread_right else other, match, how).drop(*[f"_r_{c}" for c in on])


def checked_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
                 small_fits: bool | None = None) -> DataFrame:
    """Broadcast ``small`` when its counted size allows it, otherwise use ``skew_join``.

    ``big`` is broadcast instead if it turns out to be the smaller one and the join is an inner one.
    """
    if fits_broadcast(small) if small_fits is None else small_fits:
        return big.join(F.broadcast(small), list(on), how)
    return skew_join(big, small, on, how, either=True)


def skew_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
              hot_rows: int | None = None, either: bool = False) -> DataFrame:
    """Shuffle join that spreads every key of ``big`` with more than ``hot_rows`` rows.

    A hot key gets one salt per ``hot_rows`` rows; the matching rows of ``small`` are repeated once per
    salt, so inner, left, semi and anti joins all keep their meaning. The salt is a row number, so that equal rows are
    spread as well; rows of hot keys are checkpointed with it, because a task that runs again must not deal them
    otherwise. There are at most ``rows(big) / hot_rows`` hot keys, counted once with a map-side combine; if
    even these are too many to broadcast, a key must have twice as many rows to count as hot, and so on. Rows whose key
    has a null match nothing: they skip the shuffle.

    The plain join is a merge join by hint. Without it Spark broadcasts ``small`` by a guess made from the size of the
    compressed file that it comes from, which can be a hundredth of what the driver would have to hold. With ``either`` a ``big``
    that may be broadcast is, in an inner join.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    on, how = list(on), how.replace("_", "").lower()
    no_null = F.lit(True)
    for c in on:
        no_null = no_null & F.col(f"`{c}`").isNotNull()
    whole, big = big, big.filter(no_null)
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    seen = counts.agg(F.max("_rows").alias("top"), F.sum("_rows").alias("all")).first()
    salts = None
    if (seen["top"] or 0) > hot_rows:
        hot = cut_lineage(counts.filter(F.col("_rows") > hot_rows))
        while True:
            salts = hot.select(*on, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_salts"))
            if fits_broadcast(salts, HOT_KEYS):
                break
            hot_rows *= 2
            hot = hot.filter(F.col("_rows") > hot_rows)
        salts = None if hot.isEmpty() else salts
    small = small.hint("merge")
    if salts is None:
        if either and how == "inner" and (seen["all"] or 0) <= BROADCAST_ROWS and fits_broadcast(big):
            big = F.broadcast(big)
        joined = big.join(small, on, how)
    else:
        hot = F.broadcast(salts)
        salted = big.join(hot, on).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.col("_salts")).cast("int"))
        spread = small.join(hot, on).hint("merge").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
        joined = big.join(hot, on, "left_anti").join(small, on, how).unionByName(
            cut_lineage(salted.drop("_salts")).join(spread.drop("_salts"), [*on, "_salt"], how).drop("_salt"))
    if how in ("left", "leftouter", "leftanti", "anti"):
        joined = joined.unionByName(whole.filter(~no_null), allowMissingColumns=True)
    return joined


def number_in_group(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "n",
                    group_rows: int | None = None) -> DataFrame:
    """Number the rows of each group 0, 1, 2, … in the order of ``order``.

    Groups up to ``group_rows`` rows use an ordinary window. When a larger group exists the rows are cut
    into slices by a range partitioning on (group, order); each slice is numbered on its own and shifted
    by the rows of the group in earlier slices, so no task sees a whole hot group.
    """
    group_rows = GROUP_ROWS if group_rows is None else group_rows
    by, order = list(by), list(order)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    seen = sizes.agg(F.max("_n").alias("top"), F.sum("_n").alias("all")).first()
    if (seen["top"] or 0) <= group_rows:
        window = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("long") - 1)
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(shuffle, -(-int(seen["all"]) // group_rows))
    # The slice of a row must not change when a lost task runs again, hence the checkpoint.
    sliced = cut_lineage(
        df.repartitionByRange(slices, *by, *order).withColumn("_slice", F.spark_partition_id())
    )
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        sliced.groupBy(*by, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    within = Window.partitionBy(*by, "_slice").orderBy(*order)
    placed = sliced.withColumn("_pos", F.row_number().over(within).cast("long") - 1)
    shift = cut_lineage(shift)
    return (
        null_safe_join(placed, shift, [*by, "_slice"], spread_right=fits_broadcast(shift))
        .withColumn(name, F.col("_pos") + F.col("_shift"))
        .drop("_pos", "_shift", "_slice")
    )


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, points: dict[str, float],
                    group_rows: int | None = None) -> DataFrame:
    """Exact interpolated quantiles per group, whatever the group size.

    Groups up to ``group_rows`` rows (counted first) are finished by ``percentile`` over merged equal
    values. When a larger group exists, rows get a skew-safe rank and those at the wanted ranks are kept.
    """
    group_rows = GROUP_ROWS if group_rows is None else group_rows
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= group_rows:
        merged = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
        return merged.groupBy(*by).agg(
            *[F.percentile("_v", F.lit(q), F.col("_c")).alias(n) for n, q in points.items()]
        )
    last = cut_lineage(sizes.select(*by, (F.col("_n") - 1).cast("double").alias("_last")))
    ranked = null_safe_join(number_in_group(rows, by, ["_v"], "_rank", group_rows), last, by, spread_right=fits_broadcast(last))
    out = []
    for n, q in points.items():
        spot = F.col("_last") * F.lit(q)
        low = F.max(F.when(F.col("_rank") == F.floor(spot), F.col("_v")))
        high = F.max(F.when(F.col("_rank") == F.ceil(spot), F.col("_v")))
        below, above = F.max(F.ceil(spot) - spot), F.max(spot - F.floor(spot))
        out.append(F.when(F.max(F.ceil(spot)) == F.max(F.floor(spot)), low).otherwise(low * below + high * above).alias(n))
    return ranked.groupBy(*by).agg(*out)
