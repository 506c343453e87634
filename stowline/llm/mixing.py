"""Mixing sources to target weights by capped water-filling.

Sizes are words (``[^\\x20\\x09-\\x0D]+``; null text has none). Sources share the budget by weight, a source stops
at ``max_epochs`` times its size, and what it leaves is shared by weight among the rest until none is above.
Each document is then taken ``floor(target / size)`` times, and the fractional rest by a seeded draw.

The draw is stratified, so that small sources come near their targets too: documents fall into ``STRATA`` strata
by a seeded hash of their id; whole strata are taken up to the target, and the stratum that the target cuts is
drawn row by row. Only sums per (source, stratum) are shuffled, and texts are never. A hot source is partially
summed before the shuffle and never gathered.

Null sources are one source, the last. A document without words, or of a source without words, is taken 0 times.
Equal ids draw alike, except where so many meet in the cut stratum that it is heavy: there the row's place in the
scan decides as well. An empty table gives an empty result. ``_``-prefixed columns are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowline.llm.common import cut, lookup_join, row_key

STRATA = 4096
SEED = 17


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hex(seed: str, key: Column, start: int, digits: int) -> Column:
    """A number from ``digits`` hex digits of a seeded hash of ``key``."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def cycle_weights(sources: DataFrame, weights=(1, 2, 3)) -> DataFrame:
    """Weigh sources by code point, null last, with ``weights`` again and again. The list of sources is sorted in one task."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int")))


def water_level(sources: DataFrame, budget: float, max_epochs: float) -> float:
    """The level L at which the sum of least(max_epochs * size, L * weight) is ``budget``, or the caps' sum if that is less.

    Each round clamps the sources that are above their cap at the present level and shares what is left.
    """
    level = None
    cap = F.col("source_size") * F.lit(max_epochs)
    while True:
        over = F.lit(False) if level is None else cap < F.lit(level) * F.col("weight")
        spent, free = sources.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            return level or 0.0
        now = (budget - spent) / free
        if level is not None and now <= level:
            return level
        level = now


def mix_plan(docs: DataFrame, weigh: Callable[[DataFrame], DataFrame] = cycle_weights, share: float = 1.0,
             max_epochs: float = 3.0, seed: int = SEED) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``times``: how often the mix takes each document.

    ``weigh`` adds ``weight`` to a table of (source, source_size); ``share`` of all sizes is the budget.
    """
    # The caller's columns travel in one struct, so that none can clash.
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "times")]
    rows = docs.select(F.struct(*names).alias("_kept"), "doc_id", "source", words().alias("size"), row_key().alias("_row"),
                       _hex(f"mix{seed}", F.col("doc_id"), 1, 3).alias("_stratum"))
    strata = cut(rows.groupBy("source", "_stratum").agg(F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_rows")))
    sources = cut(weigh(strata.groupBy("source").agg(F.sum("_size").alias("source_size"), F.sum("_rows").alias("_source_rows"))))
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = water_level(sources, budget, max_epochs)
    sources = sources.withColumn("target", F.least(F.col("source_size") * F.lit(max_epochs), F.col("weight") * F.lit(level)))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = cut(sources.withColumn("_whole", F.floor(ratio + 1e-9)).withColumn(
        "_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size"))))
    before = F.sum("_size").over(Window.partitionBy("source").orderBy("_stratum")) - F.col("_size")
    edges = strata.alias("s").join(sources.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        "s.*", "_rest", "_source_rows").withColumn("_before", before)
    edge = edges.where("_size > 0 AND _before <= _rest AND _rest < _before + _size").select(
        "source", F.col("_stratum").alias("_cut"), ((F.col("_rest") - F.col("_before")) / F.col("_size")).alias("_p"),
        (F.col("_rows") > 1000 + 8 * F.col("_source_rows") / STRATA).alias("_heavy"))
    plan = sources.alias("t").join(edge.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left").select(
        "t.source_size", "t.target", F.col("t._source_rows"), "_whole", "_cut", "_p", "_heavy",
        F.col("t.source").isNull().alias("_none"), F.coalesce("t.source", F.lit("")).alias("_source"))
    marked = rows.withColumns({"_none": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))})
    joined = lookup_join(marked, cut(plan), ["_none", "_source"], "_source_rows")
    draw = _hex(f"cut{seed}", F.when(F.col("_heavy"), F.concat_ws("/", F.col("doc_id").cast("string"), F.col("_row").cast("string")))
                .otherwise(F.col("doc_id").cast("string")), 1, 8) / F.lit(float(16 ** 8))
    extra = F.when(F.col("_stratum") < F.col("_cut"), 1).when((F.col("_stratum") == F.col("_cut")) & (draw < F.col("_p")), 1).otherwise(0)
    times = F.when(F.col("size") > 0, F.least(F.col("_whole") + extra, F.lit(int(max_epochs)))).otherwise(0).cast("int")
    return joined.withColumn("times", times).select(*(F.col("_kept").getField(c).alias(c) for c in names),
                                                    "size", "source_size", "target", "times")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns."""
    planned = mix_plan(docs.select(*(F.col(c).alias(f"c_{c}") for c in docs.columns), "doc_id", "source", "text"), **options)
    rows = planned.where("times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select(*(F.col(f"c_{c}").alias(c) for c in docs.columns))


def mix_report(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``."""
    plan = mix_plan(docs.select("doc_id", "source", "text")).drop("text")
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


#: The same rows in SQL: the level is that of the first source, by cap over weight, that stays below its cap.
REPORT_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix17:' || doc_id), 1, 3))::BIGINT AS stratum,
         ('0x' || substr(md5('cut17:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS draw FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1.0 AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () AS budget, 3.0 * source_size AS cap,
             sum(weight) OVER () - sum(weight) OVER (ORDER BY source_size / weight, source) + weight AS free,
             3.0 * (sum(source_size) OVER (ORDER BY source_size / weight, source) - source_size) AS spent FROM w),
l AS (SELECT max((budget - spent) / free) FILTER (WHERE (budget - spent) / free * weight <= cap) AS level FROM o),
t AS (SELECT source, source_size, least(cap, weight * level) AS target,
             floor(CASE WHEN source_size > 0 THEN least(cap, weight * level) / source_size ELSE 0 END + 1e-9) AS whole FROM o, l),
b AS (SELECT source, stratum, sum(size) AS size FROM d GROUP BY source, stratum),
e AS (SELECT b.source, b.stratum, b.size, greatest(0, target - whole * source_size) AS rest,
             sum(b.size) OVER (PARTITION BY b.source ORDER BY b.stratum) - b.size AS before
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
c AS (SELECT source, stratum AS edge, (rest - before) / size AS p FROM e WHERE size > 0 AND before <= rest AND rest < before + size)
SELECT doc_id, d.size::BIGINT AS size, source_size::BIGINT AS source_size, target::DOUBLE AS target,
       (CASE WHEN d.size = 0 THEN 0 ELSE d.size * least(3, whole + CASE WHEN stratum < edge OR (stratum = edge AND draw < p) THEN 1 ELSE 0 END)
        END)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""
