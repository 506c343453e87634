"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass 1 scatters whole records over memory-sized buckets by a seeded hash of their key. Pass 2 shuffles each bucket with
``shuffle()``, Spark's Fisher-Yates shuffle of an array, after sorting it, and writes it; each bucket is a Spark group of about
``bucket_rows`` rows and ``bucket_bytes`` bytes. The row's place in the concatenation of the shuffled buckets decides its shard: shards are
equal ranges of places, so that they differ by at most one row and slots have no gaps. A bucket falls into a few
shards only, so it is written from the task that shuffled it: a shard is a folder of files, each with a range of its slots.

Rows that share a key (or have none) would meet in one bucket. A bucket of more than twice its rows is overfull;
its rows are scattered again over all buckets by key and place in the scan. Equal texts need not share a shard:
one group may hold a third of all rows, which no shard could take.

A given input (same files and scan settings), seed and bucket count give the same shards again, also after a task is
recomputed: buckets are sorted before they are shuffled, and the partition count is fixed, so that each bucket
meets the same random numbers. An empty table gives an empty result; null text has no bytes. The caller's columns with the names
``shard`` and ``slot`` are replaced; others may have any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowline.llm.common import cut, row_key, task_numbers
from stowline.session import checkpoint_ready

SHARDS = 24
SEED = 29
#: Rows of a bucket at most, and bytes of the rows that are moved through it, on average.
BUCKET_ROWS = 50_000
BUCKET_BYTES = 32_000_000


def shuffled(rows: DataFrame, key: str, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
             bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``. All columns move through the shuffle; ``text`` decides their mean size, if there is one.

    ``rows`` must be a table scan or a checkpointed frame with columns that can be sorted.
    """
    size = F.octet_length("text") if "text" in rows.columns else F.lit(0)
    total, mean = rows.agg(F.count(F.lit(1)), F.avg(F.coalesce(size, F.lit(0)))).first()
    row_bytes = int(mean or 0) + 64
    per_bucket = max(1, min(bucket_rows, bucket_bytes // row_bytes))
    buckets = max(1, -(-total // per_bucket))
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    row = F.struct(*names)
    scattered = rows.select(row.alias("_row"), F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(buckets)).alias("_b"), row_key().alias("_at"))
    counts = cut(scattered.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")))
    full = counts.where(F.col("_n") > 2 * per_bucket).select("_b", F.lit(True).alias("_full"))
    again = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(f"_row.{key}"), F.col("_at")), F.lit(buckets))
    # At most one row per bucket; there are rows / per_bucket of them.
    scattered = scattered.join(F.broadcast(full), "_b", "left").withColumn("_b", F.when(F.col("_full"), again).otherwise(F.col("_b")))
    counts = cut(scattered.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")))
    starts = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_start"))
    # Each bucket goes to a task of its own; one row per bucket.
    numbers = task_numbers(rows.sparkSession, buckets).select(F.col("part").cast("long").alias("_b"), F.col("number").alias("_task"))
    dealt = scattered.join(F.broadcast(numbers), "_b", "left").withColumn("_task", F.coalesce("_task", (F.col("_b") + 2**30).cast("int")))
    gathered = dealt.repartition(buckets, "_task").groupBy("_task", "_b").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    mixed = gathered.sortWithinPartitions("_b").select("_b", F.posexplode(F.shuffle("_rows", seed)).alias("_place", "_row"))
    place = F.col("_start") + F.col("_place")
    # Shard s has the places from s * total div shards on.
    shard = F.expr(f"((_start + _place + 1) * {shards} - 1) div {max(1, total)}")
    placed = mixed.join(F.broadcast(starts), "_b").select(*(F.col(f"_row.{c}").alias(c) for c in names), shard.cast("int").alias("shard"), place.alias("_at"))
    return placed.select(*names, "shard", (F.col("_at") - F.expr(f"CAST(shard AS BIGINT) * {total} div {shards}")).alias("slot"))


def write_shards(docs: DataFrame, folder: str, key: str = "doc_id", **options) -> None:
    """Write ``docs`` as one folder per shard, with ``slot``, each file in the order of its slots."""
    shuffled(docs, key, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``, read from the shards that were written."""
    spark = docs.sparkSession
    checkpoint_ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/shards-{uuid.uuid4().hex}"
    write_shards(docs, folder, shards=shards)
    kinds = [f for f in docs.schema.fields if f.name not in ("shard", "slot")]
    written = spark.read.schema(T.StructType([*kinds, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])).parquet(folder)
    text = F.coalesce(F.col("text"), F.lit(""))
    return written.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
