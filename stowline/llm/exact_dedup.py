"""Exact dedup by progressive refinement: length, then prefix hash, then hash of the full text.

Texts are equal when they are identical after each run of white space (``[\\x20\\x09-\\x0D]+``) became one space;
null counts as empty. Of equal texts the row with the smallest ``doc_id`` stays (null ids come last; rows that
also share the id are told apart by their place in the scan, and one of them stays).

The first two levels work on a narrow table (row key, length, prefix hash). Full texts are hashed only for rows
whose length and prefix both occur again; no step shuffles a text unless the list of rows to drop is too large
to broadcast. Groups are counted and reduced with partial aggregates; a group of any size is never gathered,
and rows find their group by ``lookup_join``, which does not send a hot group to one task.

An empty table gives empty results. Input columns are kept as they are; helper columns are ``_``-prefixed and
replace input columns of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.llm.common import cut, few, lookup_join, row_key

#: Leading characters of the normalised text that the second level hashes.
PREFIX_CHARS = 256


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _surviving(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once, with ``_n``."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")


def duplicate_rows(docs: DataFrame, prefix: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of ``docs`` that has an equal: ``_row``, ``keep_id``, ``group_size``, ``kept``.

    ``_row`` is ``row_key()`` of ``docs``, which must be a table scan or a checkpointed frame.
    """
    text = docs.select("doc_id", row_key().alias("_row"), normalised().alias("_norm"))
    facts = cut(text.select("_row", F.length("_norm").alias("_len"), F.xxhash64(F.left("_norm", F.lit(prefix))).alias("_head")))
    lengths = cut(_surviving(facts, ["_len"]))
    facts = lookup_join(facts, lengths, ["_len"], "_n", "inner").drop("_n")
    heads = cut(_surviving(facts, ["_len", "_head"]))
    rows = text.withColumns({"_len": F.length("_norm"), "_head": F.xxhash64(F.left("_norm", F.lit(prefix)))})
    if few(heads):
        rows = rows.join(F.broadcast(heads), ["_len", "_head"])
    else:
        keep = cut(lookup_join(facts, heads, ["_len", "_head"], "_n", "inner").select("_row"))
        rows = rows.join(keep, "_row")
    full = cut(rows.select("doc_id", "_row", F.sha2("_norm", 256).alias("_sha")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))
    groups = cut(full.groupBy("_sha").agg(first.alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    return lookup_join(full, groups, ["_sha"], "_n", "inner").select(
        "_row", F.col("_first.doc_id").alias("keep_id"), F.col("_n").alias("group_size"),
        (F.col("_row") == F.col("_first._row")).alias("kept"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    gone = cut(duplicate_rows(docs).where("NOT kept").select("_row"))
    rows = docs.withColumn("_row", row_key())
    return rows.join(F.broadcast(gone) if few(gone) else gone, "_row", "left_anti").select(*docs.columns)


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    groups = duplicate_rows(docs)
    rows = docs.select("doc_id", row_key().alias("_row"), F.sha2(normalised(), 256).alias("text_sha256"))
    joined = rows.join(groups, "_row", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce("kept", F.lit(True)).alias("kept"), "text_sha256")
