"""A training-corpus pipeline over ``documents``: language ID, exact dedup, near dedup, source mix, tokens.

Each stage takes and returns a table with the columns of ``documents``; the last one returns the tokens. A stage
reads what its predecessor wrote; ``run`` writes each as Parquet in the shared checkpoint folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline.llm import bpe, langid
from stowline.llm.common import cut, documents, few, row_key, stored
from stowline.llm.exact_dedup import exact_dedup
from stowline.llm.jaccard import near_dedup
from stowline.llm.mixing import mix
from stowline.llm.queries import RANKS

#: Rows of an Arrow batch: texts are long, and smaller batches keep the buffers of executors and workers small.
BATCH_ROWS = 1_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language ID rejects: no letters, or too unsure of any language.

    The model learns from the labelled rows outside the held-out fold; where there are none, nothing can be told and all rows stay.
    Texts go to Python once and don't come back: only the keys of the rejected rows do.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    model = langid.train(docs.where(langid.fold() != 0))
    if not model.langs:
        return docs
    gone = cut(langid.predict(docs.select(row_key().alias("_row"), "text"), model, drop_text=True).where("rejected").select("_row"))
    rows = docs.withColumn("_row", row_key())
    return rows.join(F.broadcast(gone) if few(gone) else gone, "_row", "left_anti").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of equal texts."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates."""
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or thin out documents until each source is near its share."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to the text's bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    ranks = bpe.load(public_tokenizers.path(RANKS))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", digest.alias("digest"), "text"), ranks, public_tokenizers.PATTERN,
                           drop_text=True)
    whole = F.sha2("decoded", 256) == F.col("digest")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("decodes"))


STAGES = [("language ID", known_language), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies),
          ("mixing sources", mix_sources), ("byte-level BPE", tokens)]
#: Language ID, near dedup and BPE have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
