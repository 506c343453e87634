"""The queries of the text operators, and the SQL that must give the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stowline.llm import bpe, exact_dedup, fim, imatch, jaccard, langid, licenses, mixing, prefix_trie, shards, span_dedup, toxicity, weak_quality
from stowline.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The rank file and pattern of the production tokenizer.
RANKS = "byte_bpe_multi_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_bpe_round_trip")
def op1(spark, sf_dir):
    return bpe.round_trip_digests(documents(spark, sf_dir), bpe.load(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


@query("op2_exact_dedup", r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
""")
def op2(spark, sf_dir):
    return exact_dedup.dedup_report(documents(spark, sf_dir))


@query("op9_two_pass_shards")
def op9(spark, sf_dir):
    return shards.shard_report(documents(spark, sf_dir))


@query("op10_source_mix", mixing.REPORT_SQL)
def op10(spark, sf_dir):
    return mixing.mix_report(documents(spark, sf_dir))


@query("op5_toxicity")
def op5(spark, sf_dir):
    return toxicity.toxicity_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op7_language_id")
def op7(spark, sf_dir):
    return langid.language_report(documents(spark, sf_dir))


@query("op8_imatch_fingerprints")
def op8(spark, sf_dir):
    return imatch.fingerprint_report(documents(spark, sf_dir))


@query("op4_ngram_jaccard_join")
def op4(spark, sf_dir):
    return jaccard.near_duplicate_report(documents(spark, sf_dir))


@query("op6_sentence_span_dedup")
def op6(spark, sf_dir):
    return span_dedup.span_report(documents(spark, sf_dir))


@query("op3_weak_label_quality")
def op3(spark, sf_dir):
    return weak_quality.quality_report(documents(spark, sf_dir))


@query("op11_fill_in_middle", fim.REPORT_SQL)
def op11(spark, sf_dir):
    return fim.fim_report(documents(spark, sf_dir))


@query("op12_license_scan")
def op12(spark, sf_dir):
    return licenses.license_report(documents(spark, sf_dir))


@query("op13_conversation_trie", prefix_trie.REPORT_SQL)
def op13(spark, sf_dir):
    return prefix_trie.trie_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
