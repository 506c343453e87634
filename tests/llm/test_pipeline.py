"""The pipeline, stage by stage, on the smallest data set."""

import os
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from stowline.llm import bpe, langid, mixing
from test_exact_mix_shards import norm
from test_near import brute

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], FOLDER).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
    start, known, exact, near, mixed, coded = (t.collect() for t in tables)
    assert all(t.columns == docs.columns for t in tables[:-1])
    model = langid.train(docs.where(langid.fold() != 0))
    rejected = {r.doc_id for r in langid.predict(docs, model).where("rejected").collect()}
    assert {r.doc_id for r in known} == {r.doc_id for r in start} - rejected and len(rejected) <= 2
    first = {}
    for r in sorted(known, key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r.doc_id)
    assert {r.doc_id for r in exact} == set(first.values()) and len(exact) == len(first)
    wanted, groups = brute([(r.doc_id, r.text) for r in exact])
    assert Counter(r.doc_id for r in near) == Counter({c for _, c, _ in wanted}) and len(near) == groups
    times = {r.doc_id: r.times for r in mixing.mix_plan(tables[3]).collect() if r.times}
    assert Counter(r.doc_id for r in mixed) == Counter(times)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(
        bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), special_tokens={})
    texts = {r.doc_id: r.text for r in mixed}
    assert len(coded) == len(mixed) and all(r.decodes and list(r.ids) == library.encode_ordinary(texts[r.doc_id]) for r in coded)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()) == Counter(r.doc_id for r in coded)
