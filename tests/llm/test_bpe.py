"""Byte-level BPE against the tiktoken library and by round trip."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from stowline.llm import bpe

DATA = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
RANKS = bpe.read_ranks(DATA)
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("entries", [5, 70_000])
def test_same_ids_as_the_library(library, monkeypatch, entries):
    monkeypatch.setattr(bpe, "CACHE_WORDS", entries)
    monkeypatch.setattr(bpe, "CACHE_PIECES", entries)
    encoder, rng = bpe.Encoder(RANKS, PATTERN), random.Random(1)
    alphabet = " \n\t\r   \x1c\x85ab'sreéß1²٣,.!$　中文ا🙂 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["a" * 5000, " " * 3000, "ab" * 2000 + "\n" * 300, "é" * 900, "", " ", "don't  stop ", "x " * 50]
    for text in texts:
        assert encoder.encode(text).tolist() == library.encode_ordinary(text), repr(text)


def test_merge_of_long_matches_uses_several_levels(library):
    rng = random.Random(2)
    for n in (1, 2, 15, 16, 17, 300, 2000):
        piece = "".join(rng.choice("abcdeé") for _ in range(n))
        assert bpe.merge(piece.encode(), RANKS) == library.encode_ordinary(piece)


def test_round_trip(spark, library):
    texts = ["Hello  world\n", None, "", "naïve 中文 🙂", "w " * 4000, "Hello  world\n"]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in bpe.round_trip_digests(docs, DATA, PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip_digests(docs.limit(0), DATA, PATTERN).count() == 0
    coded = bpe.encode(docs, DATA, PATTERN)
    assert coded.columns == ["doc_id", "text", "ids"]
    null = bpe.decode(coded.withColumn("ids", F.when(F.col("doc_id") != 2, F.col("ids"))), DATA).where("decoded IS NULL")
    assert [r.doc_id for r in null.collect()] == [2]
