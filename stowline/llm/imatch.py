"""Document fingerprints by I-Match with randomised lexicons.

Terms (lower-case words) are counted over all documents. The lexicon is a band of document frequency: terms in at
least ``LEAST`` and at most ``MOST`` of the documents, and in two at least. A document keeps its distinct lexicon
terms, sorted; each of several randomised subsets of the lexicon hashes those that it holds, and the
fingerprint is the list of these hashes. A subset's hash is a mixed sum over its terms: they are sorted and distinct, so the sum
stands for the sorted list (it tells lists apart but for chance, as a hash of their bytes would) and all subsets of a text are
made at once. A subset that holds none gives an empty entry. A text with terms but none in the lexicon gets entries
made from all of its sorted distinct terms, so that only equal sets of terms agree.

Subsets come in ``SCALES`` scales of ``PER_SCALE`` each; a subset of scale s holds a term with probability
2^-(s + 1). So there is a scale at which a text of any length keeps a few terms of each subset. The likeness of two
fingerprints is the best, over the scales, of the share of equal hashes among the entries that are not empty in
both; scales with fewer than ``FILLED`` such entries count as if they had so many.

The band bounds the lexicon: at most (mean distinct terms of a document) / LEAST terms, at any corpus size; it is
counted before it is broadcast. Null text counts as empty, and the fingerprint of a text without terms has no hash; two
such have likeness 1. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowline.llm.common import cut, row_key, task_numbers, text_chunks
from stowline.operators.skew import number_in_group

LEAST, MOST = 0.0005, 0.05
SCALES, PER_SCALE, FILLED = 10, 8, 4
SEED = 11
#: Characters of a bucket of the pass that meets each document with the next, and buckets at most; beyond, buckets grow.
BUCKET_CHARS, BUCKETS_MOST = 16_000_000, 100_000
#: The largest lexicon that is broadcast, in terms of 8 bytes.
LEXICON_TERMS = 20_000_000


class Terms:
    """64-bit hashes of words; keeps those of recent words."""

    def __init__(self, entries: int = 250_000):
        self.entries, self.known = entries, {}

    def hashes(self, text: str) -> np.ndarray:
        """The sorted hashes of the distinct words of ``text``."""
        distinct = set(text.lower().split())
        known = self.known
        if len(known) > self.entries:
            known.clear()
        out = list(map(known.get, distinct))
        if None in out:
            out = []
            for w in distinct:
                h = known.get(w)
                if h is None:
                    h = xxhash.xxh3_64_intdigest(w) - (1 << 63)
                    if len(w) < 40:
                        known[w] = h
                out.append(h)
        return np.sort(np.array(out, np.int64))


def term_counts(docs: DataFrame) -> DataFrame:
    """``term`` (hash) and ``n``, the number of documents it is in; each task sums its own first."""

    def run(batches):
        terms, held = Terms(), []

        def packed():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for i in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[i:i + 100_000]), pa.array(n[i:i + 100_000])], ["term", "n"])

        size = 0
        for batch in batches:
            for part in text_chunks(batch, "text"):
                for text in part.column("text").to_pylist():
                    if text:
                        held.append(terms.hashes(text))
                        size += len(held[-1])
                if size > 6_000_000:
                    yield from packed()
                    size = 0
        if held:
            yield from packed()

    counted = docs.select("text").mapInArrow(run, "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> np.ndarray:
    """The sorted hashes of the terms in the band."""
    total = docs.count()
    band = term_counts(docs).where((F.col("n") >= max(2, least * total)) & (F.col("n") <= max(2, most * total))).select("term")
    found = band.limit(LEXICON_TERMS + 1).toArrow().column("term").to_numpy()
    if len(found) > LEXICON_TERMS:
        raise ValueError("the lexicon is too large to broadcast; raise `least`")
    return np.sort(found)


def subsets(terms: np.ndarray) -> np.ndarray:
    """For each term the subsets that hold it, one bit each: subset k of scale s if a seeded hash starts with s + 1 zero bits."""
    held = np.empty((len(terms), SCALES * PER_SCALE), bool)
    for k in range(SCALES * PER_SCALE):
        h = _mixed(terms.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (k + SEED) & (2**64 - 1)))
        held[:, k] = (h >> np.uint64(63 - k // PER_SCALE)) == 0
    return np.packbits(held, axis=1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_PLACES = np.arange(SCALES * PER_SCALE, dtype=np.uint64)


def fingerprint(kept: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each subset, 0 for an empty one, given a document's sorted lexicon terms and their subsets.

    The terms are distinct, so the sum of their mixed values stands for the sorted list.
    """
    held = np.unpackbits(bits, axis=1).view(bool)
    sums = np.where(held, _mixed(kept.astype(np.uint64))[:, None], np.uint64(0)).sum(0, dtype=np.uint64)
    some = held.any(0)
    return np.where(some, (_mixed(sums ^ _PLACES) >> np.uint64(32)) | np.uint64(1), np.uint64(0))


def fallback(terms: np.ndarray) -> np.ndarray:
    """The entries of a text that has the sorted distinct ``terms`` and none of them in the lexicon."""
    if not len(terms):
        return np.zeros(SCALES * PER_SCALE, np.uint64)
    whole = np.uint64(xxhash.xxh3_64_intdigest(terms.tobytes()))
    return (_mixed(whole ^ _PLACES) >> np.uint64(32)) | np.uint64(1)


def shown(marks: np.ndarray) -> str:
    return "-".join(["%x" % m if m else "" for m in marks.tolist()])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    same = a == b
    if same.all():
        return 1.0
    filled = (a | b) != 0
    equal = (same & filled).reshape(SCALES, PER_SCALE).sum(1)
    return float((equal / np.maximum(FILLED, filled.reshape(SCALES, PER_SCALE).sum(1))).max())


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` in buckets by descending id, each followed by the first row of the next bucket (``_more``).

    Bucket bounds are sampled rows; ties of the id are ordered by a hash of the text and the place in the scan, so
    that no id makes a bucket of its own. Null ids come last. The sample is put in order by Spark; the bounds, one row per
    bucket, reach the driver. ``_b`` is a number that Spark deals to a task of its own when it deals by ``_b``.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), F.xxhash64("text").alias("_hash"), row_key().alias("_at"), "doc_id", "text")
    total, chars = rows.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    buckets = max(1, min(BUCKETS_MOST, total, -(-(chars or 0) // BUCKET_CHARS)))
    bounds = []
    if buckets > 1:
        share = min(1.0, 64 * buckets / total)
        order = ["_id", "_hash", "_at"]
        drawn = rows.select(*order).where(F.pmod(F.xxhash64(*order, F.lit(SEED)), F.lit(1_000_003)) < share * 1_000_003)
        drawn = cut(number_in_group(drawn.withColumn("_all", F.lit(0)), ["_all"], order, "_rank"))
        step = max(1, drawn.count() // buckets)
        # Bucket b starts at its bound; the first bucket starts with the very first row.
        kept = drawn.where((F.col("_rank") > 0) & (F.col("_rank") % step == 0)).select(*order)
        bounds = sorted((tuple(r) for r in kept.collect()), reverse=True)[-(buckets - 1):]
    first = rows.orderBy(F.desc("_id"), F.desc("_hash"), F.desc("_at")).select("_id", "_hash", "_at").first()
    keys = [tuple(-x for x in b) for b in bounds]
    start = set(bounds) | ({tuple(first)} if first else set())
    dealt = _dealt(docs.sparkSession, len(keys) + 1)
    schema = T.StructType([T.StructField("_b", T.IntegerType()), T.StructField("_more", T.BooleanType()), *rows.schema.fields])

    def run(batches):
        for batch in batches:
            own = list(zip(*(batch.column(c).to_pylist() for c in ("_id", "_hash", "_at"))))
            b = [bisect.bisect_right(keys, tuple(-x for x in k)) for k in own]
            yield pa.RecordBatch.from_arrays([pa.array([dealt[i] for i in b], pa.int32()), pa.array([False] * len(b)), *batch.columns], schema.names)
            extra = [i for i, k in enumerate(own) if k in start]
            if extra:
                before = [dealt[(b[i] - 1) % (len(keys) + 1)] for i in extra]
                part = batch.take(pa.array(extra))
                yield pa.RecordBatch.from_arrays([pa.array(before, pa.int32()), pa.array([True] * len(extra)), *part.columns], schema.names)

    return rows.mapInArrow(run, schema), len(keys) + 1


def _dealt(spark: SparkSession, parts: int) -> list[int]:
    """For each of ``parts`` tasks a number that Spark's hash deals to it; one row per task."""
    known = {r["part"]: r["number"] for r in task_numbers(spark, parts).collect()}
    # A task without a number shares that of another: numbers only must differ.
    return [known.get(p, 2**30 + p) for p in range(parts)]


def fingerprints(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """The fingerprints of each text of ``docs`` (doc_id, text), of its edited text, and their likenesses."""
    rows, buckets = in_order(docs)
    # A range of whole buckets: the order within a task is that of the buckets, so one row is held back at a time.
    dealt = rows.repartition(buckets, "_b").sortWithinPartitions("_b", "_more", F.desc("_id"), F.desc("_hash"), F.desc("_at"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [f.split()[0] for f in schema.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterable[pa.RecordBatch]):
        lexicon, known = shared.value, Terms()
        bits = subsets(lexicon)

        def marks(text):
            own = known.hashes(text)
            at = np.searchsorted(lexicon, own)
            at = at[(lexicon[np.minimum(at, len(lexicon) - 1)] == own)] if len(lexicon) else at[:0]
            return fingerprint(lexicon[at], bits[at]) if len(at) else fallback(own)

        held, out = None, []
        for batch in batches:
            for part in text_chunks(batch.select(["_b", "_more", "doc_id", "text"]), "text"):
                for b, more, doc_id, text in zip(*(part.column(i).to_pylist() for i in range(4))):
                    text = text or ""
                    own = marks(text)
                    if held and held[0] == b:
                        _, old_id, old, old_marks = held
                        k = len(old) // 3
                        edited = old[:len(old) - k] + text[:k]
                        new = marks(edited)
                        out.append((old_id, len(old), hashlib.sha256(edited.encode()).hexdigest(), shown(old_marks), shown(new),
                                    likeness(old_marks, new), likeness(old_marks, own)))
                    held = None if more else (b, doc_id, text, own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
                    out = []

    return dealt.mapInArrow(run, schema)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    return fingerprints(docs.select("doc_id", "text"), lexicon(docs))
