"""Substring dedup by sliding sentence spans.

A sentence ends after a word with a full stop, exclamation or question mark of any script (and what closes a quote or
bracket after it), or at a line break. Sentences are the units; one of more than ``WINDOW`` words is split by its content: a
unit ends after the word whose hash is least among some ``WINDOW`` words of the sentence in a row (winnowing), so that whether
one ends at a word depends on the ``WINDOW`` - 1 words before and after it alone, not on the place in the sentence. A span is a run
of units: from each unit one runs forward, and to each unit one runs backward, until it has at least two units and
``SPAN_WORDS`` words. So any repeated passage of 2 * ``WINDOW`` + ``SPAN_WORDS`` + ``WINDOW`` words holds a whole span, wherever it
starts in a sentence, and is covered but for at most ``WINDOW`` words at either end. Spans are hashed
(128 bits, white space between words does not count) and joined over all documents. The first span of a hash, by
doc_id and place, stays; the units of every other one are removed from their texts, also within one document.

Units that several spans of a hash cover are removed once. Texts without a repeated span stay as they are, byte
for byte. A removed unit goes with the white space after it. Null text stays null; rows with the same doc_id and text
count as one document (they are copies of each other; exact dedup is another operator), null ids come last.

Halves of hashes are counted first. A bit map of those that occur twice, of at most ``FILTER_BITS`` bits, lets a second pass drop
nearly all other spans before they are shuffled (one bit may stand for several hashes; the counts that follow are exact, and beyond
the bound more spans are shuffled). A hash of ``HOT_ROWS`` spans or more is reduced by partial aggregation and its few
first places are broadcast; the others are ordered in the task of their hash. Texts move only if they lose something.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowline.llm.common import cut, lookup_join, row_key, text_chunks

UNIT_WORDS, SPAN_WORDS = 10, 20
#: A longer sentence is split, one end among so many words in a row. 3 * WINDOW + SPAN_WORDS words hold a whole span: 50.
WINDOW = UNIT_WORDS
#: Bits of the map of repeated hashes: ``FILTER_SHARE`` for each, but no more than this (32 MB).
FILTER_BITS, FILTER_SHARE = 1 << 28, 8
#: A hash with so many spans is hot.
HOT_ROWS = 200_000
#: What each task gets of documents that lose something, if so many bytes hold them.
LOST_BYTES = 32_000_000
_STOP, _CLOSE = "\u2026\u3002\uff01\uff1f\uff61\u061f\u06d4\u0964\u0965", ")]}\"'*\u00bb\u201c\u201d\u2019\u300d\u300f"
_STOPS = re.compile(f"[.!?{_STOP}][.!?{re.escape(_STOP + _CLOSE)}]*$")
#: By last byte of a word: 1 if it ends a sentence, 2 if the whole word decides.
_LAST = np.zeros(256, np.int8)
_LAST[[c.encode()[-1] for c in _STOP + _CLOSE]] = 2
_LAST[list(b".!?")] = 1
_WORD = re.compile(r"\S+")


def _plain(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of ``texts``, each with one space after it, and the places after those spaces; the number of words
    up to the end of each line and of each text."""
    plain, lines, ends = [], [], []
    total = 0
    for text in texts:
        for line in text.splitlines():
            words = line.split()
            if words:
                plain.append(" ".join(words))
                total += len(words)
                lines.append(total)
        ends.append(total)
    plain = " ".join([*plain, ""]).encode()
    after = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32) + 1
    return plain, after, np.array(lines, np.int64), np.array(ends, np.int64)


def _word_hashes(plain: bytes, after: np.ndarray) -> np.ndarray:
    """A hash of the length and the last eight bytes of each word."""
    length = np.diff(after, prepend=0).astype(np.uint64) - np.uint64(1)
    tails = np.lib.stride_tricks.sliding_window_view(np.frombuffer(bytes(8) + plain, np.uint8), 8)[after - 1].view(">u8").ravel().astype(np.uint64)
    tails &= np.uint64(2**64 - 1) >> (np.uint64(64) - np.minimum(length, np.uint64(8)) * np.uint64(8))
    h = (tails ^ (length << np.uint64(56))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _unit_words(plain: bytes, after: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The number of words before each unit, and that of all words."""
    n = len(after)
    ends = np.zeros(n + 1, bool)
    last = _LAST[np.frombuffer(plain, np.uint8)[after - 2]]
    ends[1:] = last == 1
    for k in np.flatnonzero(last == 2).tolist():
        ends[k + 1] = _STOPS.search(plain[after[k - 1] if k else 0:after[k] - 1].decode()) is not None
    ends[lines] = ends[0] = True
    if n >= WINDOW:
        h = _word_hashes(plain, after)
        least, at = h[WINDOW - 1:], np.arange(WINDOW - 1, n)
        for k in range(1, WINDOW):
            earlier = h[WINDOW - 1 - k:n - k]
            at = np.where(earlier < least, np.arange(WINDOW - 1 - k, n - k), at)
            least = np.minimum(earlier, least)
        # The window has to lie within a sentence that is too long.
        sentence = np.cumsum(ends[:n])
        within = (sentence[:n - WINDOW + 1] == sentence[WINDOW - 1:]) & (np.bincount(sentence)[sentence[WINDOW - 1:]] > WINDOW)
        ends[at[within] + 1] = True
    return np.flatnonzero(ends)


def units(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of each unit of ``text``; together they are the whole text."""
    if not text.strip():
        return [(0, len(text), 0)] if text else []
    plain, after, lines, _ = _plain([text])
    words = _unit_words(plain, after, lines).tolist()
    starts = [m.start() for m in _WORD.finditer(text)]
    cuts = [0, *(starts[w] for w in words[1:-1]), len(text)]
    return [(a, b, w - v) for a, b, v, w in zip(cuts, cuts[1:], words, words[1:])]


def spans(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last unit of each span, each once, given the number of words before each unit and in all, and the
    text of each unit."""
    unit = np.arange(len(texts))
    forward = np.maximum(unit + 1, np.searchsorted(words, words[:-1] + SPAN_WORDS) - 1)
    backward = np.minimum(unit - 1, np.searchsorted(words, words[1:] - SPAN_WORDS, side="right") - 1)
    down = (forward < len(texts)) & (texts[np.minimum(forward, len(texts) - 1)] == texts)
    up = (backward >= 0) & (texts[backward] == texts) & (forward[backward] != unit)
    return np.concatenate([unit[down], backward[up]]), np.concatenate([forward[down], unit[up]])


def _hashed_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(high, low, first, last) of each span of each of ``texts``, and the number of its text."""
    plain, after, lines, ends = _plain(texts)
    if not len(after):
        return np.empty((0, 4), np.int64), np.empty(0, np.int64)
    words = _unit_words(plain, after, lines)
    owner = np.searchsorted(ends, words[:-1], side="right")
    first, last = spans(words, owner)
    begin, end = np.append(0, after)[words[first]].tolist(), (after[words[last + 1] - 1] - 1).tolist()
    keys = b"".join([xxhash.xxh3_128_digest(plain[a:b]) for a, b in zip(begin, end)])
    origin = np.searchsorted(owner, owner[first])
    return np.column_stack([np.frombuffer(keys, np.int64).reshape(-1, 2), first - origin, last - origin]), owner[first]


def _hashed(text: str) -> np.ndarray:
    """(high, low, first, last) of each span of ``text``."""
    return _hashed_all([text])[0]


def _numbered(docs: DataFrame) -> DataFrame:
    """``_row``, the text, and what orders documents; ``_row`` is ``row_key()`` of all rows of ``docs``, null texts too."""
    return docs.select(row_key().alias("_row"), F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"),
                       F.xxhash64("text").alias("twin"), "text")


_PLACE = ["none", "doc", "twin", "first"]


def all_spans(docs: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """``high, low, _row, none, doc, twin, first, last`` of every span whose bit in the map ``bits`` is set."""
    names = ["high", "low", "_row", "none", "doc", "twin", "first", "last"]
    shared = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        chosen = None if shared is None else shared.value
        for batch in batches:
            for part in text_chunks(batch, "text"):
                flat, at = _hashed_all([t or "" for t in part.column("text").to_pylist()])
                if chosen is not None:
                    place = flat[:, 0] & (len(chosen) * 64 - 1)
                    keep = chosen[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1) > 0
                    flat, at = flat[keep], at[keep]
                rows = [part.column(c).take(pa.array(at)) for c in names[2:6]]
                yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), *rows, pa.array(flat[:, 2].astype(np.int32)),
                                                  pa.array(flat[:, 3].astype(np.int32))], names)

    return _numbered(docs).mapInArrow(run, "high long, low long, _row long, none boolean, doc long, twin long, first int, last int")


def _bit_map(repeated: DataFrame) -> np.ndarray:
    """One bit for the low end of each hash half, as 64-bit words; at most ``FILTER_BITS`` bits reach the driver."""
    size = 64
    total = repeated.count()
    while size < min(FILTER_BITS, FILTER_SHARE * total):
        size *= 2
    place = F.col("high").bitwiseAND(F.lit(size - 1))
    words = repeated.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, CAST(high & 63 AS INT))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(size // 64, np.uint64)
    for batch in found.toArrow().to_batches():
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
    return out


def removals(docs: DataFrame) -> DataFrame:
    """``_row, n_spans, gone``: for each row that repeats something, its repeated spans as (first, last) units.

    ``_row`` is ``row_key()`` of ``docs``, which must be a table scan or a checkpointed frame.
    """
    keys = ["high", "low"]
    repeated = cut(all_spans(docs).groupBy("high").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    spans = all_spans(docs, _bit_map(repeated))
    # At most one half per HOT_ROWS spans.
    hot = cut(repeated.where(F.col("n") >= HOT_ROWS).select("high", F.lit(True).alias("hot")))
    spans = spans.join(F.broadcast(hot), "high", "left").withColumn("place", F.struct(*_PLACE)).drop(*_PLACE[:3])
    over = Window.partitionBy(*keys)
    rest = spans.where("hot IS NULL").withColumns({"n": F.count(F.lit(1)).over(over), "top": F.min("place").over(over)})
    others = rest.drop("hot")
    if not hot.isEmpty():
        many = cut(spans.where("hot").drop("hot"))
        # One row per hash of a hot half: as few, but for chance collisions.
        tops = cut(many.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("top")))
        others = others.unionByName(lookup_join(many, tops, keys, "n", "inner"))
    others = others.where("n > 1 AND place <> top")
    return others.groupBy("_row").agg(F.count(F.lit(1)).alias("n_spans"), F.collect_set(F.struct("first", "last")).alias("gone"))


def without(text: str | None, gone: list[dict] | None) -> tuple[str | None, int, int]:
    """The text without the units of the spans ``gone``, and how many units and words went."""
    if not text or not gone:
        return text, 0, 0
    parts = units(text)
    drop = np.zeros(len(parts) + 1, np.int64)
    for span in gone:
        drop[span["first"]] += 1
        drop[span["last"] + 1] -= 1
    drop = np.cumsum(drop)[:-1] > 0
    return ("".join(text[a:b] for (a, b, _), d in zip(parts, drop) if not d), int(drop.sum()), sum(n for (_, _, n), d in zip(parts, drop) if d))


def span_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with its texts cleaned, and ``removed_units``, ``removed_words``, ``repeated_spans``."""
    names = ["removed_units", "removed_words", "repeated_spans", "text"]
    lost = cut(removals(docs)).select("_row", F.col("n_spans").alias("_n_spans"), F.col("gone").alias("_gone"))
    # Columns of docs travel in one struct, so that none can clash with those above.
    others = [c for c in docs.columns if c not in names]
    rows = docs.select(F.struct(*others).alias("_kept"), "text", row_key().alias("_row"))
    size = lost.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("_gone")).alias("spans")).first()
    if 40 * size["n"] + 24 * (size["spans"] or 0) <= LOST_BYTES:
        joined = rows.join(F.broadcast(lost), "_row", "left")
    elif 40 * size["n"] <= LOST_BYTES:
        # Only texts that lose something move.
        marked = rows.join(F.broadcast(lost.select("_row", F.lit(True).alias("_some"))), "_row", "left")
        joined = marked.where("_some IS NULL").drop("_some").withColumns({"_n_spans": F.lit(None).cast("long"), "_gone": F.lit(None).cast(lost.schema["_gone"].dataType)})
        joined = joined.unionByName(marked.where("_some").drop("_some").join(lost, "_row"))
    else:
        joined = rows.join(lost, "_row", "left")
    zero = F.lit(0).cast("long")
    # Untouched texts don't leave the JVM.
    plain = joined.where("_gone IS NULL").select("_kept", zero.alias("repeated_spans"), "text", zero.alias("removed_units"), zero.alias("removed_words"))

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, "text"):
                made = zip(*(without(t, g) for t, g in zip(part.column("text").to_pylist(), part.column("_gone").to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column("_kept"), part.column("repeated_spans"), *map(pa.array, made, kinds)], order)

    order, kinds = plain.columns, [pa.string(), pa.int64(), pa.int64()]
    touched = joined.where("_gone IS NOT NULL").select("_kept", F.col("_n_spans").alias("repeated_spans"), "text", "_gone")
    done = plain.unionByName(touched.mapInArrow(run, plain.schema))
    return done.select(*(F.col("_kept").getField(c).alias(c) for c in others), "text", "removed_units", "removed_words", "repeated_spans")


def span_report(docs: DataFrame) -> DataFrame:
    """``doc_id, repeated_spans, removed_units, removed_words, changed, text`` for every row of ``docs``."""
    return span_dedup(docs.select("doc_id", "text")).withColumn("changed", F.col("removed_units") > 0)
