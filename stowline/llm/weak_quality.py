"""Quality classifier from weak labels.

Heuristic labellers look at the whole text and vote good, bad or nothing. Votes of all documents are counted by
pattern, of which there are at most 3^labellers; expectation-maximisation over these counts estimates how
often each labeller votes what for good and for bad documents, and the share of good ones. It starts with documents
of two bad votes or more as bad, which also says which class is which. The posterior of its pattern is a document's weak label.

A hashed linear scorer (logistic, over word and word-shape features, averaged over the text) then learns the
posteriors of a bounded sample, ``TRAIN_ROWS`` different texts with the least hash and ``TRAIN_WORDS`` words of each, and scores
every whole text. It sees no label, language, source or id. ``kept`` is score >= 0.5.

A text without words (null too) gets no features and is not kept. Equal texts get equal scores. Other columns pass
through; columns with the names of the results are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowline.llm.common import cut, with_arrow
from stowline.llm.subword import WordIds, codes, word_hashes

BUCKETS = 1 << 16
TRAIN_ROWS, TRAIN_WORDS, EPOCHS = 4_000, 2_000, 8
SEED = 13
_SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()\-]")
_PLAIN = re.compile(r"[\"'(]?[^\W_]+(?:['’\-][^\W_]+)*[\"')]?[.,;:!?]?[\"')]?")

#: The labellers: the measure each looks at, and how it votes. They overlap: most defects show in several measures.
LABELLERS = (
    ("symbols", lambda x: 1 if x < 0.01 else -1 if x > 0.04 else 0),
    ("odd_ends", lambda x: 1 if x < 0.03 else -1 if x > 0.15 else 0),
    ("no_lower", lambda x: 1 if x < 0.05 else -1 if x > 0.2 else 0),
    ("plain", lambda x: 1 if x > 0.97 else -1 if x < 0.85 else 0),
    ("letters", lambda x: 1 if x > 0.95 else -1 if x < 0.88 else 0),
    ("stutter", lambda x: 1 if x < 0.03 else -1 if x > 0.08 else 0),
    ("variety", lambda x: 1 if x > 0.55 else -1 if x < 0.4 else 0),
    ("new_pairs", lambda x: 1 if x > 0.9 else -1 if x < 0.7 else 0),
    ("words", lambda x: 1 if x >= 40 else -1 if x < 4 else 0),
)


#: Of code points seen so far: what they are (bits, 255 if not yet known), their lower case, and what stands for them in a shape.
_ALPHA, _ALNUM, _CAPITAL, _SYMBOL, _MARK, _CLOSE = 1, 2, 4, 8, 16, 32
_kind = np.full(0x110000, 255, np.uint8)
_lower, _sign = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint32)


def _learn(points: np.ndarray) -> None:
    for point in np.unique(points[_kind[points] == 255]).tolist():
        c = chr(point)
        _kind[point] = (_ALPHA * c.isalpha() | _ALNUM * c.isalnum() | _CAPITAL * (c.upper() == c) | _SYMBOL * bool(_SYMBOLS.match(c))
                        | _MARK * (c in ".,;:!?") | _CLOSE * (c in "\"')"))
        _lower[point] = ord(c.lower()) if len(c.lower()) == 1 else point
        _sign[point] = ord("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c)


def _facts(words: list[str]) -> np.ndarray:
    """Of each word: table rows of itself and its shape, a hash, and its length, symbols, letters and flags.

    The shape of a word has X, x and 9 for its first 24 letters and digits, and no more than two of a kind in a row.
    """
    points, sizes = codes(words)
    points = points.astype(np.int64)
    _learn(points)
    starts = np.cumsum(sizes) - sizes
    kind, ends = _kind[points], starts + sizes - 1
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    sign, place = _sign[points], np.arange(len(points)) - np.repeat(starts, sizes)
    keep = place < 24
    keep[2:] &= (place[2:] < 2) | (sign[2:] != sign[1:-1]) | (sign[2:] != sign[:-2])
    letters = np.add.reduceat(kind & _ALPHA, starts, dtype=np.int64)
    last, before = kind[ends], np.where(sizes > 1, kind[np.maximum(ends - 1, 0)], _ALNUM)
    plain = (letters == sizes) | (letters == sizes - 1) & (sizes > 1) & (last & _MARK > 0)
    for i in np.flatnonzero(~plain).tolist():
        plain[i] = _PLAIN.fullmatch(words[i]) is not None
    odd = ~((last & _ALNUM > 0) | (last & (_MARK | _CLOSE) > 0) & (before & _ALNUM > 0))
    upper = (sizes > 1) & np.logical_and.reduceat(kind & _CAPITAL > 0, starts) | (sizes == 1) & (points[starts] == ord("|"))
    return np.column_stack([
        (word_hashes(_lower[points].astype(np.uint64), sizes, 5) >> shift).astype(np.int64),
        (word_hashes(sign[keep].astype(np.uint64), np.add.reduceat(keep, starts, dtype=np.int64), 6) >> shift).astype(np.int64),
        word_hashes(points.astype(np.uint64), sizes, 7).view(np.int64), sizes, np.add.reduceat(kind & _SYMBOL > 0, starts, dtype=np.int64), letters,
        plain | odd.astype(np.int64) << 1 | upper.astype(np.int64) << 2, np.zeros(len(words), np.int64)])


class Words:
    """The facts of the words of a text, one row each; keeps those of recent words."""

    def __init__(self, entries: int = 200_000):
        self.entries = entries
        self._empty()

    def _empty(self):
        self.index, self.facts = WordIds(), np.zeros((1024, 8), np.int64)

    def of(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The facts of the words of each text; new words of all texts are looked at together."""
        if len(self.index) > self.entries:
            self._empty()
        first = len(self.index)
        found = self.index.of([(text or "").split() for text in texts])
        new = self.index.since(first)
        while len(self.facts) < len(self.index):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        for at in range(0, len(new), 50_000):
            part = new[at:at + 50_000]
            self.facts[first + at:first + at + len(part)] = _facts(part)
        return [self.facts[ids] for ids in found]


def measures(facts: np.ndarray) -> dict[str, float]:
    """What the labellers look at, over the whole text."""
    n, (chars, symbols, letters) = len(facts), facts[:, 3:6].sum(0).tolist()
    flags, word = facts[:, 6], facts[:, 2]
    pairs = word[1:] * 1_000_003 + word[:-1]
    return {
        "words": n, "plain": float((flags & 1).mean()), "odd_ends": float((flags >> 1 & 1).mean()), "no_lower": float((flags >> 2).mean()),
        "symbols": symbols / chars, "letters": letters / chars, "stutter": float((word[1:] == word[:-1]).sum()) / n,
        "variety": min(1.0, len(np.unique(word)) / min(n, 100)), "new_pairs": len(np.unique(pairs)) / (n - 1) if n > 1 else 1.0,
    }


def votes(facts: np.ndarray) -> int | None:
    """The votes as one number in base 3, or null for a text without words."""
    if not len(facts):
        return None
    seen, code = measures(facts), 0
    for name, vote in LABELLERS:
        code = code * 3 + vote(seen[name]) + 1
    return code


def pattern(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        code, vote = divmod(code, 3)
        out.append(vote)
    return out[::-1]


def label_model(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of good by pattern, the vote tables [class, labeller, vote], and the share of good, by EM."""
    if not counts:
        return {}, np.full((2, len(LABELLERS), 3), 1 / 3), 0.5
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    seen = np.array([pattern(c) for c in codes])
    good = 1 / (1 + np.exp(4.0 * ((seen == 0).sum(1) - 1.5)))
    hot = np.eye(3)[seen]
    for _ in range(rounds):
        share = np.clip((n * good).sum() / n.sum(), 1e-6, 1 - 1e-6)
        tables = np.stack([((n * p)[:, None, None] * hot).sum(0) + 1.0 for p in (1 - good, good)])
        tables /= tables.sum(2, keepdims=True)
        log = np.stack([np.log(t)[np.arange(len(LABELLERS)), seen].sum(1) for t in tables])
        new = 1 / (1 + np.exp(np.clip(log[0] + np.log(1 - share) - log[1] - np.log(share), -50, 50)))
        done, good = np.abs(new - good).max() < 1e-9, new
        if done:
            break
    return dict(zip(codes, good.tolist())), tables, float(share)


def features(facts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows and values of a text: its words, their shapes, and words that repeat the one before."""
    if not len(facts):
        return np.empty(0, np.int64), np.empty(0, np.float32)
    rows, counts = np.unique(facts[:, :2], return_counts=True)
    again = float((facts[1:, 2] == facts[:-1, 2]).mean()) if len(facts) > 1 else 0.0
    return np.r_[rows, zlib.crc32(b"again") % BUCKETS], np.r_[counts / len(facts), again].astype(np.float32)


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_scorer(found: list[tuple[np.ndarray, np.ndarray]], goal: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias by stochastic gradient descent on the posteriors ``goal`` of texts with the features ``found``."""
    rng = np.random.default_rng(SEED)
    w, b, g2 = np.zeros(BUCKETS, np.float32), 0.0, np.full(BUCKETS, 1e-4, np.float32)
    for epoch in range(epochs):
        for k in rng.permutation(len(found)):
            at, value = found[k]
            off = _logistic(float(w[at] @ value) + b) - goal[k]
            g = off * value
            g2[at] += g * g
            w[at] -= 0.3 * g / np.sqrt(g2[at])
            b -= 0.05 * off / (1 + epoch)
    return w, b


def weak_labels(docs: DataFrame) -> dict[int, float]:
    """The posterior of good by pattern, from the votes of all rows."""
    def make():
        words = Words()
        return lambda texts: [list(map(votes, words.of(texts)))]

    voted = with_arrow(docs, "text", [T.StructField("votes", T.IntegerType())], make)
    counts = voted.where("votes IS NOT NULL").groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    # At most 3^labellers rows.
    return label_model({r["votes"]: r["n"] for r in counts.collect()})[0]


def sample(docs: DataFrame, rows: int) -> list[tuple[int, list[int], list[float]]]:
    """Votes, table rows and values of a bounded sample: the ``rows`` different texts with the least hash.

    Copies count once. Votes are those of the whole text; the features are those of ``TRAIN_WORDS`` words in a row.
    """
    hashed = docs.where("text IS NOT NULL").select("text", F.xxhash64("text", F.lit(SEED)).alias("hash"))
    texts = hashed.agg(F.approx_count_distinct("hash")).first()[0]
    # Far more hashes than are wanted, but not all of a large table, are told apart and put in order.
    draw = F.pmod(F.col("hash"), F.lit(1_000_003)) / 1_000_003 < 4 * rows / max(1, texts)
    chosen = cut(hashed.where(draw).select("hash").distinct().orderBy("hash").limit(rows))
    found = hashed.join(F.broadcast(chosen), "hash").groupBy("hash").agg(F.first("text").alias("text"))
    fields = [T.StructField("votes", T.IntegerType()), T.StructField("rows", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.DoubleType()))]

    def make():
        words = Words()

        def work(texts):
            facts = words.of(texts)
            parts = [f[(at := zlib.crc32(t[:200].encode()) % max(1, len(f) - TRAIN_WORDS)):at + TRAIN_WORDS] for t, f in zip(texts, facts)]
            at, values = zip(*map(features, parts))
            return list(map(votes, facts)), [a.tolist() for a in at], [v.tolist() for v in values]
        return work

    taken = with_arrow(found.select("text"), "text", fields, make, ["text"]).where("votes IS NOT NULL").collect()
    return sorted((r["votes"], r["rows"], r["values"]) for r in taken)


def quality(docs: DataFrame) -> DataFrame:
    """Add ``votes``, ``weak_label`` (posterior of good), ``score`` and ``kept``."""
    only = docs.select("text")
    posterior = weak_labels(only)
    taken = sample(only, TRAIN_ROWS)
    weights, bias = train_scorer([(np.array(at, np.int64), np.array(value, np.float32)) for _, at, value in taken],
                                 np.array([posterior[code] for code, _, _ in taken]))
    fields = [T.StructField("votes", T.IntegerType()), T.StructField("weak_label", T.DoubleType()), T.StructField("score", T.DoubleType(), False)]

    def make():
        words = Words()

        def work(texts):
            facts = words.of(texts)
            codes = list(map(votes, facts))
            score = [0.0 if code is None else float(_logistic(float(weights[at] @ value) + bias))
                     for code, (at, value) in zip(codes, map(features, facts))]
            return codes, [posterior.get(code) for code in codes], score
        return work

    return with_arrow(docs, "text", fields, make).withColumn("kept", F.col("score") >= 0.5)


def quality_report(docs: DataFrame) -> DataFrame:
    """``doc_id, votes, weak_label, score, kept`` for every row of ``docs``."""
    return quality(docs.select("doc_id", "text")).drop("text")
