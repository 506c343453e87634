"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A bag is a window of ``WINDOW`` words, so that one insult weighs the same in a long text as in a short one; a text's
score is that of its most toxic window, over windows that cover the whole text. Labels are per document, so
training starts with all windows of toxic documents as toxic and then, round by round, keeps those that the
model finds toxic, at least one of each document. Unseen misspellings share n-grams with the words they distort.

The model learns from a bounded sample: about ``TRAIN_ROWS`` toxic and as many clean documents by a hash of the id, at
most ``TRAIN_WINDOWS`` windows of each, spread over the whole text. A fifth of them is set aside for the logistic
curve that turns a text's largest logit into a probability, corrected for the share of toxic labels.

Null and empty texts get the score of a window without words. If the labels have one class only, every score is 0 or 1.
Rows are independent; other columns pass through, columns with the names of the results are replaced. Of repeated
labels of an id the largest counts; null labels don't.
"""

from __future__ import annotations

import zlib
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowline.llm.common import with_arrow
from stowline.llm.langid import fold
from stowline.llm.subword import BUCKETS, Trainer, WordSums, clean_edges, platt

WINDOW = 12
TRAIN_ROWS, TRAIN_WINDOWS = 1_500, 40
LO, HI = 3, 5
ROUNDS = 3
#: Steps of a round at least, so that a small sample is learnt as well.
STEPS = 200


def words(text: str | None) -> list[str]:
    """Lower-case words; a run of one word counts once, else a window would be that word alone."""
    return [word for word, _ in groupby((text or "").lower().split())]


def starts(n: int, step: int) -> range | list[int]:
    """Where the windows over ``n`` words begin; the last one ends with the last word."""
    last = max(0, n - WINDOW)
    return [*range(0, last, step), last]


def windows(found: list[str], most: int) -> list[str]:
    """Windows over the words ``found``; if there are more than ``most``, evenly spread ones."""
    at = starts(len(found), WINDOW)
    chosen = at if len(at) <= most else [at[int(i * len(at) / most)] for i in range(most)]
    return [" ".join(found[i:i + WINDOW]) for i in chosen]


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[list[tuple[int, list[str]]], float]:
    """A bounded sample of (label, windows), and the share of toxic labels."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold() != 0)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect() if r["toxic"] in (0, 1)}
    if not counts:
        return [], 0.0
    share = F.when(F.col("toxic") == 1, rows / max(1, counts.get(1, 0))).otherwise(rows / max(1, counts.get(0, 0)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) / 1_000_003 < share)
    # About 2 * rows ids by the shares above.
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    def make():
        return lambda batch: [[windows(words(t), TRAIN_WINDOWS) for t in batch]]

    field = T.StructField("windows", T.ArrayType(T.StringType()))
    taken = with_arrow(texts, "text", [field], make, ["text"]).limit(6 * rows).collect()
    return sorted((r["toxic"], list(r["windows"])) for r in taken), counts.get(1, 0) / sum(counts.values())


class Model:
    def __init__(self, rows: list[tuple[int, list[str]]], share: float):
        self.table, self.bias = np.zeros((BUCKETS, 2), np.float32), np.zeros(2, np.float32)
        self.curve = (0.0, 30.0 if share else -30.0)
        labels = np.array([label for label, _ in rows])
        if not rows or labels.min() == labels.max():
            return
        trainer = Trainer(2, LO, HI, dim=8)
        flat = iter(trainer.rows([[clean_edges(w) for w in x.split()] for _, found in rows for x in found]))
        bags = [[next(flat) for _ in found] for _, found in rows]
        aside = np.array([zlib.crc32("".join(found).encode()) % 5 == 0 for _, found in rows])
        if labels[~aside].min() == labels[~aside].max() or not aside.any() or labels[aside].min() == labels[aside].max():
            aside[:] = False
        toxic = [i for i, x in enumerate(bags) if not aside[i] and labels[i]]
        clean = [i for i, x in enumerate(bags) if not aside[i] and not labels[i]]

        def flagged(of):
            """For each window of the documents ``of`` how toxic it looks, and whether it is its document's most toxic."""
            z = trainer.logits([b for i in of for b in bags[i]])
            ends = np.cumsum([len(bags[i]) for i in of])[:-1]
            own = np.split(z[:, 1] - z[:, 0], ends)
            return [(b, v, v == w.max()) for i, w in zip(of, own) for b, v in zip(bags[i], w)]

        chosen = [b for i in toxic for b in bags[i]]
        against = [b for i in clean for b in bags[i]]
        for _ in range(ROUNDS):
            # Both classes weigh the same, however many windows each has.
            both, n = chosen + against, (len(chosen), len(against))
            w = np.repeat([len(both) / (2 * k) for k in n], n).astype(np.float32)
            trainer.fit(both, np.repeat([1, 0], n), np.minimum(w, 8), steps=STEPS)
            chosen = [b for b, v, top in flagged(toxic) if v > 0 or top]
            hard = [b for b, v, top in flagged(clean) if v > -2 or top]
            against = hard * 2 + [b for i in clean for b in bags[i]]
        self.table, self.bias = trainer.table(), trainer.b
        test = np.flatnonzero(aside) if aside.any() else np.arange(len(rows))
        top = np.array([(lambda z: (z[:, 1] - z[:, 0]).max())(trainer.logits(bags[i])) for i in test])
        a, b = platt(top, labels[test])
        own = labels[test].mean()
        prior = np.log(share / (1 - share)) - np.log(own / (1 - own)) if 0 < share < 1 else 0.0
        self.curve = (a, b + prior)


def score(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Add ``score``, the probability that a text is toxic."""

    def make():
        sums = WordSums((model.table[:, 1] - model.table[:, 0])[:, None], LO, HI, clean_edges)
        bias = float(model.bias[1] - model.bias[0])

        def work(texts):
            out = []
            for rows in sums.lookup([words(t) for t in texts]):
                n = len(rows)
                total = np.zeros((n + 1, 2))
                np.cumsum(rows, 0, out=total[1:])
                at = np.array(starts(n, WINDOW // 2))
                own = total[np.minimum(at + WINDOW, n)] - total[at]
                logit = float((own[:, 0] / np.maximum(own[:, 1], 1)).max()) + bias
                out.append(1 / (1 + np.exp(-np.clip(model.curve[0] * logit + model.curve[1], -30, 30))))
            return [out]
        return work

    return with_arrow(docs, text, [T.StructField("score", T.DoubleType(), False)], make, [text] * drop_text)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; learns from labelled rows that are not held out."""
    model = Model(*sample(docs, labels, TRAIN_ROWS))
    rows = score(docs.select("doc_id", (fold() == 0).alias("held_out"), "text"), model, drop_text=True)
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
