"""Language ID: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

The model learns from a bounded sample of (text, lang): at most ``TRAIN_ROWS`` different texts, shared equally among the
languages (one of each at least), and ``TRAIN_WORDS`` consecutive words of each from a place that depends on its hash. Every fifth
sampled row is set aside: it sets the softmax temperature and the rejection threshold, the score that all but
``REJECT_SHARE`` of its rightly predicted rows reach (never above ``REJECT_MOST``). Prediction reads whole texts.

Text that is null or has no letter is ``und`` with score 0 and is rejected. Without any labelled row all is ``und``.
Rows are independent; other columns pass through, and columns with the names of the results are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowline.llm.common import cut, lookup_join, with_arrow
from stowline.llm.subword import BUCKETS, Trainer, WordSums, clean_letters, give_back, softmax

TRAIN_ROWS, TRAIN_WORDS = 6_000, 60
LO, HI = 1, 4
EPOCHS, STEPS = 6, 150
REJECT_SHARE, REJECT_MOST = 0.001, 0.5


def fold() -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5


def sample(labelled: DataFrame, rows: int, words: int) -> list[tuple[str, str]]:
    """A bounded sample of (lang, words): of each language the same number of different texts, those with the least hash.

    Copies count once, so that a text that fills its language is drawn like any other. At most ``rows`` texts, or one of each language.
    """
    hashed = labelled.withColumn("hash", F.xxhash64("text", F.lit(3)))
    known = cut(hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("hash").alias("texts")))
    langs = known.count()
    if not langs:
        return []
    each = max(1, rows // langs)
    # Far more hashes than are wanted, but not all of a large table, are told apart and put in order.
    draw = F.pmod(F.col("hash"), F.lit(1_000_003)) / 1_000_003 < F.lit(max(64.0, 4.0 * each)) / F.col("texts")
    texts = lookup_join(hashed.select("lang", "hash"), known, ["lang"], "n", "inner").where(draw).select("lang", "hash").distinct()
    order = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = texts.withColumn("at", order).where(F.col("at") <= each).select("lang", "hash")
    # At most ``rows`` hashes, or one of each language.
    found = hashed.join(F.broadcast(cut(chosen)), ["lang", "hash"]).groupBy("lang", "hash").agg(F.first("text").alias("text"))

    def make():
        def some_words(texts):
            out = []
            for text in texts:
                tokens = text.split()
                at = zlib.crc32(text[:200].encode()) % max(1, len(tokens) - words)
                out.append(" ".join(tokens[at:at + words]))
            return [out]
        return some_words

    taken = with_arrow(found.select("lang", "text"), "text", [T.StructField("words", T.StringType())], make, ["text"]).collect()
    return sorted((r["lang"], r["words"]) for r in taken if r["words"])


class Model:
    """The folded table, bias, temperature and threshold; about BUCKETS x languages x 4 bytes."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in rows})
        self.table, self.bias, self.heat, self.least = np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), 1.0, 0.0
        if not rows:
            return
        at = {lang: i for i, lang in enumerate(self.langs)}
        trainer = Trainer(len(self.langs), LO, HI)
        bags = trainer.rows([[clean_letters(w) for w in text.lower().split()] for _, text in rows])
        labels = np.array([at[lang] for lang, _ in rows])
        aside = np.array([zlib.crc32(text.encode()) % 5 == 0 for _, text in rows])
        trainer.fit([bags[i] for i in np.flatnonzero(~aside)], labels[~aside], epochs=EPOCHS, steps=STEPS)
        self.table, self.bias = trainer.table(), trainer.b
        if aside.any():
            z, right = trainer.logits([bags[i] for i in np.flatnonzero(aside)]), labels[aside]
            self.heat = min((0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 5.0),
                            key=lambda t: -np.log(softmax(z / t)[np.arange(len(right)), right] + 1e-12).mean())
            p = softmax(z / self.heat)
            good = p.max(1)[p.argmax(1) == right]
            self.least = float(min(REJECT_MOST, np.quantile(good, REJECT_SHARE))) if len(good) else 0.0


def train(docs: DataFrame) -> Model:
    """Learn from the rows of ``docs`` (text, lang) whose lang is not null."""
    model = Model(sample(docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang"), TRAIN_ROWS, TRAIN_WORDS))
    give_back()
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected``."""
    fields = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False),
              T.StructField("rejected", T.BooleanType(), False)]

    def make():
        sums = WordSums(model.table, LO, HI, clean_letters)

        def work(texts):
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            if model.langs:
                some = [i for i, t in enumerate(texts) if t]
                for i, rows in zip(some, sums.lookup([texts[i].lower().split() for i in some])):
                    total = rows.sum(0, dtype=np.float64)
                    if total[-1] and any(map(str.isalpha, texts[i])):
                        p = softmax((total[:-1] / total[-1] + model.bias) / model.heat)
                        best = int(p.argmax())
                        pred[i], score[i] = model.langs[best], float(p[best])
            return pred, score, [lang == "und" or s < model.least for lang, s in zip(pred, score)]
        return work

    return with_arrow(docs, text, fields, make, [text] * drop_text)


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row; learns from the rows that are not held out."""
    model = train(docs.where(fold() != 0))
    rows = docs.select("doc_id", (fold() == 0).alias("held_out"), "text")
    return predict(rows, model, drop_text=True)
