"""Quality, toxicity and language ID against slow scorers with the same weights; odd labels; odd rows in the pipeline."""

import math
import random
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pytest

import corpus_pipeline
from stowline.llm import langid, subword, toxicity, weak_quality

M64 = 2**64 - 1
STEP, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
ODD = [None, "", "  ", "123 !!", "x", "🙂" * 10, "w" * 3000, "word " * 600, "É é İstanbul ß ǆ"]


def mixed(h, salt):
    h = (h ^ salt * 0x2545F4914F6CDD1D & M64) * MIX & M64
    h = (h ^ h >> 32) * STEP & M64
    return h ^ h >> 29


def rows_of(word, lo, hi):
    """Table rows of a word, one n-gram after the other."""
    if not word:
        return []
    points, bits = [ord(c) for c in f"<{word}>"], 64 - (subword.BUCKETS.bit_length() - 1)
    out = []
    for k in range(lo, hi + 1):
        for i in range(len(points) - k + 1):
            h = 0
            for p in points[i:i + k]:
                h = (h * STEP + p + 1) & M64
            out.append(mixed(h, k) >> bits)
    whole = sum((p + 1) * pow(STEP, i, 2**64) for i, p in enumerate(points)) & M64
    return [*out, mixed(whole, 99) >> bits]


@pytest.mark.parametrize("lo, hi", [(1, 4), (3, 5)])
def test_grams_agree_with_loops(lo, hi):
    rng = random.Random(lo)
    words = ["", "a", "ab", "é漢😀"] + ["".join(rng.choice("abcé漢😀") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    flat, sizes = subword.grams(words, lo, hi)
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    assert [sorted(p.tolist()) for p in parts] == [sorted(rows_of(w, lo, hi)) for w in words]


def some_texts(n, seed):
    rng = random.Random(seed)
    vocab = {"xx": "the of and this with ring thing".split(), "yy": "que les dans avec pour été où".split()}
    rows = [(i, " ".join(rng.choice(vocab[lang]) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(3, 80))), lang)
            for i in range(n) for lang in [rng.choice(["xx", "yy"])]]
    return rows + [(10_000 + i, t, "xx") for i, t in enumerate(ODD)]


def test_language_scores_agree_with_a_slow_scorer(spark):
    rows = some_texts(200, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    for r in langid.predict(docs, model).collect():
        bag = [x for w in (r["text"] or "").lower().split() for x in rows_of("".join(c for c in w if c.isalpha()), langid.LO, langid.HI)]
        if not bag or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        z = [(sum(float(model.table[x, k]) for x in bag) / len(bag) + float(model.bias[k])) / model.heat for k in range(len(model.langs))]
        p = [math.exp(v - max(z)) for v in z]
        assert r["lang_pred"] == model.langs[int(np.argmax(p))] and r["score"] == pytest.approx(max(p) / sum(p), abs=1e-4)
        assert r["rejected"] == (r["score"] < model.least)


def test_a_language_of_one_text_is_learnt(spark):
    rows = [(i, "que les dans avec pour", "yy") for i in range(3000)] + [(5000 + i, f"the of and this with ring {i}", "xx") for i in range(3000)]
    got = langid.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {(r["lang_pred"], r["doc_id"] < 5000) for r in got.select("lang_pred", "doc_id").collect()} == {("yy", True), ("xx", False)}
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("text", "lang")
    drawn = Counter(lang for lang, _ in langid.sample(labelled, 40, 10))
    assert drawn["yy"] == 1 and 10 <= drawn["xx"] <= 20


def test_toxicity_scores_agree_with_a_slow_scorer(spark):
    rng = random.Random(7)
    rows = [(i, t + (" vile idiot" if i % 3 == 0 else "")) for i, t, _ in some_texts(150, 2) if t]
    docs = spark.createDataFrame(rows + [(20_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.Model(*toxicity.sample(docs, labels, 200))
    got = toxicity.score(docs, model).collect()
    for r in rng.sample(got, 60):
        words = [w for w, _ in groupby((r["text"] or "").lower().split())]
        starts = [*range(0, max(0, len(words) - toxicity.WINDOW), toxicity.WINDOW // 2), max(0, len(words) - toxicity.WINDOW)]
        logits = []
        for at in starts:
            bag = [x for w in words[at:at + toxicity.WINDOW] for x in rows_of(w.strip(".,;:!?\"'()[]|*$%&#"), toxicity.LO, toxicity.HI)]
            logits.append(sum(float(model.table[x, 1]) - float(model.table[x, 0]) for x in bag) / max(1, len(bag)))
        z = model.curve[0] * (max(logits) + float(model.bias[1] - model.bias[0])) + model.curve[1]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=2e-3)


@pytest.mark.parametrize("marks", [[], [(1, None), (2, None)], [(i, 0) for i in range(50)], [(i, 1) for i in range(50)], [(None, 1)]])
def test_toxicity_without_two_classes(spark, marks):
    docs = spark.createDataFrame([(i, t) for i, t, _ in some_texts(40, 3)], "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.toxicity_report(docs, labels).collect()
    share = len(marks) == 50 and marks[0][1] == 1
    assert len(got) == 40 + len(ODD) and all(r["predicted"] == int(share) and 0 <= r["score"] <= 1 for r in got)


def plain_measures(text):
    words = text.split()
    n = len(words)
    flat = "".join(words)
    odd = sum(not (w[-1].isalnum() or w[-1] in ".,;:!?\"')" and (len(w) < 2 or w[-2].isalnum())) for w in words)
    pairs = list(zip(words[1:], words))
    return {
        "words": n, "odd_ends": odd / n, "no_lower": sum(w == "|" or len(w) > 1 and w == w.upper() for w in words) / n,
        "plain": sum(weak_quality._PLAIN.fullmatch(w) is not None or w.isalpha() or w[:-1].isalpha() and w[-1] in ".,;:!?" for w in words) / n,
        "symbols": len(re.findall(r"[^\w\s.,;:!?'\"()\-]", flat)) / len(flat), "letters": sum(map(str.isalpha, flat)) / len(flat),
        "stutter": sum(a == b for a, b in pairs) / n, "variety": min(1.0, len(set(words)) / min(n, 100)),
        "new_pairs": len(set(pairs)) / (n - 1) if n > 1 else 1.0}


def test_measures_and_votes_agree_with_loops():
    rng = random.Random(8)
    texts = [t for _, t, _ in some_texts(80, 4) if t and t.split()]
    texts += [" ".join(rng.choice(["Ab", "AB!!", "a-b", "x***", "|", "12", "don't", "(so)", "é😀", "end."]) for _ in range(rng.randint(1, 150))) for _ in range(80)]
    for text, facts in zip(texts, weak_quality.Words().of(texts)):
        mine, own = weak_quality.measures(facts), plain_measures(text)
        assert mine == pytest.approx(own), text
        code = 0
        for name, vote in weak_quality.LABELLERS:
            code = code * 3 + vote(own[name]) + 1
        assert weak_quality.votes(facts) == code
    assert weak_quality.votes(weak_quality.Words().of([None])[0]) is None


def test_shapes_tell_words_apart():
    shape = lambda *words: weak_quality._facts(list(words))[:, 1].tolist()
    a, b, c, d, e = shape("hello", "goodbye", "Hello", "HELLO", "h3llo")
    assert a == b and len({a, c, d, e}) == 4


def test_quality_sample_counts_copies_once(spark):
    rows = [("good plain words in a long enough text",)] * 500 + [(f"text number {i} has words of its own",) for i in range(60)]
    taken = weak_quality.sample(spark.createDataFrame(rows, "text string"), 30)
    assert len(taken) == 30
    assert len(weak_quality.sample(spark.createDataFrame(rows, "text string"), 1000)) == 61


PIPELINE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("kind", ["odd", "unlabelled", "empty", "extra"])
def test_pipeline_takes_odd_rows(spark, tmp_path, kind):
    rows = [(i, t, None if kind == "unlabelled" else lang, f"s{i % 3}", len(t or "")) for i, t, lang in some_texts(60, 5)]
    rows += [(None, None, None, None, None), (3, rows[3][1], rows[3][2], None, 1), (70, rows[4][1], None, "s1", 1)]
    docs = spark.createDataFrame([] if kind == "empty" else rows, PIPELINE)
    if kind == "extra":
        docs = docs.selectExpr("*", "'mine' _row", "1 size", "'t' target", "'h' hash", "'r' rejected", "2 times")
    columns = docs.columns
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, table, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        table = spark.read.parquet(str(tmp_path / str(k)))
        assert table.columns == columns
        if kind == "unlabelled" and k == 0:
            # Nothing can be told without labels, so nothing goes.
            assert table.count() == len(rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["decodes"] for r in got) and (len(got) > 20) == (kind != "empty")
