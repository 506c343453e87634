"""The Jaccard join, components, span dedup and fingerprints against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from stowline.llm import common, imatch, jaccard, span_dedup
from stowline.llm.components import components

VOCAB = [f"w{i}" for i in range(400)]


def corpus(seed=1):
    """Random texts with copies, near copies in chains, a large near group, short, empty and null texts."""
    rng, rows = random.Random(seed), []
    text = lambda n: [rng.choice(VOCAB) for _ in range(n)]

    def changed(words, k):
        words = list(words)
        for _ in range(k):
            words[rng.randrange(len(words))] = rng.choice(VOCAB)
        return words

    for _ in range(40):
        rows.append(text(rng.randint(1, 120)))
    base = text(150)
    rows += [changed(base, rng.randint(0, 3)) for _ in range(40)] + [base] * 5
    for _ in range(8):
        one = text(100)
        for _ in range(4):
            rows.append(one)
            one = changed(one, 2)
    rows += [["a", "b"], ["a", "b"], ["a", "b", "c"], text(4000)]
    out = [(i, " ".join(w)) for i, w in enumerate(rows)]
    out += [(900, ""), (901, None), (902, " \n"), (None, " ".join(base)), (5, out[5][1]), (903, out[40][1].replace(" ", "  "))]
    rng.shuffle(out)
    return out


def shingles(text):
    words = (text or "").split()
    return frozenset(tuple(words[i:i + min(5, len(words))]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    degree = Counter()
    for i in range(len(rows)):
        for j in range(i):
            common_ = len(sets[i] & sets[j])
            if sets[i] and common_ * 5 >= 4 * (len(sets[i]) + len(sets[j]) - common_):
                degree[i] += 1
                degree[j] += 1
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for own in groups.values():
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        out += [(rows[i][0], min(ids, default=None), degree[i]) for i in own]
    return Counter(out), len(groups)


@pytest.mark.parametrize("pairs_up_to, block, small", [(8, 128, True), (2, 4, True), (1, 16, False)])
def test_jaccard_join(spark, tmp_path, monkeypatch, pairs_up_to, block, small):
    monkeypatch.setattr(jaccard, "PAIRS_UP_TO", pairs_up_to)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    if not small:
        monkeypatch.setattr(jaccard, "few", lambda *a: False)
        monkeypatch.setattr(common, "few", lambda *a: False)
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = jaccard.near_duplicate_report(docs).collect()
    wanted, groups = brute(rows)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == wanted
    assert sum(r.kept for r in got) == groups
    if pairs_up_to == 8:
        kept = jaccard.near_dedup(docs)
        assert kept.columns == docs.columns and kept.count() == groups
        assert jaccard.near_duplicate_report(docs.limit(0)).count() == 0


def test_pruning_keeps_what_can_reach_the_threshold():
    limits = jaccard.least_matches()
    assert [n for n, _ in limits] == [25, 50, 75, 100, 125]
    # The posterior of the similarity after m matches of n, by numeric integration over a uniform prior.
    x = (np.arange(200_000) + 0.5) / 200_000
    for n, m in limits:
        above = {k: (d := x ** k * (1 - x) ** (n - k))[x >= jaccard.THRESHOLD].sum() / d.sum() for k in (m - 1, m)}
        assert above[m - 1] < jaccard.TOLERANCE <= above[m]
    a = np.arange(250, dtype=np.uint32).reshape(2, 125)
    b = a.copy()
    b[0, ::10] += 1000
    i, j = jaccard.plausible(a, b)
    assert list(zip(i, j)) == [(0, 0), (1, 1)]


def test_long_bands_split_a_cluster_by_a_shared_passage(spark):
    assert (1 - jaccard.THRESHOLD ** jaccard.LONG_ROWS) ** jaccard.LONG_BANDS < 1e-4
    rng = random.Random(5)
    words = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    shared, rows = words(60), []
    for group in range(60):
        own = words(90)
        for copy in range(3):
            rows.append((len(rows), group, " ".join(shared + own + [f"x{copy}"])))
    shingler = jaccard.Shingler()
    made = [(c, 0 if c < 150 else 150, shingler.shingles(t).tobytes()) for c, _, t in rows]
    got = jaccard._split(spark.createDataFrame(made, "c long, root long, shingles binary")).collect()
    # Texts with a third in common part; the near ones stay together, and nothing crosses the clusters there were.
    assert {r.node: r.root for r in got} == {c: c - c % 3 for c, _, _ in rows}
    same = [(c, 0 if c < 4 else 150, made[0][2]) for c in range(8)]
    got = jaccard._split(spark.createDataFrame(same, "c long, root long, shingles binary")).collect()
    assert {r.node: r.root for r in got} == {c: c - c % 4 for c in range(8)}


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (7, 9), (2, 1)] + [(20, k) for k in range(30, 60)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 20, **{k: 20 for k in range(30, 60)}, **{k: 100 for k in range(100, 141)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_units_are_the_whole_text():
    for text in ("A b c. D e 1.5 f! G\nh i\n\n" + "w " * 40 + ". End", "", "x", "\n\n", "a.b.c", "..", " lead. tail ", "no end " * 30):
        parts = span_dedup.units(text)
        assert "".join(text[a:b] for a, b, _ in parts) == text
        assert all(n <= span_dedup.UNIT_WORDS for _, _, n in parts) and sum(n for _, _, n in parts) == len(text.split())


@pytest.mark.parametrize("small", [None, 0, 1500])
def test_span_dedup(spark, tmp_path, monkeypatch, small):
    if small is not None:
        # Every repeated hash is hot, the map has few bits, and what is lost is not broadcast.
        monkeypatch.setattr(span_dedup, "HOT_ROWS", 2)
        monkeypatch.setattr(span_dedup, "FILTER_BITS", 64)
        monkeypatch.setattr(span_dedup, "LOST_BYTES", small)
        monkeypatch.setattr(common, "few", lambda *a: False)
    rng = random.Random(3)
    sentence = lambda: " ".join(rng.choice(VOCAB) for _ in range(rng.randint(3, 20))) + ". "
    passage = "".join(sentence() for _ in range(6))
    rows = [(i, "".join(sentence() for _ in range(5)) + (passage if i % 3 == 0 else "") + "".join(sentence() for _ in range(3))) for i in range(20)]
    rows += [(50, passage + "x y. " + passage), (51, rows[1][1]), (52, None), (53, ""), (1, rows[1][1]), (None, passage)]
    spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, gone string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = span_dedup.span_dedup(docs).collect()
    assert len(got) == len(rows) and all(r.gone == "mine" for r in got)
    first = {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for a, b, u, _ in span_dedup._hashed(text or ""):
            first.setdefault((a, b), (i, u))
    wanted = Counter()
    for i, text in rows:
        gone = [{"first": u, "last": v} for a, b, u, v in span_dedup._hashed(text or "") if first[a, b] != (i, u)]
        wanted[(i, *span_dedup.without(text, gone))] += 1
    assert Counter((r.doc_id, r.text, r.removed_units, r.removed_words) for r in got) == wanted
    by = {r.doc_id: r for r in got}
    assert passage in by[0].text and passage[:40] not in by[3].text and by[4].text == dict(rows)[4]
    assert span_dedup.span_dedup(docs.limit(0)).count() == 0


def test_span_dedup_numbers_null_texts(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n: "".join(" ".join(rng.choice(VOCAB) for _ in range(9)) + ". " for _ in range(n))
    passage = text(8)
    rows = [(0, None), (1, text(2)), (2, text(1) + passage), (3, None), (4, text(1)), (5, passage + text(1)), (6, text(9))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in span_dedup.span_report(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert {i: r.text for i, r in got.items() if i != 5} == dict(r for r in rows if r[0] != 5)
    assert got[5].text == rows[5][1][len(passage):] and [i for i, r in got.items() if r.changed] == [5]


def test_span_dedup_finds_passages_at_any_phase(spark, tmp_path):
    rng, fresh = random.Random(5), iter(range(10**6))
    new = lambda n: [f"u{next(fresh)}" for _ in range(n)]

    def passage(kind):
        # Without a sentence end; with ends at random; of three sentences of 17 words; of short ones.
        words = new(51 if kind == 2 else rng.randint(50, 80))
        every = {0: 999, 1: rng.randint(4, 25), 2: 17, 3: 5}[kind]
        return [w + rng.choice((".", "!", "?\u00bb", "\u3002")) if i % every == every - 1 and i < len(words) - 1 else w for i, w in enumerate(words)]

    rows, planted = [], []
    for case in range(60):
        own = passage(case % 4)
        for _ in range(2):
            before, behind = new(rng.randint(1, 40)), new(rng.randint(1, 40))
            rows.append((len(rows), " ".join(before + own + behind) + "."))
            planted.append((len(before), len(own)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in span_dedup.span_report(spark.read.parquet(str(tmp_path / "d"))).collect()}
    # Brute force: a word may go if it is in a run of SPAN_WORDS words that an earlier text has.
    seen = set()
    for (i, text), (start, length) in zip(rows, planted):
        words, n = text.split(), span_dedup.SPAN_WORDS
        runs = [tuple(words[k:k + n]) for k in range(len(words) - n + 1)]
        may = {k + j for k, run in enumerate(runs) if run in seen for j in range(n)}
        seen.update(runs)
        assert len(may) == (length if i % 2 else 0)
        left = got[i].text.split()
        gone = [k for k, w in enumerate(words) if w not in set(left)]
        assert left == [w for k, w in enumerate(words) if k not in set(gone)] and set(gone) <= may
        edge = 2 * span_dedup.WINDOW - 2
        assert got[i].removed_words == len(gone)
        if i % 2:
            assert set(range(start + edge, start + length - edge)) <= set(gone) and gone


def plain_mix(h):
    h &= 2**64 - 1
    h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    h = (h ^ h >> 29) * 0x94D049BB133111EB & (2**64 - 1)
    return h ^ h >> 32


def plain_marks(text, band):
    """One entry per subset, a term at a time."""
    terms = sorted({xxhash.xxh3_64_intdigest(w) - 2**63 for w in text.lower().split()})
    kept = [t for t in terms if t in band]
    if not kept:
        whole = xxhash.xxh3_64_intdigest(b"".join(t.to_bytes(8, "little", signed=True) for t in terms))
        return [plain_mix(whole ^ k) >> 32 | 1 if terms else 0 for k in range(80)]
    out = []
    for k in range(80):
        held = [t for t in kept if plain_mix(t % 2**64 ^ 0x9E3779B97F4A7C15 * (k + 11) % 2**64) >> (63 - k // 8) == 0]
        out.append(plain_mix(sum(plain_mix(t % 2**64) for t in held) % 2**64 ^ k) >> 32 | 1 if held else 0)
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    scales = [[(x, y) for x, y in zip(a[i:i + 8], b[i:i + 8]) if x or y] for i in range(0, 80, 8)]
    return max(sum(x == y for x, y in scale) / max(4, len(scale)) for scale in scales)


def test_fingerprints(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_CHARS", 3000)
    rng = random.Random(4)
    rows = [(i * 7 % 101, " ".join(rng.choice(VOCAB[:200]) for _ in range(rng.randint(1, 60)))) for i in range(101)]
    # Texts without a term of the band are alike only if they have the same terms.
    rows += [(200, None), (201, ""), (202, rows[0][1]), (203, "common one"), (204, "common"), (205, " common  common")]
    rows += [(210 + i, f"common u{i}") for i in range(8)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in imatch.fingerprint_report(docs).collect()}
    down = sorted(rows, reverse=True)
    assert len(got) == len(down)
    seen = Counter(w for _, t in rows for w in set((t or "").split()))
    band = {w for w, n in seen.items() if max(2, imatch.LEAST * len(rows)) <= n <= max(2, imatch.MOST * len(rows))}
    terms = imatch.Terms()
    lexicon = imatch.lexicon(docs)
    assert sorted(lexicon.tolist()) == sorted(terms.hashes(" ".join(band)).tolist())
    for (i, text), (_, following) in zip(down, down[1:] + down[:1]):
        text, following = text or "", following or ""
        k = len(text) // 3
        edited = text[:len(text) - k] + following[:k]
        row = got[i]
        known = set(lexicon.tolist())
        mine, new, other = (plain_marks(t, known) for t in (text, edited, following))
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (row.fingerprint, row.edited_fingerprint) == tuple("-".join(f"{m:x}" if m else "" for m in x) for x in (mine, new))
        assert (row.near_edited, row.near_next) == pytest.approx((plain_likeness(mine, new), plain_likeness(mine, other)))
    assert got[204].fingerprint == got[205].fingerprint != got[203].fingerprint and got[205].near_next == 1.0
    assert got[204].near_next == got[212].near_next == 0.0
    assert got[202].fingerprint == got[rows[[r[1] for r in rows].index(dict(rows)[202])][0]].fingerprint
    # Ties and null ids: as many rows as there are, in any order among equals.
    tied = spark.createDataFrame([(1, "a b c")] * 5 + [(None, "d e f")] * 4 + [(1, None)], "doc_id long, text string")
    tied.write.parquet(str(tmp_path / "t"))
    assert imatch.fingerprint_report(spark.read.parquet(str(tmp_path / "t"))).count() == 10
    assert imatch.fingerprint_report(docs.limit(0)).count() == 0
