"""Fill-in-middle, license scan and prefix trie against plain re-computations."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from stowline.llm import fim, licenses, prefix_trie
from stowline.llm.license_rules import KINDS, RULES

DOCS = "doc_id long, text string"


# Fill-in-middle

def cut_plainly(doc_id, text):
    text = text or ""
    units, x = list(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def odd_texts():
    rng = random.Random(3)
    alphabet = ["a", "é", "漢", "😀", " ", "\n", "<", "S", ">", "́"]
    texts = [None, "", "<", "x<P>y", "ends <S", "<M>", "a", "漢", "é" * 40_000 + "a" * 70_000 + "😀" * 30_000]
    return texts + ["".join(rng.choices(alphabet, [9, 3, 2, 1, 3, 1, .2, .2, .2, 1], k=rng.randint(1, 300))) for _ in range(300)]


def test_fill_in_middle_agrees_with_plain_cutting(spark):
    rows = [(None if i == 5 else i, t) for i, t in enumerate(odd_texts())] + [(9, "same"), (9, "same")]
    got = fim.fill_in_middle(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"]) for r in got) == \
        sorted((str(i), len(t or ""), form, str(a), str(b), out) for i, t in rows for form, a, b, out in [cut_plainly(i, t)])
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    report = fim.fim_report(spark.createDataFrame(rows, DOCS)).collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((str(r["doc_id"]), r["output_sha256"], r["restored_sha256"]) for r in report) == \
        sorted((str(i), digest(cut_plainly(i, t)[3]), digest(t or "")) for i, t in rows)


def test_fill_in_middle_with_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc", "mine", 5, "also", 7)], "doc_id long, text string, form string, n long, _kept string, lang long")
    row = fim.fill_in_middle(docs).first()
    assert (row["_kept"], row["lang"], row["n"], row["text"]) == ("also", 7, 3, "abc") and row["form"] in ("plain", "psm", "spm")
    assert fim.fim_report(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("bound", [1, 5, 127])
def test_rank_index_predicts_every_boundary(bound):
    rng = np.random.default_rng(bound)
    sizes = [1, 2, 5000, 1, 300]
    offsets = np.concatenate([np.cumsum(rng.integers(1, 5, n)) for n in sizes])
    starts = np.cumsum([0, *sizes[:-1]])
    index = fim.RankIndex(offsets, starts, bound)
    assert (index.offset(np.arange(len(offsets))) == offsets).all()
    assert np.abs(index.residual.astype(int)).max() <= bound and len(index.first) < len(offsets)


# License scan

def scan_plainly(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words))
            if words[i:i + len(phrase.split())] == phrase.split()]
    line = " " + "".join(w + " " for w in words)
    spans = []
    for i, rule in enumerate(RULES):
        for m in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", line):
            start = line[:m.start()].count(" ") - 1
            spans.append((start, start + m.group().count(" ") + 1, list(KINDS).index(rule.kind), i, rule.label))
    kept = [s for s in spans if not any(
        o[0] <= s[0] and s[1] <= o[1] and (o[2] < s[2] or o[2] == s[2] and (o[1] - o[0] > s[1] - s[0] or (o[:2] == s[:2] and o[3] < s[3])))
        for o in spans)]
    labels = {label for _, label in base}
    first = {}
    for start, stop, kind, _, label in sorted(kept):
        first.setdefault((label, list(KINDS)[kind]), (start, stop))
    return (len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {s[4] for s in kept})), max([0.5] * bool(base) + [0.0] + [list(KINDS.values())[s[2]] for s in kept]),
            sorted((label, kind, *at) for (label, kind), at in first.items()))


def license_texts():
    rng = random.Random(5)
    parts = ["MIT License", "mit license mit license", "Apache License, Version 2.0", "licensed under the", "GNU General Public License", "version 3",
             "GNU Lesser General Public License v2.1 or later", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: (MIT OR Apache-2.0)",
             "Released under the terms of the", "BSD 3-Clause", "the new BSD licence", "public domain", "cc by-nc-sa 4.0", "CC BY 4.0", "lİcense", "word", "Ünï",
             "Redistributions of source code must retain the above copyright notice", "http://www.apache.org/licenses/LICENSE-2.0", "general public license",
             "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License", "\n", "*", "the Unlicense", "mit"]
    texts = [None, "", " .,; ", "\x00\x01 MIT\x02License", "MIT License " * 3000]
    return texts + [rng.choice([" ", ", ", "\n// "]).join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(250)]


def test_license_scan_agrees_with_all_pairs(spark):
    texts = license_texts()
    got = {r["doc_id"]: r for r in licenses.license_report(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        mine = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"],
                sorted((x["label"], x["kind"], x["start"], x["stop"]) for x in r["licenses"]))
        if i == 4:  # all pairs of its spans would take too long
            assert mine[:6] == (6000, 3000, 0, 5998, "mit", "mit")
        else:
            assert mine == scan_plainly(text), text


def test_license_rules_are_many_and_ordered():
    assert len(RULES) > 300 and [list(KINDS).index(r.kind) for r in RULES] == sorted(list(KINDS).index(r.kind) for r in RULES)
    assert all(k and re.compile(r.pattern) for r in RULES for k in r.keywords)


def test_license_scan_with_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([("The MIT license", "x", "y", 3)], "text string, labels string, _words string, _kept int")
    row = licenses.scan(docs).first()
    assert (row["text"], row["labels"], row["_words"], row["_kept"]) == ("The MIT license", "mit", "y", 3)
    assert licenses.license_report(spark.createDataFrame([], DOCS)).count() == 0


# Prefix trie

def trie_plainly(paths):
    nodes = {}
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(conv)
    kids = {}
    for key in nodes:
        if key:
            kids.setdefault(key[:-1], []).append(key)

    def below(key):
        own = (len(nodes[key]) - 1) * len(key[-1][1]) if key else 0
        parts = [below(k) for k in kids.get(key, [])]
        return (sum(p[0] for p in parts) if parts else 1, own + sum(p[1] for p in parts))

    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids.get(key, [])), *below(key),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def as_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[n] for n in names) for r in df.select(*names).collect())


def some_paths():
    rng = random.Random(11)
    turns = [("user", "hello"), ("user", ""), ("", "hello"), ("assistant", "é😀"), ("user", "hello there")]
    paths = {c: [rng.choice(turns[:3]) for _ in range(rng.randint(0, 9))] for c in range(120)}
    paths |= {200 + c: [turns[3]] * (c % 40) for c in range(80)}
    return paths | {1000 + c: [turns[4], turns[0]] for c in range(60)} | {2000: [turns[4]]}


@pytest.mark.parametrize("segment, keys", [(512, 1_000_000), (3, 1_000_000), (4, 30)])
def test_trie_agrees_with_all_prefixes(spark, monkeypatch, segment, keys):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "TRIE_KEYS", keys)
    paths = some_paths()
    turns = [(c, d + 1, role or None, text or None) for c, path in paths.items() for d, (role, text) in enumerate(path)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(turns, "conv_id long, depth long, role string, text string"),
                                  spark.createDataFrame([(c,) for c in paths], "conv_id long"))
    assert as_rows(got) == trie_plainly(paths)


def test_exit_node_is_the_longest_common_prefix():
    rng = random.Random(2)
    trie, known = prefix_trie.Trie(), []
    for n in range(300):
        word = [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        if known and rng.random() < 0.5:
            word = rng.choice(known)[:rng.randint(0, 40)] + word
        path = b"".join(hashlib.md5("".join(word[:d + 1]).encode()).digest() for d in range(len(word)))
        root = trie.roots.get((0, bytes(16)))
        if root is not None:
            common = max(next((i for i, (x, y) in enumerate(zip(w, word)) if x != y), min(len(w), len(word))) for w in known)
            assert trie.exit(root, path)[1] == common
        trie.insert(0, bytes(16), path, np.zeros(len(word), np.int64), (1, 0), n)
        known.append(word)


def test_rebuilt_conversations(spark):
    rng = random.Random(4)
    rows = [(c, None if t == 2 and c % 7 == 0 else t, rng.choice(["user", None]), f"{c % 3} {t}" if rng.random() < .9 else None)
            for c in [*range(0, 30), *range(100, 130), *range(205, 240)] for t in range(rng.randint(1, 8))]
    rows += [(None, 0, "user", "nobody's")]
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    got = prefix_trie.trie_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert as_rows(got) == trie_plainly(paths)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie_report(empty).count() == 0
    none = spark.createDataFrame([], "conv_id long, depth long, role string, text string")
    got = prefix_trie.prefix_trie(none, spark.createDataFrame([(3,), (12,)], "conv_id long"))
    assert as_rows(got) == trie_plainly({3: [], 12: []})


def test_trie_ignores_other_columns(spark):
    rows = spark.createDataFrame([(0, 0, "user", "a", 5, "x"), (1, 0, "user", "b", 6, "y")],
                                 "conv_id long, turn long, role string, text string, depth long, cells string")
    assert {r["depth"] for r in prefix_trie.trie_report(rows).collect()} >= {0}
