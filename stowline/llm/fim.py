"""Fill-in-middle over a piecewise-linear learned rank index.

A text is cut at two of its ``n`` + 1 code-point boundaries. Texts are UTF-8, so that the k-th boundary is at an unknown
byte. The index learns the map from rank k to byte offset: line segments are fitted to *all* boundary offsets of a chunk of
texts, each of them off by at most ``BOUND`` bytes (a segment that is further off is halved until it isn't), and what a
segment is off at each rank is stored in one byte. A cut is predicted by its segment's line and put right by the stored
residual, which is exact. A text of one-byte characters is a single segment without residuals; a text of mixed
widths has a few; a very long text has as many as it needs, and nothing is searched or decoded.

Which texts are cut, where and into which form depends on ``doc_id``, ``seed`` and the text alone (``plan``). Cuts run
as Arrow batches, a chunk of some ``CHUNK_BYTES`` of text (at least one text) at a time; there is no shuffle.

Null text counts as empty; an empty text, and one that contains a sentinel, stays plain. A null doc_id counts as an empty
string. Equal rows get equal results, an empty table an empty one. Other columns pass through; columns with the names of the
results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.llm.common import text_chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that stay plain, and percent of the others in suffix-prefix-middle order.
PLAIN, SPM = 10, 20
SEED = 1
#: Bytes by which a segment's line may be off; residuals are stored in signed bytes.
BOUND = 127


class RankIndex:
    """Byte offsets of ranks, for several texts one after the other.

    ``offsets`` are the byte offsets of all boundaries of all texts, and ``starts`` the place of each text's first one.
    """

    def __init__(self, offsets: np.ndarray, starts: np.ndarray, bound: int = BOUND):
        self.residual = np.zeros(len(offsets), np.int8)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        first, end = starts, np.append(starts[1:], len(offsets))
        while len(first):
            size = end - first
            low = offsets[first]
            slope = (offsets[end - 1] - low) / np.maximum(size - 1, 1)
            begin = np.cumsum(size) - size
            at = np.arange(int(size.sum())) - np.repeat(begin - first, size)
            off = offsets[at] - np.repeat(low, size) - np.repeat(slope, size) * (at - np.repeat(first, size))
            # The line in the middle of the band that holds all points.
            base = low + (np.maximum.reduceat(off, begin) + np.minimum.reduceat(off, begin)) / 2
            left = offsets[at] - self._line(np.repeat(base, size), np.repeat(slope, size), at - np.repeat(first, size))
            fits = np.maximum.reduceat(np.abs(left), begin) <= bound
            of_fit = np.repeat(fits, size)
            self.residual[at[of_fit]] = left[of_fit]
            done.append((first[fits], base[fits], slope[fits]))
            # Two points always fit their line, so every half gets there.
            half = (first + size // 2)[~fits]
            first, end = np.ravel(np.column_stack([first[~fits], half])), np.ravel(np.column_stack([half, end[~fits]]))
        order = np.argsort(np.concatenate([f for f, _, _ in done])) if done else np.empty(0, np.int64)
        self.first, self.base, self.slope = ((np.concatenate(x)[order] if done else np.empty(0)) for x in zip(*done)) if done else (order, order, order)

    @staticmethod
    def _line(base, slope, steps):
        return np.rint(base + slope * steps).astype(np.int64)

    def offset(self, at: np.ndarray) -> np.ndarray:
        """The byte offsets of the boundaries with numbers ``at``: predicted by the segment, corrected by the residual."""
        segment = np.searchsorted(self.first, at, side="right") - 1
        return self._line(self.base[segment], self.slope[segment], at - self.first[segment]) + self.residual[at]


def cuts(data: np.ndarray, text_ends: np.ndarray, ranks: list[np.ndarray]) -> list[np.ndarray]:
    """Byte offsets in ``data`` of the boundaries ``ranks`` (one array of one rank per text) of the texts that end at ``text_ends``."""
    begins = np.concatenate([[0], text_ends[:-1]])
    # A code point begins at a byte that is no continuation byte; each text has one boundary more, its end.
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    before = np.searchsorted(chars, begins)
    count = np.searchsorted(chars, text_ends) - before
    starts = np.cumsum(count + 1) - (count + 1)
    offsets = np.empty(len(chars) + len(begins), np.int64)
    ends = starts + count
    inner = np.ones(len(offsets), bool)
    inner[ends] = False
    offsets[inner], offsets[ends] = chars, text_ends
    index = RankIndex(offsets, starts)
    return [index.offset(starts + r) for r in ranks]


def plan(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """Add ``n``, ``form``, ``prefix_chars`` and ``middle_chars``: what becomes of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(hexes, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    one, two = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    untouched = (F.col("n") == 0) | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h[2] % 100 >= 100 - plain)
    form = F.when(untouched, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    cut = F.col("form") != "plain"
    planned = docs.withColumn("n", F.length(text).cast("long")).withColumn("form", form)
    return planned.withColumns({"prefix_chars": F.when(cut, F.least(one, two)), "middle_chars": F.when(cut, F.abs(one - two))})


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, spm: int = SPM, drop_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``n, form, prefix_chars, middle_chars, output``."""
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    # The caller's columns travel in one struct, so that none can clash.
    others = [c for c in docs.columns if c not in made and not (drop_text and c == "text")]
    rows = plan(docs.select(F.struct(*others).alias("_kept"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), seed, plain, spm)
    rows = rows.select("_kept", *made[:-1], "text")
    schema = rows.withColumnRenamed("text", "output").schema
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, "text"):
                texts = [t.encode() for t in part.column("text").to_pylist()]
                chosen = np.flatnonzero(np.array(part.column("form").to_pylist()) != "plain")
                out = list(texts)
                if len(chosen):
                    data = b"".join([texts[i] for i in chosen])
                    ends = np.cumsum([len(texts[i]) for i in chosen])
                    first, middle = (part.column(c).take(pa.array(chosen)).to_numpy(zero_copy_only=False).astype(np.int64)
                                     for c in ("prefix_chars", "middle_chars"))
                    found = cuts(np.frombuffer(data, np.uint8), ends, [first, first + middle])
                    forms = part.column("form").take(pa.array(chosen)).to_pylist()
                    start = 0
                    for i, form, a, b, end in zip(chosen.tolist(), forms, *(x.tolist() for x in found), ends.tolist()):
                        pre, mid, suf = data[start:a], data[a:b], data[b:end]
                        pieces = (marks[0], pre, marks[1], suf) if form == "psm" else (marks[1], suf, marks[0], pre)
                        out[i] = b"".join([*pieces, marks[2], mid])
                        start = end
                columns = [part.column(c) for c in schema.names[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary()).cast(pa.string())], schema.names)

    done = rows.mapInArrow(run, schema)
    return done.select(*(F.col("_kept").getField(c).alias(c) for c in others), *made)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A cut text holds no sentinel, so that each occurs once in its output."""
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    before, after = {}, {}
    for name, mark in (("psm", SUFFIX), ("spm", PREFIX)):
        before[name] = F.substring(F.substring_index(head, mark, 1), len(mark) + 1, 2**31 - 1)
        after[name] = F.substring_index(head, mark, -1)
    return (F.when(form == "psm", F.concat(before["psm"], middle, after["psm"]))
            .when(form == "spm", F.concat(after["spm"], middle, before["spm"])).otherwise(output))


def fim_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` for every row of ``docs``."""
    done = fill_in_middle(docs.select("doc_id", "text"), drop_text=True)
    digest = {"output_sha256": F.col("output"), "restored_sha256": restored(F.col("output"), F.col("form"))}
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       *(F.sha2(c.cast("binary"), 256).alias(name) for name, c in digest.items()))


REPORT_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
                  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
k AS (SELECT *, ('0x' || x[1:8])::BIGINT % (n + 1) AS a, ('0x' || x[9:16])::BIGINT % (n + 1) AS b,
             ('0x' || x[17:24])::BIGINT % 100 AS p, ('0x' || x[25:32])::BIGINT % 100 AS q FROM h),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p >= 90 THEN 'plain'
                     WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form, least(a, b) AS c, greatest(a, b) AS d FROM k),
s AS (SELECT *, substring(t, 1, c) AS pre, substring(t, c + 1, d - c) AS mid, substring(t, d + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN c END AS prefix_chars, CASE WHEN form <> 'plain' THEN d - c END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM s
"""
