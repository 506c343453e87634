"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are linked when the Jaccard similarity of their sets of five-word shingles is at least 0.8. Words are
split at white space; a text of fewer words is one shingle, and one without words (null too) has none and no links.

1. Documents with the same shingle set form one class; only classes are compared from here on. Links of a
   document are counted over documents: the other members of its class and all members of the linked classes.
2. Candidates are classes that agree in all ``ROWS`` MinHash values of one of ``BANDS`` bands. A pair at 0.8 is
   missed with probability (1 - 0.8^ROWS)^BANDS, 5e-5; above, much less.
3. MinHash values of a candidate pair are compared ``ROWS * 5`` at a time. With a uniform prior, after m matches of n
   the similarity reaches the threshold with probability P(Binomial(n + 1, threshold) <= m); below ``TOLERANCE`` the
   pair is dropped.
4. What is left is verified exactly on the sets of 64-bit shingle hashes.

Nothing emits all pairs of a group. Classes of a bucket of up to ``PAIRS_UP_TO`` are paired as rows. Larger buckets that
overlap form clusters. Short bands also chain texts that only share a passage, so the members of a cluster of more than one
block are banded again, by ``LONG_BANDS`` bands of ``LONG_ROWS`` other values, and those that still share buckets form the
clusters from there on; a pair at 0.8 is missed there with probability (1 - 0.8^LONG_ROWS)^LONG_BANDS, 5e-5 too. A cluster's
members are dealt into blocks, each two blocks meet in one Spark group, where they are compared as in 3 and 4, and only
counts and the least linked class leave it. The work inside such a cluster is still quadratic in its different texts
(not in its copies), most of which are links then.

Results: one row per row of the input with ``class_id``, the least ``doc_id`` of its connected component, and
``n_links``. Null ids are never a class id unless a class has no other. Repeated rows are copies. An empty table
gives an empty result. The input must be a table scan or a checkpointed frame with doc_id and text.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowline.llm.common import cut, few, lookup_join, row_key, with_arrow
from stowline.llm.components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
LONG_BANDS, LONG_ROWS = 88, 10
TOLERANCE = 1e-4
PAIRS_UP_TO = 8
BLOCK = 128
#: A block pair is verified as one matrix product up to so many cells, and pair by pair beyond.
CELLS = 8_000_000

_RNG = np.random.default_rng(41)
_MUL = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_LONG_MUL = _RNG.integers(1, 2**63, LONG_BANDS * LONG_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LONG_ADD = _RNG.integers(0, 2**63, LONG_BANDS * LONG_ROWS, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sets of shingle hashes; keeps the hashes of recent words."""

    def __init__(self, entries: int = 250_000):
        self.entries, self.known = entries, {}

    def shingles(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if len(self.known) > self.entries:
            self.known.clear()
        ids = list(map(self.known.get, words))
        if None in ids:
            for i, h in enumerate(ids):
                if h is None:
                    ids[i] = h = xxhash.xxh3_64_intdigest(words[i])
                    if len(words[i]) < 40:
                        self.known[words[i]] = h
        h = np.array(ids, np.uint64)
        width = min(WORDS, len(h))
        if not width:
            return h
        out = np.full(len(h) - width + 1, np.uint64(width))
        for k in range(width):
            out = _mixed(out * _P + h[k:len(h) - width + 1 + k])
        return np.unique(out)


def min_hashes(shingles: np.ndarray, mul: np.ndarray = _MUL, add: np.ndarray = _ADD) -> np.ndarray:
    best = np.full(len(mul), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), 1024):
        part = ((shingles[None, at:at + 1024] * mul[:, None] + add[:, None]) >> np.uint64(32)).min(1)
        best = np.minimum(best, part.astype(np.uint32))
    return best


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One number per band of each row of ``sig``."""
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]) * _P
    for k in range(rows):
        h = _mixed(h * _P + parts[:, :, k])
    return h.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = ROWS * 5) -> list[tuple[int, int]]:
    """(n, m): after n values, fewer than m matches make it too improbable that the threshold is reached."""
    out = []
    for n in range(step, BANDS * ROWS + 1, step):
        chance, m = 0.0, 0
        while True:
            chance += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indexes (i, j) of the rows of signatures ``a`` and ``b`` that the incremental comparison keeps."""
    i, j = (x.ravel() for x in np.indices((len(a), len(b))))
    return _pruned(a, b, i, j)


def _pruned(a, b, i, j):
    matches, at = np.zeros(len(i), np.int32), 0
    for n, least in least_matches():
        matches += (a[i, at:n] == b[j, at:n]).sum(1, dtype=np.int32)
        keep = matches >= least
        i, j, matches, at = i[keep], j[keep], matches[keep], n
    return i, j


def _reaches(common, size_a, size_b):
    """common / union >= THRESHOLD in whole numbers."""
    num, den = round(THRESHOLD * 1000), 1000
    return common * den >= num * (size_a + size_b - common)


def _verified(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair whether the sets reach the threshold."""
    if not len(i):
        return np.zeros(0, bool)
    na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    if len(i) > 50:
        values, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
        if len(values) * (len(a) + len(b)) <= CELLS:
            hot = np.zeros((len(a) + len(b), len(values)), np.float32)
            hot[np.repeat(np.arange(len(hot)), np.r_[na, nb]), at] = 1
            common = np.rint(hot[:len(a)] @ hot[len(a):].T).astype(np.int64)[i, j]
            return _reaches(common, na[i], nb[j])
    common = np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    return _reaches(common, na[i], nb[j])


def _ints(column: pa.Array, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _block_links(table: pa.Table) -> pa.Table:
    """Count the links between two blocks of a cluster: per class its links and the least class it is connected with."""
    table = table.combine_chunks()
    first = table.column("i")[0].as_py()
    same = first == table.column("j")[0].as_py()
    own = table.column("block").to_numpy()
    ids, docs = table.column("c").to_numpy(), table.column("n_docs").to_numpy()
    sig = np.stack(_ints(table.column("sig"), np.uint32))
    sets = _ints(table.column("shingles"), np.uint64)
    left = np.flatnonzero(own == first)
    right = left if same else np.flatnonzero(own != first)
    links, texts, root = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.arange(len(ids))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at in range(0, len(left), 32):
        part = left[at:at + 32]
        i, j = plausible(sig[part], sig[right])
        if same:
            i, j = i[part[i] < right[j]], j[part[i] < right[j]]
        good = _verified([sets[x] for x in part], [sets[x] for x in right], i, j)
        x, y = part[i[good]], right[j[good]]
        for u, v in ((x, y), (y, x)):
            np.add.at(links, u, docs[v])
            np.add.at(texts, u, 1)
        for u, v in zip(x, y):
            u, v = find(u), find(v)
            if u != v:
                low, high = (u, v) if ids[u] < ids[v] else (v, u)
                root[high] = low
    some = np.flatnonzero(texts)
    return pa.table({"c": ids[some], "links": links[some], "texts": texts[some],
                     "least": ids[[find(x) for x in some]] if len(some) else ids[:0]})


def _shingled(docs: DataFrame) -> DataFrame:
    """``_row, doc_id, set, sig`` of the documents that have words."""
    fields = [T.StructField("set", T.BinaryType()), T.StructField("sig", T.BinaryType())]

    def make():
        shingler = Shingler()

        def work(texts):
            sets = [shingler.shingles(t) for t in texts]
            return ([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    [min_hashes(s).tobytes() if len(s) else None for s in sets])
        return work

    rows = docs.select("doc_id", "text").withColumn("_row", row_key())
    return with_arrow(rows, "text", fields, make, ["text"])


def _with_shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (c, ...) with ``shingles``, from the text of the row c."""
    rows = docs.select("text").withColumn("c", row_key())
    chosen = rows.join(F.broadcast(wanted) if few(wanted) else wanted, "c")

    def make():
        shingler = Shingler()
        return lambda texts: [[shingler.shingles(t).tobytes() for t in texts]]

    return with_arrow(chosen, "text", [T.StructField("shingles", T.BinaryType())], make, ["text"])


def _bands(classes: DataFrame) -> DataFrame:
    """``band, c``: a row for each band of each class."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                keys = band_keys(np.stack(_ints(part.column("sig"), np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("c").to_numpy(), BANDS))], ["band", "c"])

    return classes.select("c", "sig").mapInArrow(run, "band long, c long")


def _split(members: DataFrame) -> DataFrame:
    """``node, root``: the clusters that long bands leave of ``members (c, root, shingles)``; a member that meets no other has no row."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sig = np.stack([min_hashes(s, _LONG_MUL, _LONG_ADD) for s in _ints(part.column("shingles"), np.uint64)])
                root = _mixed(part.column("root").to_numpy().astype(np.uint64) * _P)
                keys = band_keys(sig, LONG_BANDS, LONG_ROWS) ^ root.view(np.int64)[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("c").to_numpy(), LONG_BANDS))], ["band", "c"])

    bands = cut(members.select("c", "root", "shingles").mapInArrow(run, "band long, c long"))
    sizes = cut(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("hub")).where("n > 1"))
    return components(lookup_join(bands, sizes, ["band"], "n", "inner").select(F.col("c").alias("a"), F.col("hub").alias("b")))


def _clusters(dense: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, root, m``: the clusters of ``dense``, those of more than one block split, with their numbers of members."""
    def sized(clusters):
        counts = cut(clusters.groupBy("root").agg(F.count(F.lit(1)).alias("m")))
        return lookup_join(clusters, counts, ["root"], "m", "inner")

    all_ = cut(sized(dense))
    large = all_.where(F.col("m") > BLOCK).select(F.col("node").alias("c"), "root")
    if large.isEmpty():
        return all_
    return all_.where(F.col("m") <= BLOCK).unionByName(sized(_split(large.join(sets.select("c", "shingles"), "c"))))


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the incremental comparison of signatures keeps."""
    sig = classes.select("c", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                a, b = (np.stack(_ints(part.column(x), np.uint32)) for x in ("sig_a", "sig_b"))
                i, _ = _pruned(a, b, np.arange(len(a)), np.arange(len(a)))
                yield pa.RecordBatch.from_arrays([part.column(x).take(pa.array(i)) for x in ("a", "b")], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that reach the threshold, with the documents of both classes."""
    own = sets.select("c", "n_docs", "shingles")
    both = pairs.join(own.toDF("a", "docs_a", "set_a"), "a").join(own.toDF("b", "docs_b", "set_b"), "b")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                good = [bool(_verified([x], [y], np.zeros(1, int), np.zeros(1, int))[0])
                        for x, y in zip(_ints(part.column("set_a"), np.uint64), _ints(part.column("set_b"), np.uint64))]
                yield part.select(["a", "b", "docs_a", "docs_b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long, docs_a long, docs_b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``_row, doc_id, class_id, n_links, n_text_links, kept``: one row per row of ``docs``.

    ``_row`` is ``row_key()`` of ``docs``; ``kept`` marks one row of each component, that of its ``class_id``.
    """
    rows = cut(_shingled(docs))
    classes = cut(rows.where("set IS NOT NULL").groupBy("set").agg(
        F.min("_row").alias("c"), F.count(F.lit(1)).alias("n_docs"), F.first("sig").alias("sig")))
    bands = _bands(classes)
    sizes = cut(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("hub")).where("n > 1"))
    met = cut(lookup_join(bands, sizes, ["band"], "n", "inner"))
    dense = components(met.where(F.col("n") > PAIRS_UP_TO).select(F.col("c").alias("a"), F.col("hub").alias("b")))
    gathered = met.where(F.col("n") <= PAIRS_UP_TO).groupBy("band").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    pairs = gathered.select(F.explode(F.expr("flatten(transform(cs, (x, i) -> transform(slice(cs, i + 2, size(cs)), y -> struct(x AS a, y AS b))))")).alias("p"))
    pairs = pairs.select("p.*").distinct()
    if not dense.isEmpty():
        pairs = pairs.join(dense.toDF("a", "ra"), "a", "left").join(dense.toDF("b", "rb"), "b", "left").where(
            "ra IS NULL OR rb IS NULL OR ra <> rb").select("a", "b")
    likely = cut(_likely(pairs, classes))
    wanted = likely.select(F.explode(F.array("a", "b")).alias("c")).unionByName(dense.select(F.col("node").alias("c"))).distinct()
    sets = cut(_with_shingles(docs, cut(wanted.join(classes.select("c", "n_docs"), "c"))))
    exact = cut(_exact(likely, sets))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    members = _clusters(dense, sets).withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumnRenamed("node", "c")
    members = members.join(sets, "c").join(classes.select("c", "sig"), "c")
    met_blocks = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c", "n_docs", "sig", "shingles")
    inside = cut(met_blocks.groupBy("root", "i", "j").applyInArrow(_block_links, "c long, links long, texts long, least long"))
    ends = exact.select(F.col("a").alias("c"), F.col("docs_b").alias("links")).unionByName(
        exact.select(F.col("b").alias("c"), F.col("docs_a").alias("links"))).withColumn("texts", F.lit(1).cast("long"))
    degrees = ends.unionByName(inside.select("c", "links", "texts")).groupBy("c").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    roots = components(exact.select("a", "b").unionByName(inside.select(F.col("c").alias("a"), F.col("least").alias("b"))))
    info = classes.select("set", "c", "n_docs").join(roots.withColumnRenamed("node", "c"), "c", "left").join(degrees, "c", "left")
    info = cut(info.where("n_docs > 1 OR root IS NOT NULL").select(
        "set", "n_docs", F.coalesce("root", "c").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts")))
    held = cut(lookup_join(rows.drop("sig").where("set IS NOT NULL"), info, ["set"], "n_docs", "inner").drop("set"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")).alias("first")
    tops = cut(held.groupBy("root").agg(first, F.count(F.lit(1)).alias("n")).select("root", "n", F.col("first.doc_id").alias("class_id"), F.col("first._row").alias("first")))
    held = lookup_join(held, tops, ["root"], "n", "inner").select(
        "_row", "class_id", (F.col("n_docs") - 1 + F.col("links")).alias("n_links"), F.col("texts").alias("n_text_links"), (F.col("_row") == F.col("first")).alias("kept"))
    joined = rows.select("_row", "doc_id").join(held, "_row", "left")
    alone = F.col("kept").isNull()
    return joined.select(
        "_row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_text_links", F.lit(0).cast("long")).alias("n_text_links"),
        F.coalesce("kept", F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the smallest id."""
    gone = cut(near_duplicates(docs).where("NOT kept").select("_row"))
    rows = docs.withColumn("_row", row_key())
    return rows.join(F.broadcast(gone) if few(gone) else gone, "_row", "left_anti").select(*docs.columns)


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).drop("_row")
