"""Conversation prefix trie, built as Z-fast tries.

A conversation is a path of turns; a node is a distinct prefix of turns. A prefix is known by its depth and a hash of
128 bits: the bitwise sum (xor) of the hashes of (place, role, text) of its turns, so that prefixes of any conversation, however
long, are running sums. Texts are hashed first; only putting turns in order (``rebuilt``) moves them, once.

Paths are cut into segments of ``SEGMENT`` turns, each rooted at the prefix before it, so that a long conversation is
shared by many tasks. A task gets the segments of a range of first turns and inserts them, an Arrow batch at a time, into a
compacted trie: its nodes are kept in a dictionary by their handle, the prefix whose length is the two-fattest number (the one
divisible by the largest power of two) between the node's upper and lower end. The exit node of a path is found by
fat binary search: the two-fattest length between what is known to be in the trie and what is not is looked up, and the
node that is found, or not, narrows the range. So a path of n turns takes log n look-ups. Counts are added up from the leaves,
then edges are expanded to one row per depth. Tries of several tasks that share a prefix are summed by (depth, hash). A trie
that grows beyond ``TRIE_KEYS`` prefixes is given out and a new one begun.

What sums over subtrees (leaves, saved tokens) uses chains: a node belongs to its smallest member, whose nodes are the end of its
path. Sums run along chains; what a chain adds to the nodes above it is a path with a weight, and the same tries add these up.

No group is gathered: members that end at a node are streamed through a hasher in order, and a task holds one trie.
Turns with a null conv_id belong to no conversation and are left out. Turns are in the order of ``turn`` (null first), then role
and text. A table without conversations gives no node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowline.llm.common import cut, lookup_join
from stowline.operators.skew import number_in_group

#: Turns of a path that are inserted at once.
SEGMENT = 512
#: Prefixes in a trie, beyond which it is given out.
TRIE_KEYS = 1_000_000
#: Bytes of a hash.
WIDTH = 16
#: The hash of no members.
NO_ENDS = hashlib.sha256(b"").hexdigest()


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the largest power of two."""
    return high & -(1 << ((low ^ high).bit_length() - 1))


class Trie:
    """Compacted tries of segments, one for each root, in one dictionary of handles.

    A path is the joined hashes of its prefixes below the root. A node covers the lengths (low, high] of the path it is
    labelled by; its weights are those of the paths that end at it.
    """

    def __init__(self):
        self.handles: dict[tuple[bytes, int], int] = {}
        self.children: dict[tuple[int, bytes], int] = {}
        self.roots: dict[tuple[int, bytes], int] = {}
        self.low, self.high, self.parent, self.label = [], [], [], []
        self.sums, self.least, self.root = [], [], []
        #: By label: its path and the code points of the last text of each prefix.
        self.paths: list[bytes] = []
        self.sizes: list[np.ndarray] = []
        self.keys = 0

    def _node(self, low: int, high: int, parent: int, label: int, root: int | None) -> int:
        for column, value in ((self.low, low), (self.high, high), (self.parent, parent), (self.label, label), (self.sums, (0, 0)), (self.least, None)):
            column.append(value)
        self.root.append(len(self.root) if root is None else root)
        return len(self.low) - 1

    def _hang(self, node: int, path: bytes) -> None:
        """Put ``node`` under its parent and its handle into the dictionary."""
        low, high = self.low[node], self.high[node]
        self.children[self.parent[node], path[WIDTH * low:WIDTH * low + WIDTH]] = node
        self._handle(node, path, low, high)

    def _handle(self, node: int, path: bytes, low: int, high: int) -> None:
        f = two_fattest(low, high)
        self.handles[path[WIDTH * f - WIDTH:WIDTH * f], f] = node

    def exit(self, root: int, path: bytes) -> tuple[int, int]:
        """The last node on the way of ``path`` and how much of the path it has: the whole node, or a part of its edge."""
        node, low, high = root, 0, len(path) // WIDTH
        while low < high:
            f = two_fattest(low, high)
            found = self.handles.get((path[WIDTH * f - WIDTH:WIDTH * f], f))
            if found is None:
                high = f - 1
                continue
            own = self.paths[self.label[found]]
            end = self.high[found]
            if WIDTH * end > len(path) or own[WIDTH * end - WIDTH:WIDTH * end] != path[WIDTH * end - WIDTH:WIDTH * end]:
                return found, self._shared(own, path, f, end)
            node, low = found, end
        # The way may go on into an edge whose handle is further down.
        at = self.high[node]
        below = self.children.get((node, path[WIDTH * at:WIDTH * at + WIDTH])) if WIDTH * at < len(path) else None
        if below is None:
            return node, at
        return below, self._shared(self.paths[self.label[below]], path, at + 1, self.high[below])

    @staticmethod
    def _shared(one: bytes, two: bytes, low: int, high: int) -> int:
        """How many prefixes are equal, at least ``low`` and at most ``high``; after the first difference all differ."""
        high = min(high, len(two) // WIDTH)
        while low < high:
            middle = (low + high + 1) // 2
            same = one[WIDTH * middle - WIDTH:WIDTH * middle] == two[WIDTH * middle - WIDTH:WIDTH * middle]
            low, high = (middle, high) if same else (low, middle - 1)
        return low

    def insert(self, depth: int, base: bytes, path: bytes, sizes: np.ndarray, weights: tuple[int, int], owner: int) -> None:
        """Add the path below the prefix ``base`` of ``depth`` turns."""
        if (root := self.roots.get((depth, base))) is None:
            self.paths.append(b"")
            self.sizes.append(np.empty(0, np.int64))
            root = self.roots[depth, base] = self._node(0, 0, -1, len(self.paths) - 1, None)
            self.keys += 1
        node, length = self.exit(root, path)
        n = len(path) // WIDTH
        if length < self.high[node]:
            node = self._split(node, length)
        if length < n:
            self.paths.append(path)
            self.sizes.append(sizes)
            self.keys += n
            node = self._node(length, n, node, len(self.paths) - 1, self.root[node])
            self._hang(node, path)
        self.sums[node] = (self.sums[node][0] + weights[0], self.sums[node][1] + weights[1])
        self.least[node] = owner if self.least[node] is None else min(self.least[node], owner)

    def _split(self, node: int, length: int) -> int:
        """Cut the edge of ``node`` at ``length``; the new upper node."""
        path, high = self.paths[self.label[node]], self.high[node]
        upper = self._node(self.low[node], length, self.parent[node], self.label[node], self.root[node])
        self._hang(upper, path)
        self.parent[node], self.low[node] = upper, length
        self.children[upper, path[WIDTH * length:WIDTH * length + WIDTH]] = node
        self._handle(node, path, length, high)
        return upper

    def expand(self) -> pa.RecordBatch | None:
        """One row per prefix: its depth, hash, the hash before it, size, and the sums and least owner of what passes it."""
        if not self.low:
            return None
        sums, least = np.array(self.sums, np.int64), list(self.least)
        for node in np.argsort(-np.array(self.high), kind="stable").tolist():
            above = self.parent[node]
            if above >= 0:
                sums[above] += sums[node]
                least[above] = least[node] if least[above] is None else min(least[above], least[node])
        depth_of, base_of = {}, {}
        for (depth, base), node in self.roots.items():
            depth_of[node], base_of[node] = depth, base
        keys, ups, depths, sizes, rows = [], [], [], [], []
        for node, (low, high) in enumerate(zip(self.low, self.high)):
            depth, path = depth_of[self.root[node]], self.paths[self.label[node]]
            if high == 0:
                # The empty prefix; other roots are the ends of the segments before them.
                if depth == 0:
                    keys.append(base_of[node])
                    ups.append(bytes(WIDTH))
                    depths.append(np.zeros(1, np.int64))
                    sizes.append(np.zeros(1, np.int64))
                    rows.append((node, 1))
                continue
            keys.append(path[WIDTH * low:WIDTH * high])
            ups.append(path[WIDTH * (low - 1):WIDTH * (high - 1)] if low else base_of[self.root[node]] + path[:WIDTH * (high - 1)])
            depths.append(np.arange(depth + low + 1, depth + high + 1))
            sizes.append(self.sizes[self.label[node]][low:high])
            rows.append((node, high - low))
        if not rows:
            return None
        own, up = (np.frombuffer(b"".join(x), np.int64).reshape(-1, 2) for x in (keys, ups))
        at = np.repeat([node for node, _ in rows], [n for _, n in rows])
        columns = [np.concatenate(depths), own[:, 0], own[:, 1], up[:, 0], up[:, 1], np.concatenate(sizes), sums[at, 0], sums[at, 1], np.array(least)[at]]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], NODE)


NODE = ["depth", "p1", "p2", "u1", "u2", "size", "w1", "w2", "conv_id"]
KEY = ["depth", "p1", "p2"]


def paths(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Segments of the paths: ``conv_id, segment, b1, b2, h, size``.

    ``turns`` (conv_id, depth from 1 without gaps, h1, h2, size) are hashed turns; a conversation of ``conversations`` without any has
    one empty segment. ``h`` are the hashes (p1, p2) of the prefixes by depth, ``b1, b2`` that of the prefix before.
    """
    cell = F.struct("depth", "h1", "h2", "size")
    parts = cut(turns.withColumn("segment", F.expr(f"(depth - 1) div {SEGMENT}")).groupBy("conv_id", "segment")
                .agg(F.sort_array(F.collect_list(cell)).alias("cells"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2")))
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # One row per SEGMENT turns, without their hashes.
    based = parts.select("conv_id", "segment", *(F.coalesce(F.bit_xor(x).over(before), zero).alias(b) for x, b in (("x1", "b1"), ("x2", "b2"))))
    whole = parts.drop("x1", "x2").join(based, ["conv_id", "segment"])
    empty = conversations.join(parts.select("conv_id").distinct(), "conv_id", "left_anti")
    empty = empty.select("conv_id", zero.alias("segment"), F.array().cast(parts.schema["cells"].dataType).alias("cells"), zero.alias("b1"), zero.alias("b2"))
    return whole.unionByName(empty)


def merged(segments: DataFrame, weights: list[str], segments_of_task: int = 50_000) -> DataFrame:
    """``NODE`` rows, one per prefix, of the tries of ``segments`` (conv_id, segment, b1, b2, cells) with the columns ``weights``."""
    rows = segments.select("segment", "b1", "b2", F.get("cells.h1", F.lit(0)).alias("first"), "conv_id", "cells.h1", "cells.h2", "cells.size",
                           *(F.col(w).alias(f"w{i + 1}") for i, w in enumerate(weights)))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // segments_of_task))
    # Equal first turns meet, unless they are too many for a task.
    dealt = rows.repartitionByRange(parts, "segment", "b1", "b2", "first", "conv_id")

    def run(batches):
        trie = Trie()
        for batch in batches:
            got = {n: batch.column(n) for n in batch.schema.names}
            base = np.column_stack([got["b1"].to_numpy(), got["b2"].to_numpy()]).astype(np.int64)
            ends = got["h1"].offsets.to_numpy()
            hashes = np.column_stack([got["h1"].flatten().to_numpy(), got["h2"].flatten().to_numpy()]).astype(np.int64).reshape(-1, 2)
            sizes = got["size"].flatten().to_numpy()
            shift = int(ends[0])
            numbers = zip(*(got[n].to_pylist() for n in ("segment", "w1", "w2", "conv_id")))
            for i, (segment, w1, w2, conv) in enumerate(numbers):
                a, b = int(ends[i]) - shift, int(ends[i + 1]) - shift
                run_of = np.bitwise_xor.accumulate(np.concatenate([base[i:i + 1], hashes[a:b]]), axis=0)[1:]
                trie.insert(segment * SEGMENT, base[i].tobytes(), run_of.tobytes(), sizes[a:b], (w1, w2), conv)
                if trie.keys > TRIE_KEYS:
                    if (out := trie.expand()) is not None:
                        yield out
                    trie = Trie()
        if (out := trie.expand()) is not None:
            yield out

    found = dealt.mapInArrow(run, ", ".join(f"{n} long" for n in NODE))
    return found.groupBy(*KEY).agg(*(F.min(c).alias(c) for c in ("u1", "u2", "size", "conv_id")), F.sum("w1").alias("w1"), F.sum("w2").alias("w2"))


def end_hashes(ends: DataFrame) -> DataFrame:
    """``KEY`` and ``ends_sha256``: the hash of the ids that end there, in order; ids stream through the hasher."""
    names = [*KEY, "ends_sha256"]

    def run(batches):
        now, hasher = None, None
        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy() for k in KEY])
            ids = batch.column("conv_id").to_pylist()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(ids) else np.empty(0, np.int64)
            done = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
                key, text = tuple(keys[a].tolist()), ",".join(map(str, ids[a:b]))
                if key == now:
                    hasher.update(f",{text}".encode())
                else:
                    if now is not None:
                        done.append((*now, hasher.hexdigest()))
                    now, hasher = key, hashlib.sha256(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, hasher.hexdigest())], names)

    dealt = ends.select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return dealt.mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def contents(turns: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, and ``c1, c2, size`` for ``role`` and ``text``: a hash of 128 bits and the text's code points."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    return turns.select(*keep, F.xxhash64(F.lit(71), role, text).alias("c1"), F.xxhash64(F.lit(113), role, text).alias("c2"),
                        F.length(text).cast("long").alias("size"))


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, depth, role, text; depth from 1 without gaps); see ``trie_of``."""
    return trie_of(contents(turns, "conv_id", "depth"), conversations)


def trie_of(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, depth from 1 without gaps, and c1, c2, size of ``contents``).

    ``conversations`` (conv_id) are all members, those without turns too; each id once. Gives, per node, ``conv_id`` (its smallest member),
    ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``. Null role or text counts as empty.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    hashed = turns.select("conv_id", F.col("depth").cast("long").alias("depth"), "size",
                          F.xxhash64(F.lit(29), "depth", "c1", "c2").alias("h1"), F.xxhash64(F.lit(31), "depth", "c2", "c1").alias("h2"))
    segments = cut(paths(hashed, conversations))
    nodes = merged(segments.withColumns({"w1": one, "w2": zero}), ["w1", "w2"])
    chain = Window.partitionBy("conv_id").orderBy("depth")
    up_chain = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    own = F.sum((F.col("w1") - 1) * F.col("size")).over(up_chain)
    nodes = cut(nodes.select(*KEY, "u1", "u2", "conv_id", F.col("w1").alias("n_convs"), own.alias("own_saved"),
                             F.lag("depth").over(chain).isNull().alias("top"), F.lead("depth").over(chain).isNotNull().alias("goes_on")))
    up = {"depth": F.col("depth") - 1, "p1": F.col("u1"), "p2": F.col("u2")}
    tops = nodes.where("top AND depth > 0").select(F.col("depth").alias("from"), "conv_id", F.col("own_saved").alias("saved"), *(v.alias(k) for k, v in up.items()))
    hanging = tops.groupBy(*KEY).agg(F.count(F.lit(1)).alias("hanging"))
    nodes = cut(nodes.join(hanging, KEY, "left").withColumn("hanging", F.coalesce("hanging", zero)))
    above = nodes.where("hanging > 0").select(*KEY, F.col("conv_id").alias("parent_conv_id"), "hanging")
    ends = nodes.where("NOT goes_on").select("conv_id", (F.col("hanging") == 0).cast("long").alias("leaf"))
    # One row per chain: where it hangs and what it adds to the nodes above.
    chains = cut(lookup_join(tops, cut(above), KEY, "hanging", "left").join(ends, "conv_id").select("conv_id", "from", "parent_conv_id", "saved", "leaf"))
    # The chains' paths down to where they hang; its node counts there.
    taken = F.least(F.size("cells").cast("long"), F.col("from") - 1 - F.col("segment") * SEGMENT)
    hung = segments.join(chains, "conv_id").where((F.col("segment") == 0) | (F.col("segment") * SEGMENT < F.col("from") - 1))
    hung = hung.withColumn("cells", F.slice("cells", F.lit(1), taken.cast("int")))
    added = merged(hung, ["leaf", "saved"]).select(*KEY, F.col("w1").alias("more_leaves"), F.col("w2").alias("more_saved"))
    # Where the members end: the last prefix of the last segment.
    last = segments.groupBy("conv_id").agg(F.max_by(F.struct("segment", "b1", "b2", "cells"), "segment").alias("s"))
    summed = {p: F.aggregate(f"s.cells.h{i}", F.col(f"s.b{i}"), lambda a, h: a.bitwiseXOR(h)) for i, p in ((1, "p1"), (2, "p2"))}
    members = last.select("conv_id", (F.col("s.segment") * SEGMENT + F.size("s.cells")).alias("depth"), *(v.alias(k) for k, v in summed.items()))
    whole = nodes.join(added, KEY, "left").join(end_hashes(members), KEY, "left")
    own_leaf = ends.select("conv_id", F.col("leaf").alias("own_leaf"))
    parents = chains.select("conv_id", "from", "parent_conv_id").withColumnRenamed("from", "depth")
    whole = whole.join(own_leaf, "conv_id").join(parents, ["conv_id", "depth"], "left")
    return whole.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"), "n_convs",
        (F.col("hanging") + F.col("goes_on").cast("long")).alias("n_children"), (F.col("own_leaf") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
        (F.col("own_saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def rebuilt(conversations: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, and ``contents``) and ids of the conversations that begin like the first of their block.

    Conversation c takes the first h turns of conversation c - c % block, h = crc32(c) % most, then its own turns after its first h.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    turns = turns.withColumns({"none": F.col("turn").isNotNull(), "role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    content = ["c1", "c2", "size"]
    placed = cut(contents(number_in_group(turns, ["conv_id"], ["none", "turn", "role", "text"], "at"), "conv_id", "at"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = placed.where("at = 0").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    # At most ``most`` - 1 turns of a base, for at most 2 * ``block`` - 1 conversations.
    heads = placed.where(F.col("at") < most - 1).select(F.col("conv_id").alias("base"), "at", *content)
    sizes = heads.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    known = cut(ids.join(sizes, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken")))
    begun = known.join(heads, "base").where("at < h").select("conv_id", (F.col("at") + 1).alias("depth"), *content)
    shift = known.select("conv_id", "h", "taken")
    rest = placed.join(shift, "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("depth"), *content)
    return begun.unionByName(rest), known.select("conv_id")


def trie_report(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of the rebuilt ``conversations`` (conv_id, turn, role, text)."""
    return trie_of(*rebuilt(conversations))


REPORT_SQL = """
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id FROM o),
crc AS (SELECT conv_id, list_reduce(list_prepend(4294967295::UBIGINT, [ascii(x)::UBIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
               lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT FOR i IN range(8)]),
                   lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)) AS v FROM c),
k AS (SELECT conv_id, (xor(v, 4294967295::UBIGINT) % 6)::BIGINT AS h, conv_id - conv_id % 100 AS base FROM crc),
n AS (SELECT k.conv_id, h, base, least(h, (SELECT count(*) FROM o WHERE o.conv_id = base)) AS taken FROM k),
r AS (SELECT n.conv_id, pos + 1 AS depth, role, text FROM n JOIN o ON o.conv_id = n.base WHERE pos < h
      UNION ALL SELECT n.conv_id, pos - h + taken + 1, role, text FROM n JOIN o USING (conv_id) WHERE pos >= h),
w AS (SELECT conv_id, depth, length(text) AS size, sha256(length(role) || ':' || role || text) AS x FROM r),
p AS (SELECT conv_id, depth, size, sha256(string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM w
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
g AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size FROM p GROUP BY depth, key),
m AS (SELECT p.depth, p.key, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS hash FROM p JOIN e USING (conv_id, depth) GROUP BY p.depth, p.key),
u AS (SELECT g.*, a.conv_id AS parent_conv_id FROM g LEFT JOIN p ON p.conv_id = g.conv_id AND p.depth = g.depth - 1
      LEFT JOIN g a ON a.depth = p.depth AND a.key = p.key),
d AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM u WHERE parent_conv_id IS NOT NULL GROUP BY ALL),
f AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN d USING (conv_id, depth)),
s AS (SELECT p.depth, p.key, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.size) AS saved_tokens
      FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.depth, p.key)
SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
       coalesce(m.hash, sha256('')) AS ends_sha256
FROM f JOIN s USING (depth, key) LEFT JOIN m USING (depth, key)
"""
