"""Byte-level BPE encoding and decoding over a rank file.

Text is split by the public pattern; each match is merged on its own. A segment tree over byte positions holds
the rank of the pair that starts at each position, with the position as tie-break, so that its root is the
leftmost pair of least rank. A merge changes three leaves: the merged pair and its two live neighbours.
Merging a match of n bytes takes O(n log n).

Null text is encoded as no ids, and so is empty text. Null ids decode to null. A column with the name of the
result is replaced; all others pass through. Rows are independent, so repeated rows give repeated results.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowline.llm.common import with_arrow

#: Entries of a generation of a worker's caches of words and of matches. Longer strings are not kept.
CACHE_WORDS, CACHE_PIECES = 150_000, 70_000
CACHE_CHARS = 48
#: Children of a node of the segment tree; a match of up to so many bytes is a tree of one level.
FAN = 16


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks in the bytes of a rank file: a line has a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match.

    ``levels[0]`` has for each byte position the rank of the pair of live parts that starts there, as
    rank * n + position; ``levels[k]`` has the least of each ``FAN`` entries of the level below.
    """
    rank = ranks.get
    whole = rank(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    none = (len(ranks) + 1) * n
    leaves = [none if (r := rank(piece[i:i + 2])) is None else r * n + i for i in range(n - 1)]
    leaves.append(none)
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[i:i + FAN]) for i in range(0, len(below), FAN)])
    top, flat = levels[-1], len(levels) == 1
    after = list(range(1, n + 2))
    before = list(range(-1, n + 1))
    while (least := min(top)) < none:
        at = least % n
        gone = after[at]
        end = after[gone]
        after[at] = end
        before[end] = at
        leaves[gone] = none
        leaves[at] = none if end >= n or (r := rank(piece[at:after[end]])) is None else r * n + at
        left = before[at]
        if left >= 0:
            leaves[left] = none if (r := rank(piece[left:end])) is None else r * n + left
        if not flat:
            for leaf in (gone, at, max(left, 0)):
                for below, level in zip(levels, levels[1:]):
                    leaf //= FAN
                    now = min(below[leaf * FAN:leaf * FAN + FAN])
                    if level[leaf] == now:
                        break
                    level[leaf] = now
    ids, at = [], 0
    while at < n:
        end = after[at]
        ids.append(ranks[piece[at:end]])
        at = end
    return ids


class Recent:
    """A bounded cache of two generations: when the young one is full, it becomes the old one."""

    def __init__(self, entries: int):
        self.entries = entries
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(key) <= CACHE_CHARS:
            if len(self.young) >= self.entries:
                self.old, self.young = self.young, {}
            self.young[key] = value


class Encoder:
    """Encodes texts; keeps the ids of recent words.

    A text may be cut before a space that stands between two characters that are no white space: there a match
    always ends and the next one does not look back. So each such part is looked up or encoded by itself.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.pieces = Recent(CACHE_PIECES)
        self.words = Recent(CACHE_WORDS)

    def _part(self, part: str) -> bytes:
        out = []
        for piece in self.find(part):
            if piece[0] == " " and piece[1:].isalpha():
                ids = self._word(piece[1:])
            elif (ids := self.pieces.get(piece)) is None:
                ids = array("i", merge(piece.encode(), self.ranks)).tobytes()
                self.pieces.put(piece, ids)
            out.append(ids)
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        """The ids of a space and ``word``. A run of letters is one match; it is kept with the words alone."""
        ids = self.words.get(word)
        if ids is None:
            if word.isalpha():
                ids = array("i", merge(b" " + word.encode(), self.ranks)).tobytes()
            else:
                ids = self._part(" " + word)
            self.words.put(word, ids)
        return ids

    def encode(self, text: str) -> np.ndarray:
        words = text.split(" ")
        found = list(map(self.words.young.get, words))
        found[0] = self._part(words[0])
        odd = not words[0] or words[0][-1].isspace()
        for i in [i for i, ids in enumerate(found) if ids is None]:
            word = words[i]
            if not word or word[0].isspace() or word[-1].isspace():
                odd = True
                break
            found[i] = self._word(word)
        if odd:
            found = self._joined(words)
        return np.frombuffer(b"".join(found), np.int32)

    def _joined(self, words: list[str]) -> list[bytes]:
        """As above, where words next to white space stay together."""
        found, group, first = [], [words[0]], True

        def close():
            part = " ".join(group)
            if first:
                found.append(self._part(part))
            elif len(group) == 1 and part and not part[0].isspace() and not part[-1].isspace():
                found.append(self._word(part))
            else:
                found.append(self._part(" " + part))

        for word in words[1:]:
            last = group[-1]
            if last and word and not last[-1].isspace() and not word[0].isspace():
                close()
                group, first = [], False
            group.append(word)
        close()
        return found


_ENCODERS: dict[tuple[bytes, str], Encoder] = {}


def _encoder(data: bytes, pattern: str) -> Encoder:
    """The worker's encoder; its caches outlive a task."""
    if (data, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[data, pattern] = Encoder(read_ranks(data), pattern)
    return _ENCODERS[data, pattern]


def load(path: str) -> bytes:
    """The bytes of a rank file, read on the driver and sent with the tasks; about 1 MB for 50,000 ranks."""
    with open(path, "rb") as file:
        return file.read()


def _lists(parts: Iterable[np.ndarray]) -> pa.Array:
    parts = list(parts)
    ends = np.cumsum([0, *(len(p) for p in parts)]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids", drop_text: bool = False) -> DataFrame:
    """Add ``ids``, the ids of ``text`` without special tokens."""

    def make():
        encoder = _encoder(ranks, pattern)
        return lambda texts: [_lists(encoder.encode(t or "") for t in texts)]

    return with_arrow(docs, text, [T.StructField(ids, T.ArrayType(T.IntegerType(), False))], make, [text] * drop_text)


def _decoded(lists: pa.ListArray, tokens: dict[int, bytes]) -> pa.Array:
    """The bytes of each list of ids."""
    values, ends, null = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.is_null().to_pylist()
    return pa.array([None if gone else b"".join(map(tokens.__getitem__, values[a:b].tolist()))
                     for gone, a, b in zip(null, ends[:-1], ends[1:], strict=True)], pa.binary())


def decode(rows: DataFrame, ranks: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the bytes that ``ids`` stand for. An unknown id is an error."""
    field = T.StructField(out, T.BinaryType())
    kept = [f for f in rows.schema.fields if f.name != out]

    def run(batches):
        tokens = {rank: token for token, rank in read_ranks(ranks).items()}
        for batch in batches:
            step = max(1, int(batch.num_rows * 4e6 // max(1, batch.column(ids).nbytes)))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), _decoded(part.column(ids), tokens)],
                                                 [*(f.name for f in kept), out])

    return rows.mapInArrow(run, T.StructType([*kept, field]))


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Add ``ids`` as ``encode`` and ``decoded`` as ``decode`` of them, while rows are with a Python worker once."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())]

    def make():
        encoder, tokens = _encoder(ranks, pattern), {rank: token for token, rank in read_ranks(ranks).items()}

        def work(texts):
            ids = _lists(encoder.encode(t or "") for t in texts)
            return ids, _decoded(ids, tokens)
        return work

    return with_arrow(docs, text, fields, make, [text] * drop_text)


def round_trip_digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``doc_id``, the number of ids, and digests of the ids and of the bytes they decode to."""
    coded = round_trip(docs.select("doc_id", "text"), ranks, pattern, drop_text=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
