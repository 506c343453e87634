"""Hashed character n-gram embeddings, averaged into a linear softmax, trained in numpy.

Words that share character n-grams share vectors, so an unseen spelling is near the known ones. After training,
the softmax weights are folded into the embedding table: a bag's logits are then the mean of its n-grams' rows,
and a word's share can be cached.
"""

from __future__ import annotations

import ctypes
import gc
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import chain, count, islice

import numpy as np

#: Rows of the hashed table.
BUCKETS = 1 << 18


def clean_letters(token: str) -> str:
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def clean_edges(token: str) -> str:
    return token.strip(".,;:!?\"'()[]|*$%&#")


def codes(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of ``words``, one after the other, and the length of each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), sizes


_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x2545F4914F6CDD1D % 2**64)) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _STEP
    return h ^ (h >> np.uint64(29))


def word_hashes(points: np.ndarray, sizes: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each word's code points, 0 for empty words."""
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(points)) - np.repeat(starts, sizes)
    out, some = np.zeros(len(sizes), np.uint64), sizes > 0
    if some.any():
        powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(sizes.max()), _STEP)])
        out[some] = mixed(np.add.reduceat((points + np.uint64(1)) * powers[place], starts[some]), salt)
    return out


def grams(words: Sequence[str], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the n-grams of each word with its ends marked, and of the marked word; word after word, and how many each has.

    The hashes of all n-grams of a length are made at once from those of the length before. An empty word has none.
    """
    points, sizes = codes([f"<{w}>" if w else "" for w in words])
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(points))
    counts = [np.maximum(sizes - k + 1, 0) for k in range(lo, hi + 1)]
    total = np.sum(counts, axis=0) + (sizes > 0)
    out = np.empty(int(total.sum()), np.int64)
    at = np.cumsum(total) - total
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    h = points + np.uint64(1)
    for k in range(1, hi + 1):
        if k > 1:
            h = h[:-1] * _STEP + points[k - 1:] + np.uint64(1) if len(h) else h
        if k >= lo:
            here, n = np.flatnonzero(left[:len(h)] >= k), counts[k - lo]
            out[np.repeat(at - starts, n) + here] = mixed(h[here], k) >> shift
            at = at + n
    some = sizes > 0
    out[at[some]] = (word_hashes(points, sizes, 99) >> shift)[some]
    return out, total


@dataclass
class Trainer:
    """Embeddings and softmax, trained jointly by stochastic gradient descent with per-row step sizes."""

    classes: int
    lo: int = 2
    hi: int = 4
    dim: int = 16
    rate: float = 0.3
    batch: int = 128
    seed: int = 7
    words: dict = field(default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.e = rng.normal(0, 0.02, (BUCKETS, self.dim)).astype(np.float32)
        self.w = rng.normal(0, 0.3, (self.dim, self.classes)).astype(np.float32)
        self.b = np.zeros(self.classes, np.float32)
        self.e2 = np.full(BUCKETS, 1e-3, np.float32)
        self.w2 = np.full(self.w.shape, 1e-3, np.float32)
        self.b2 = np.full(self.classes, 1e-3, np.float32)

    def rows(self, bags: Sequence[Sequence[str]]) -> list[np.ndarray]:
        """The table rows of each bag of words."""
        new = list({w: None for words in bags for w in words if w not in self.words})
        flat, sizes = grams(new, self.lo, self.hi)
        self.words.update(zip(new, np.split(flat.astype(np.int32), np.cumsum(sizes)[:-1])))
        return [np.concatenate([self.words[w] for w in words]) if words else np.empty(0, np.int32) for words in bags]

    def _bags(self, bags: Sequence[np.ndarray]):
        sizes = np.fromiter((max(1, len(x)) for x in bags), np.int64, len(bags))
        flat = np.concatenate([x if len(x) else np.zeros(1, np.int32) for x in bags])
        return flat, sizes, np.cumsum(sizes) - sizes

    def hidden(self, bags):
        flat, sizes, starts = self._bags(bags)
        return np.add.reduceat(self.e[flat], starts) / sizes[:, None], flat, sizes

    def logits(self, bags: Sequence[np.ndarray]) -> np.ndarray:
        out = [self.hidden(bags[i:i + 512])[0] @ self.w + self.b for i in range(0, len(bags), 512)]
        return np.concatenate(out) if out else np.empty((0, self.classes), np.float32)

    def fit(self, bags: Sequence[np.ndarray], labels: np.ndarray, weights: np.ndarray | None = None, epochs: int = 1,
            steps: int = 0) -> None:
        """Go through the bags ``epochs`` times, and more often until ``steps`` steps are done."""
        rng = np.random.default_rng(self.seed + 1)
        weights = np.ones(len(bags), np.float32) if weights is None else weights
        for _ in range(max(epochs, -(-steps // -(-len(bags) // self.batch))) if bags else 0):
            order = rng.permutation(len(bags))
            for start in range(0, len(order), self.batch):
                at = order[start:start + self.batch]
                self._step([bags[i] for i in at], labels[at], weights[at])

    def _step(self, bags, labels, weights):
        h, flat, sizes = self.hidden(bags)
        z = h @ self.w + self.b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1
        p *= weights[:, None] / max(1, len(bags))
        gw, gb, gh = h.T @ p, p.sum(0), (p @ self.w.T) / sizes[:, None]
        order = np.argsort(flat, kind="stable")
        rows = flat[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        ge = np.add.reduceat(np.repeat(gh, sizes, axis=0)[order], starts) * len(bags)
        touched = rows[starts]
        self.e2[touched] += (ge ** 2).mean(1)
        self.e[touched] -= self.rate * ge / np.sqrt(self.e2[touched])[:, None]
        self.w2 += gw ** 2
        self.w -= self.rate * gw / np.sqrt(self.w2) * 0.3
        self.b2 += gb ** 2
        self.b -= self.rate * gb / np.sqrt(self.b2) * 0.3

    def table(self) -> np.ndarray:
        """Logits of each table row; a bag's logits are the mean of its rows plus ``b``."""
        return (self.e @ self.w).astype(np.float32)


class WordIds(defaultdict):
    """Numbers words in the order in which they are first met."""

    def __init__(self):
        super().__init__(count().__next__)

    def of(self, texts: Sequence[Sequence[str]]) -> list[np.ndarray]:
        sizes = list(map(len, texts))
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, sum(sizes))
        return np.split(ids, np.cumsum(sizes)[:-1]) if sizes else []

    def since(self, first: int) -> list[str]:
        """The words numbered from ``first`` on."""
        return list(islice(self, first, None)) if len(self) > first else []


class WordSums:
    """For each word the sum of its n-grams' logits and their count, for the words seen last."""

    def __init__(self, table: np.ndarray, lo: int, hi: int, clean, entries: int = 250_000):
        self.table, self.lo, self.hi, self.clean, self.entries = table, lo, hi, clean, entries
        self._empty()

    def _empty(self):
        self.index = WordIds()
        self.sums = np.zeros((1024, self.table.shape[1] + 1), np.float32)

    def _add(self, words: list[str], first: int) -> None:
        while len(self.sums) < first + len(words):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        for i in range(0, len(words), 20_000):
            flat, size = grams([self.clean(w) for w in words[i:i + 20_000]], self.lo, self.hi)
            some = np.flatnonzero(size)
            at = first + i + np.arange(len(size))
            self.sums[at] = 0
            if len(some):
                self.sums[at[some], :-1] = np.add.reduceat(self.table[flat], (np.cumsum(size) - size)[some])
                self.sums[at[some], -1] = size[some]

    def lookup(self, texts: Sequence[Sequence[str]]) -> list[np.ndarray]:
        """For each list of words, the rows (sums of logits ..., count) of its words."""
        if len(self.index) > self.entries:
            self._empty()
        first = len(self.index)
        found = self.index.of(texts)
        if new := self.index.since(first):
            self._add(new, first)
        return [self.sums[ids] for ids in found]


def give_back() -> None:
    """Return freed memory to the system after training on the driver, where the allocator has a call for it (glibc).

    Thousands of small bags leave the heap full of holes, some 100 MB, that the driver would hold for the rest of the job.
    """
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    gc.collect()
    if trim is not None:
        trim(0)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def platt(scores: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """a, b of the logistic curve sigmoid(a * score + b), with smoothed targets, by damped Newton steps."""
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    t = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    middle, spread = float(np.mean(scores)), float(np.std(scores)) or 1.0
    x = np.c_[(scores - middle) / spread, np.ones(len(scores))]
    v = np.zeros(2)

    def loss(v):
        z = x @ v
        return float(np.sum(np.logaddexp(0, z) - t * z))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - t))
        size = 1.0
        while size > 1e-6 and loss(v - size * step) > loss(v):
            size /= 2
        v = v - size * step
        if size * np.abs(step).max() < 1e-8:
            break
    return float(v[0] / spread), float(v[1] - v[0] * middle / spread)
