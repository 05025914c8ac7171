"""An n-gram model (order 3) in Elias-Fano levels.

Levels are sorted arrays: pairs by context, triples by their pair. Ids within
a context are made monotone by adding the last value before, and kept, like
the pointers to the next level, as Elias-Fano sequences: low bits packed, high
bits in unary. A triple's last word is named by its place among the successors
of the middle word, so small numbers are stored. Probabilities are quantised
to 8 bits. The arrays live in one unlinked file each, mapped into memory."""

from __future__ import annotations

import tempfile

import numpy as np


def _mapped(a: np.ndarray) -> np.ndarray:
    """``a`` in a memory-mapped temporary file that goes with its last reader."""
    if not a.size:
        return a
    with tempfile.TemporaryFile() as f:
        f.write(a.tobytes())
        f.flush()
        return np.memmap(f, a.dtype, "r", shape=a.shape)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, x: np.ndarray):
        n, top = len(x), int(x[-1]) + 1 if len(x) else 1
        self.n, self.bits = n, max(0, int(np.log2(max(1.0, top / max(1, n)))))
        x = x.astype(np.uint64)
        self.low = np.zeros(n * self.bits // 64 + 2, np.uint64)
        at = np.arange(n, dtype=np.int64) * self.bits
        low = x & np.uint64((1 << self.bits) - 1)
        if self.bits:
            word = at >> 6
            new = _runs(word)
            if n:
                self.low[word[new]] = np.bitwise_or.reduceat(low << (at & 63).astype(np.uint64), new)
            over = np.flatnonzero((at & 63) + self.bits > 64)  # one a word at most
            self.low[word[over] + 1] |= low[over] >> (64 - (at[over] & 63)).astype(np.uint64)
        ones = (x >> np.uint64(self.bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(((top >> self.bits) // 64 + n // 64 + 3) * 64, np.uint8)
        high[ones] = 1
        self.high = np.packbits(high, bitorder="little").view("<u8").astype(np.uint64, copy=False)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high))]).astype(np.int64)

    def map(self) -> EliasFano:
        self.low, self.high, self.before = _mapped(self.low), _mapped(self.high), _mapped(self.before)
        return self

    @staticmethod
    def _in_word(w: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Position of the r-th set bit of each word."""
        r, pos = r.copy(), np.zeros(len(w), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count((w >> pos.astype(np.uint64)) & np.uint64((1 << step) - 1)).astype(np.int64)
            go = c <= r
            r -= np.where(go, c, 0)
            pos += np.where(go, step, 0)
        return pos

    def _select(self, r: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, r, "right") - 1
        return (word << 6) + self._in_word(self.high[word], r - self.before[word])

    def _select_zero(self, r: np.ndarray) -> np.ndarray:
        zeros = np.arange(len(self.before), dtype=np.int64) * 64 - self.before
        word = np.searchsorted(zeros, r, "right") - 1
        return (word << 6) + self._in_word(~self.high[word], r - zeros[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        off = (at & 63).astype(np.uint64)
        w = self.low[at >> 6] >> off
        w |= np.where(off > 0, self.low[(at >> 6) + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (w & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i) - i) << self.bits) + self._low(i) if len(i) else i

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is not under each x (n: none), from
        the run of values that share x's high bits on."""
        return self.seek(x)[0]

    def seek(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``successor`` of each x, and whether it is x itself."""
        x = np.asarray(x, np.int64)
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = np.minimum(x >> self.bits, ((len(self.high) << 6) - self.n - 1))
        start = np.where(high > 0, self._select_zero(np.maximum(high - 1, 0)) - high + 1, 0)
        end = self._select_zero(high) - high
        low = x & ((1 << self.bits) - 1)
        lo, hi = start.copy(), end.copy()
        while True:  # halves the run of equal high bits
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        same = (lo < end) & (x >> self.bits == high)
        same[same] = self._low(lo[same]) == low[same]
        return lo, same


class Quantised:
    """Values as numbers of 8 bits into a table of their quantiles."""

    def __init__(self, x: np.ndarray):
        self.table = np.unique(np.quantile(x, np.linspace(0, 1, 256))) if len(x) else np.zeros(1)
        self.code = np.abs(np.searchsorted((self.table[1:] + self.table[:-1]) / 2, x)).astype(np.uint8)

    def map(self) -> Quantised:
        self.code = _mapped(self.code)
        return self

    def get(self, i: np.ndarray) -> np.ndarray:
        return self.table[self.code[i]]


class Level:
    """Successors by context: ``begin`` (pointers) and monotone ids."""

    def __init__(self, context: np.ndarray, ids: np.ndarray, contexts: int):
        begin = np.append(0, np.cumsum(np.bincount(context, minlength=contexts))).astype(np.int64)
        last = np.zeros(contexts + 1, np.int64)  # the value before each context's first
        ends = begin[1:] > begin[:-1]
        last[1:] = np.cumsum(np.where(ends, ids[np.maximum(begin[1:] - 1, 0)] + 1 if len(ids) else 0, 0))
        self.begin, self.ids = EliasFano(begin), EliasFano(ids + last[context] if len(ids) else ids)
        self.last = EliasFano(last)

    def map(self) -> Level:
        for x in (self.begin, self.ids, self.last):
            x.map()
        return self

    def find(self, context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each (context, id), -1 if it is not there; and the context's begin."""
        new = _runs(context)
        one, times = context[new], np.diff(np.append(new, len(context)))  # a run's pointers are read once
        begin, want = np.repeat(self.begin.get(one), times), np.repeat(self.last.get(one), times) + ids
        at, same = self.ids.seek(want)
        # a context's values end where those of the next one begin
        return np.where(same & (want < np.repeat(self.last.get(one + 1), times)), at, -1), begin


class Trie:
    """log10 probabilities of classes given up to two classes before.

    ``unigram``: probabilities of the classes, which are also the last resort.
    ``pairs``, ``triples``: (packed key, count) arrays; a key's digits are
    classes in base ``len(unigram) + 1``, whose last number is the text's
    begin. Absolute discounting: what the kept entries of a context leave
    goes to the shorter context, so every context sums to one however many
    entries were pruned."""

    DISCOUNT = 0.75

    def __init__(self, unigram: np.ndarray, pairs: tuple, totals: np.ndarray, triples: tuple):
        base = self.base = len(unigram) + 1
        self.unigram = np.log10(np.append(unigram, 1e-300))
        order = np.argsort(pairs[0])
        key, count = pairs[0][order], pairs[1][order].astype(float)
        u, v = key // base, key % base
        self.two = Level(u, v, base)
        first = (count - self.DISCOUNT) / np.maximum(totals[u], 1)
        bow = np.clip(1 - np.bincount(u, first, base), 1e-12, 1)
        p2 = first + bow[u] * unigram[v] if len(u) else first
        # triples whose first pair and whose last pair are kept
        tk, tc = triples
        uv, vw = tk // base, tk % (base * base)
        at, at2 = np.searchsorted(key, uv), np.searchsorted(key, vw)
        ok = (at < len(key)) & (at2 < len(key))
        ok[ok] = (key[at[ok]] == uv[ok]) & (key[at2[ok]] == vw[ok])
        at, at2, tc = at[ok], at2[ok], tc[ok].astype(float)
        rank = at2 - np.searchsorted(u, v[at]) if len(at) else at
        order = np.lexsort((rank, at))
        at, at2, tc, rank = at[order], at2[order], tc[order], rank[order]
        self.three = Level(at, rank, len(key))
        third = (tc - self.DISCOUNT) / np.maximum(count[at], tc) if len(at) else tc
        bow2 = np.clip(1 - np.bincount(at, third, len(key)), 1e-12, 1)
        p3 = third + bow2[at] * p2[at2] if len(at) else third
        self.bow = np.log10(bow)
        self.p2, self.bow2, self.p3 = Quantised(np.log10(p2)), Quantised(np.log10(bow2)), Quantised(np.log10(p3))

    def map(self) -> Trie:
        for x in (self.two, self.three, self.p2, self.bow2, self.p3):
            x.map()
        return self

    def score(self, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each class of texts laid end to end; ``first`` marks their beginnings."""
        if not len(classes):
            return np.zeros(0)
        begin = self.base - 1
        prev = np.where(first, begin, np.append(begin, classes[:-1]))
        pair, back = np.unique(prev * self.base + classes, return_inverse=True)
        found, start = self.two.find(pair // self.base, pair % self.base)
        at = found[back]
        out = np.where(at >= 0, self.p2.get(np.maximum(at, 0)), self.bow[prev] + self.unigram[classes]) if self.two.ids.n else \
            self.bow[prev] + self.unigram[classes]
        context = np.where(first, -1, np.append(-1, at[:-1]))  # the pair before, if it is kept
        has = np.flatnonzero(context >= 0)
        if not self.two.ids.n or not len(has):
            return out
        rank = np.where(at[has] >= 0, at[has] - start[back][has], -1)
        out[has] += self.bow2.get(context[has])
        know = rank >= 0
        triple, back3 = np.unique(context[has][know] * self.base + rank[know], return_inverse=True)
        got = self.three.find(triple // self.base, triple % self.base)[0][back3]
        hit = got >= 0
        out[has[know][hit]] = self.p3.get(got[hit])
        return out


class PartTrie:
    """Exact counts of the training positions (word, middle word, last word)
    of one part of a model: successors of each middle word, words before each
    middle word, and last words of each pair, as Elias-Fano levels. ``none``
    stands before a text's begin and makes no pair."""

    def __init__(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, none: int):
        self.none, self.middle = none, np.unique(w2)
        n, self.v = len(self.middle), int(max(w1.max(), w2.max(), w3.max())) + 1 if len(w1) else 1
        self.place = np.full(self.v, -1, np.int32)  # of each middle word
        self.place[self.middle] = np.arange(n)
        u = self.place[w2].astype(np.int64)
        pair, at, self.c2 = np.unique(u * self.v + w3, return_inverse=True, return_counts=True)
        self.c1, self.t2 = np.bincount(u, minlength=n), np.bincount(pair // self.v, minlength=n)
        inner = w1 != none
        before, back, self.c12 = np.unique((u * self.v + w1)[inner], return_inverse=True, return_counts=True)
        rank = (at - np.append(0, np.cumsum(self.t2))[u])[inner]
        size = self.size = int(rank.max()) + 1 if len(rank) else 1
        triple, self.c3 = np.unique(back * size + rank, return_counts=True)
        self.t12 = np.bincount(triple // size, minlength=len(before))
        self.after = Level(pair // self.v, pair % self.v, n)
        self.before = Level(before // self.v, before % self.v, n)
        self.last = Level(triple // size, triple % size, len(before))

    def _place(self, w2: np.ndarray) -> np.ndarray:
        """Place of each middle word, -1 if it is not here."""
        return np.where(w2 < self.v, self.place[np.minimum(w2, self.v - 1)], -1).astype(np.int64)

    @staticmethod
    def _found(level: Level, context: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each entry, -1 if it is not there or not ``ok``; and its context's begin."""
        at, begin = np.full(len(ids), -1), np.zeros(len(ids), np.int64)
        ok = np.flatnonzero(ok)
        if len(ok):
            at[ok], begin[ok] = level.find(context[ok], ids[ok])
        return at, begin

    def pairs(self, w2: np.ndarray, w3: np.ndarray) -> tuple[np.ndarray, ...]:
        """Counts of each w2 before any word, of the words after it, and of the
        pair; the middle word's place, and the last word's among those after it (-1: not there)."""
        u = self._place(w2)
        at, begin = self._found(self.after, u, w3, (u >= 0) & (w3 < self.v))
        get = lambda x, i: np.where(i >= 0, np.append(x, 0)[i], 0)
        return get(self.c1, u), get(self.t2, u), get(self.c2, at), u, np.where(at >= 0, at - begin, -1)

    def triples(self, w1: np.ndarray, u: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of each w1 with the middle word at ``u`` before any word, of
        the words after the two, and of the triple with the word of ``rank``."""
        ok = (u >= 0) & (w1 < self.v) & (w1 != self.none)
        one, back = np.unique(np.where(ok, u * self.v + w1, -1), return_inverse=True)
        context = self._found(self.before, one // self.v, one % self.v, one >= 0)[0][back]
        found, _ = self._found(self.last, context, rank, (context >= 0) & (rank >= 0) & (rank < self.size))
        get = lambda x, i: np.where(i >= 0, np.append(x, 0)[i], 0)
        return get(self.c12, context), get(self.t12, context), get(self.c3, found)
